from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import p09_mix as P


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 800))
def test_fit_against_brute_force(lengths, budget):
    taken = P.fit(lengths, budget)
    assert all(0 < n <= lengths[k] for k, n in taken.items())
    total = sum(k * n for k, n in taken.items())
    sums = {0}
    for k, n in lengths.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    best = max(s for s in sums if s <= budget)
    assert total <= budget and best - total <= max(lengths)
    if budget <= 4 * max(lengths):
        assert total == best


def test_budgets_respect_caps_and_weights():
    b = P.budgets({"a": 100, "b": 1000, "c": 1000}, {"a": (1.0, 2), "b": (1.0, 1), "c": (2.0, 1), "d": (1.0, 1), "e": (0.0, 3)}, 1400)
    assert b["a"] == 200 and b["b"] == 400 and b["c"] == 800 and "d" not in b


def test_mix_and_shares(spark):
    text = "one two three four five six seven eight nine ten "
    docs = [(i, text * (1 + i % 5), "big" if i % 3 else "small", "x") for i in range(300)] + [(None, text, "big", "x"), (900, None, "big", "x"), (901, text, None, "x"), (902, text, "unnamed", "x"), (0, text, "small", "x")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, times string")
    targets = spark.createDataFrame([("big", 1.0, 2), ("small", 1.0, 3), ("none", 2.0, 1), ("small", 0.0, 1), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    mixed = P.mix(documents, targets)
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["times"] <= (2 if r["source"] == "big" else 3) for r in rows)
    shares = {r["source"]: r for r in P.shares(mixed, targets).collect()}
    assert abs(shares["big"]["reached_share"] - 0.5) < 0.01 and abs(shares["small"]["reached_share"] - 0.5) < 0.01 and shares["none"]["tokens"] == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.mix(documents, targets).collect()))


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert P.mix(documents, targets).count() == 0
    assert P.mix(spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string"), targets.limit(0)).count() == 0
