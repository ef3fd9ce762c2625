import numpy as np

from larkspur.llm import p03_neighbours as P

SCHEMA = "collection string, id string, v array<float>, vid long, unit string"


def frame(spark, items):
    return spark.createDataFrame([(c, i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for c, i, v in items], SCHEMA)


def brute(ids, m, k, least):
    m = m / np.linalg.norm(m, axis=1)[:, None]
    c = m @ m.T
    out = set()
    for i in range(len(ids)):
        others = sorted((j for j in range(len(ids)) if j != i and c[i, j] >= least), key=lambda j: (-c[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in others}
    return out


def test_hilbert_keys_are_a_curve():
    import itertools

    cells = np.array(list(itertools.product(range(8), repeat=2)))
    order = cells[np.argsort(P.hilbert_keys(cells, 3))]
    assert len(set(P.hilbert_keys(cells, 3).tolist())) == 64
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 64))
    near = base[:200] + rng.standard_normal((200, 64)) * 0.2
    m = np.concatenate([base, near]).astype(np.float32)
    ids = [f"i{n:05d}" for n in range(len(m))]
    found = {(r.id_a, r.id_b) for r in P.close_pairs(frame(spark, [("a", i, v) for i, v in zip(ids, m)])).collect()}
    truth = brute(ids, m.astype(float), 5, 0.9)
    assert len(truth) >= 190 and len(found & truth) >= 0.98 * len(truth) and not found - truth


def test_unusable_vectors_repeats_ties_and_collections(spark, rows):
    one, two = [1.0] + [0.0] * 63, [1.0, 0.01] + [0.0] * 62
    items = [("a", "x", one), ("a", "x", one), ("a", "y", two), ("b", "z", one), ("a", "zero", [0.0] * 64), ("a", "short", [1.0]), ("a", "null", None), ("a", "nan", [float("nan")] + [1.0] * 63), ("a", "inf", [float("inf")] + [1.0] * 63), ("a", "hole", [None] + [1.0] * 63), ("a", None, one)]
    assert rows(P.close_pairs(frame(spark, items))) == [("a", "x", "y")]
    assert P.close_pairs(frame(spark, [])).count() == 0


def test_many_equal_vectors_give_five_neighbours_each(spark):
    items = [("a", f"i{n:03d}", [1.0] * 64) for n in range(300)]
    near = P.nearest(frame(spark, items), 5, 0.9)
    assert near.groupBy("id").count().where("count <> 5").count() == 0


def test_all_rows_get_their_neighbours(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((8000, 24)) @ rng.standard_normal((24, 64)) + rng.standard_normal((8000, 64)) * 0.5
    ids = [f"i{n:05d}" for n in range(len(m))]
    found = {(r.id, r.neighbour) for r in P.nearest(frame(spark, [("a", i, v) for i, v in zip(ids, m)])).collect()}
    m = m.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    c = m @ m.T
    np.fill_diagonal(c, -2)
    truth = {(ids[i], ids[j]) for i, row in enumerate(np.argpartition(-c, 4, axis=1)[:, :5]) for j in row}
    assert len(found) == len(truth) == 40_000 and len(found & truth) >= 0.9 * len(truth)


def test_a_dense_group_and_ties_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    m = rng.standard_normal(64) + rng.standard_normal((6000, 64)) * 0.3
    ids = [f"i{n:05d}" for n in range(len(m))]
    found = {(r.id_a, r.id_b) for r in P.close_pairs(frame(spark, [("a", i, v) for i, v in zip(ids, m)])).collect()}
    truth = brute(ids, m.astype(np.float32).astype(float), 5, 0.9)
    assert len(truth) > 10_000 and len(found & truth) >= 0.9 * len(truth)
    equal = [("a", f"e{n:03d}", [1.0] * 64) for n in range(300)] + [("a", "d", [1.0] * 63 + [0.9])]
    near = {}
    for r in P.nearest(frame(spark, equal), 5).collect():
        near.setdefault(r.id, {})[r.rank] = r.neighbour
    assert near["e200"] == {i + 1: f"e{i:03d}" for i in range(5)}
    assert near["e002"] == {1: "e000", 2: "e001", 3: "e003", 4: "e004", 5: "e005"}
    assert near["d"] == {i + 1: f"e{i:03d}" for i in range(5)} and len(near) == 301
