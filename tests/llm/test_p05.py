import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import p05_format_copies as P


def canon(t):
    return "".join(c.lower() for c in t if c.isalnum())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbB1 .,-\néÉ₹अ", max_size=30), min_size=1, max_size=8))
def test_hashes_agree_with_canonical_strings(texts):
    count, h1, h2 = P.rolling_hashes(texts)
    for i, a in enumerate(texts):
        assert count[i] == len(canon(a))
        for j, b in enumerate(texts):
            assert ((h1[i], h2[i]) == (h1[j], h2[j])) == (canon(a) == canon(b)) == P.same_skipping(a, b)


FIELDS = ["Limit: ₹1,545 | Owner: desk | Town: Mirzan", "- OWNER : desk\n- TOWN : mirzan\n- LIMIT : ₹1545", '{"town": "Mirzan", "limit": "₹1,545", "owner": "Desk"}', "Owner: desk; Town: Mirzan; Limit: ₹1,545;"]


def test_named_fields_in_any_order_and_notation():
    _, h1, _ = P.content_hashes([*FIELDS, "Limit: desk | Owner: ₹1,545 | Town: Mirzan", "Notice 7: a b; c"])
    assert len(set(h1[:4].tolist())) == 1 and len(set(h1.tolist())) == 3
    assert all(P.same_record(FIELDS[0], f) for f in FIELDS) and not P.same_record(FIELDS[0], "Limit: desk | Owner: ₹1,545 | Town: Mirzan")


def same(*texts):
    _, h1, h2 = P.content_hashes(list(texts))
    equal = len(set(zip(h1.tolist(), h2.tolist()))) == 1
    assert all(P.same_record(texts[0], t) for t in texts) == equal
    return equal


def test_nested_objects_long_names_and_numbers_without_a_blank():
    assert same('{"a":{"x":1,"y":2},"b":[1,{"p":3,"q":4}]}', '{"b":[1,{"q":4,"p":3}],"a":{"y":2,"x":1}}', '{ "A": {"Y":"2", "x":"1"}, "b": [1, {"q": 4, "p": 3}] }')
    assert not same('{"a":{"x":1,"y":2}}', '{"a":{"x":2,"y":1}}') and not same('{"b":[1,2]}', '{"b":[2,1]}') and not same('{"a":{"bc":1},"d":2}', '{"ab":{"c":1},"d":2}')
    assert same("amount=5000; tenure=12", "Tenure: 12 | Amount: 5000") and same("Charge:9870 | Town:X", "town: x, charge: 9870") and same("Field 1: a | Field 2: b", "Field 2: b | Field 1: a")
    long = "the name of a field that is a good deal longer than any that one would write by hand in a table"
    assert same(f"{long}: 1 | Other: 2", f"OTHER = 2; {long.upper()} = 1")
    assert not same("open at 10:30; closed at 17:45", "closed at 17:45; open at 10:30") and not same("see http://a.b; or http://c.d", "or http://c.d; see http://a.b")
    assert same("{}", " { } ") and P.named_fields("{" * 5000) is None


def test_slices_make_no_difference(monkeypatch):
    texts = ["ab, c" * 50, "", "x", "Abc" * 40, "ab c" * 50]
    whole = P.rolling_hashes(texts)
    monkeypatch.setattr(P, "SLICE", 7)
    assert all((a == b).all() for a, b in zip(whole, P.rolling_hashes(texts)))


def test_the_exact_key_tells_records_with_colliding_hashes_apart():
    data = [("a", "one"), ("b", "two"), ("c", "TWO!"), ("d", "One."), ("e", "k: 1 | l: 2"), ("f", "l: 2; k: 1")]
    one = pa.record_batch({"id": pa.array([i for i, _ in data]), "content": pa.array([t for _, t in data])})
    keys = P._exact_key(iter([one])).__next__()["exact"].to_pylist()
    assert keys[0] == keys[3] != keys[1] == keys[2] and keys[4] == keys[5]


def test_groups_nulls_repeats_and_clashing_columns(spark, rows):
    data = [("b", "The fee.", 1), ("b", "The fee.", 1), ("a", " the  FEE!", 1), ("c", "thefee", 1), ("d", "other", 1), ("e", None, 1), ("f", "---", 1), ("g", "…", 1), (None, "the fee", 1), ("h", "", 1)]
    data += [(f"x{i}", t, 1) for i, t in enumerate(FIELDS)]
    content = spark.createDataFrame(data, "id string, content string, h1 int")
    assert rows(P.format_copies(content)) == [("a", "b"), ("a", "c"), ("x0", "x1"), ("x0", "x2"), ("x0", "x3")]
    counts = dict(rows(P.copy_counts(content)))
    assert counts == {"a": 3, "d": 1, "x0": 4}
    assert P.format_copies(spark.createDataFrame([], "id string, content string")).count() == 0


def test_a_hot_group_is_salted(spark, monkeypatch):
    import larkspur.operators.skew as skew

    content = spark.createDataFrame([(f"i{n:04d}", f"Same text {'!' * (n % 7)}") for n in range(400)] + [("z", "x y")], "id string, content string")
    original = skew.join_by_key
    monkeypatch.setattr(P, "join_by_key", lambda *a, **k: original(*a, **{**k, "hot_rows": 50, "salts": 4}))
    assert P.format_copies(content).count() == 399


def test_a_very_long_text():
    long = "ab " * 500_000
    _, h1, _ = P.content_hashes([long, long.upper().replace(" ", "")])
    assert h1[0] == h1[1]
