import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import p01_split as P


def rebuilt(text, spans):
    out, done = "", 0
    for s, e in spans:
        assert s <= done
        out += text[done:e]
        done = e
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n\r,;अ。 ", max_size=400), st.integers(1, 60), st.integers(-3, 70))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    spans = P.pieces(text, limit, overlap)
    kept = max(0, overlap) if overlap < limit else limit // 10
    assert all(0 < e - s <= limit or not text for s, e in spans)
    assert rebuilt(text, spans) == text
    assert all(b[0] == max(a[1] - kept, 0) for a, b in zip(spans, spans[1:]))


def test_cuts_at_the_strongest_boundary_and_the_rightmost_of_equals():
    text = "One two three. Four five six.\n\nSeven eight nine ten eleven twelve."
    spans = P.pieces(text, 40, 0)
    assert text[slice(*spans[0])] == "One two three. Four five six.\n\n"
    text = "aa bb cc dd ee ff"
    assert text[slice(*P.pieces(text, 10, 0)[0])] == "aa bb cc "


def test_range_maximum_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    strength = rng.integers(0, 5, 200).astype(np.int8)
    best = P.StrongestCut(strength, 50)
    for lo in range(0, 150, 7):
        for hi in (lo, lo + 3, lo + 49):
            assert best(lo, hi) == max(((i, int(strength[i])) for i in range(lo, hi + 1)), key=lambda x: (x[1], x[0]))


def test_without_boundaries_pieces_are_full():
    assert P.pieces("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]


def test_a_limit_below_one_is_an_error():
    with pytest.raises(ValueError):
        P.pieces("abc", 0, 0)


SCHEMA = "run_id string, extracted_text string, chunks array<struct<chunk_id:string,content:string>>, chunking_config struct<max_chars:int,overlap:int>, text string, item_no string"


def test_found_with_nulls_repeats_and_clashing_columns(spark, rows):
    data = [
        ("a", "x" * 1001, None, None, "clash", "clash"),
        ("a", "x" * 1001, None, None, "clash", "clash"),
        ("b", None, [("c", "y" * 51), ("d", None), ("e", "")], (50, None), None, None),
        ("c", "x" * 1000, [], (None, 10), None, None),
        ("d", "", None, (10, 3), None, None),
        (None, "z" * 20, None, (10, 3), None, None),
    ]
    runs = spark.createDataFrame(data, SCHEMA)
    assert rows(P.oversized(P.items(runs))) == sorted([("a", 0), ("b", 1), (None, 0)], key=repr)
    pieces = P.split_oversized(P.items(runs)).where("run_id = 'b'").orderBy("piece_no").collect()
    assert "".join(p["piece"] for p in pieces) == "y" * 51


def test_empty_table_and_a_very_long_text(spark):
    assert P.oversized(P.items(spark.createDataFrame([], SCHEMA))).count() == 0
    runs = spark.createDataFrame([("a", "word. " * 200_000, None, (1000, 250), None, None)], SCHEMA)
    pieces = P.split_oversized(P.items(runs))
    assert pieces.count() > 1000 and pieces.where("n_chars > 1000").count() == 0
