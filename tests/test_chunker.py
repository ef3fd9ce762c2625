import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.operators import chunker as C


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=300), st.integers(5, 60), st.integers(0, 70))
def test_chunks_fit_and_hold_all_words(text, size, overlap):
    chunks = C.windowed(text, size, overlap)
    assert all(len(c) <= size for c in chunks)
    assert "".join("".join(chunks).split()).count("a") >= text.count("a")


def test_packing_overlap_and_hard_splits():
    assert C.windowed("one two\n\nthree four\n\nfive six", 20, 0) == ["one two\n\nthree four", "five six"]
    assert C.windowed("one two\n\nthree four\n\nfive six", 22, 5) == ["one two\n\nthree four", "four\n\nfive six"]
    assert C.windowed("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "xxx\n\nxxxx"]  # only the last piece has room for an overlap
    assert C.windowed("", 10, 3) == [] and C.windowed(None) == []
    assert C.limits(100, 200) == (100, 10) and C.limits(100, -1) == (100, 0)
    with pytest.raises(ValueError):
        C.limits(0, 0)


def test_text_without_blank_lines_is_one_paragraph():
    assert C.windowed("line one\nline two\nline three") == ["line one\nline two\nline three"]
    assert C.windowed("one\n\n \n") == ["one"] and C.windowed(" \n ") == []
    assert C.windowed("A first line.\nA second line.", 16, 0) == ["A first line.", "A second line."]


def element(text, kind="paragraph", level=None, page=None):
    return {"text": text, "element_type": kind, "heading_level": level, "page": page}


def test_sections():
    parts = [element("Lost", "heading", 1, 1), element("Kept", "heading", 1, 2), element("A line", page=2), element("goes on.", page=3), element("New one."), element("Sub", "subheading", 2, 4), element("Body.", page=4), element("8.1 Next topic"), element("End")]
    s = C.sections(parts)
    assert [(x["heading"], x["subheading"], x["body"], x["pages"]) for x in s] == [("Kept", None, "A line goes on.\n\nNew one.", [1, 2, 3]), ("Kept", "Sub", "Body.", [4]), ("8.1 Next topic", None, "End", [])]
    assert C.sections([]) == [] and C.sections([element(None), element(" ")]) == []


def test_pipeline_keeps_first_and_drops_near_duplicates(spark):
    long = "The settlement team must reconcile the valuation report within thirty days of receipt."
    rows = [("d", 0, "H", "", long, "x"), ("d", 1, "H", "", long.upper() + " ", "x"), ("d", 2, "H", "", long.replace("thirty", "forty"), "x"), ("d", 3, "I", "", long, "x"), ("e", 0, "H", "", long, "x"), ("d", 4, "H", "", None, "x"), ("d", 5, "H", "", "***", "x")]
    df = spark.createDataFrame(rows, "doc_id string, ord int, heading string, subheading string, content string, extra string")
    first = C.exact_first(df, ["doc_id"], ["heading", "subheading", "content"], ["ord"])
    assert {(r.doc_id, r.ord) for r in first.collect()} == {("d", 0), ("d", 2), ("d", 3), ("e", 0), ("d", 4)}
    near = C.near_first(first)
    assert near.columns == df.columns and {(r.doc_id, r.ord) for r in near.collect()} == {("d", 0), ("d", 3), ("e", 0), ("d", 4)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=40), max_size=6))
def test_near_rule_is_the_plain_ratio(texts):
    for a in texts:
        for b in texts:
            assert C.is_near(a, C.Known(b)) == (SequenceMatcher(None, a, b).ratio() >= 0.85)


def test_large_groups_are_settled_as_the_fold_would(spark):
    rnd = random.Random(8)
    rows = []
    for g in ("a", "b"):
        base = "the settlement team must reconcile the valuation report within days"
        for i in range(60):
            text = list(base)
            for _ in range(rnd.randint(0, 9)):
                text[rnd.randrange(len(text))] = rnd.choice("xyz ")
            if rnd.random() < 0.3:
                base = "".join(text)
            rows.append((g, i, "H", "", "".join(text)))
    rows += [("c", 0, "H", "", "single"), ("d", 0, "H", "", None), ("d", 1, "H", "", None)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, heading string, subheading string, content string")
    whole = {(r.doc_id, r.ord) for r in C.near_first(df).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in (r for r in rows if r[0] == g):
            if not any(k and r[4] and SequenceMatcher(None, " ".join(r[4].split()), " ".join(k.split())).ratio() >= 0.85 for k in kept):
                kept.append(r[4])
                want.add(r[:2])
    assert whole == {(r.doc_id, r.ord) for r in C.near_first(df, block=8).collect()}
    assert 5 < len([x for x in whole if x[0] == "a"]) < 60 and whole == want


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id string, ord int, text string, element_type string, heading_level int, page int")
    assert C.create_chunks(C.build_sections(e)).count() == 0
    assert C.fixed_windows(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")).count() == 0


def test_standard_chunks(spark):
    df = spark.createDataFrame([("d", 3, None, "f", ".PDF", "r", " a b \n")], "doc_id string, ord int, chunk_id string, file_name string, file_type string, allowed_role string, content string")
    r = C.standard_chunks(df).first()
    assert (r.chunk_id, r.file_type, r.content) == ("d_c3", "pdf", "a b") and len(r.content_hash) == 40
