import random

import numpy as np

from larkspur.llm import p08_leaks as P
from larkspur.llm.text import words

CASES = "id string, input string, expected_output string, doc_id long"
DOCS = "doc_id long, text string, case_id string"


def brute(docs, cases, k=12):
    grams = {}
    for i, *texts in cases:
        for t in texts[:2]:
            w = words(t or "")
            for j in range(len(w) - k + 1):
                grams.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for j in range(len(w) - k + 1):
            out |= {(d, c) for c in grams.get(tuple(w[j : j + k]), ())}
    return out


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        assert P.suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_index_finds_every_place():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 4, 500)
    index = P.FMIndex(s, 4)
    phrases = np.array([[1, 2], [3, 3], [2, 1], [1, 1]])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(499) if (s[i : i + 2] == p).all()]


def test_against_brute_force_in_small_shards(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    cases = [(f"c{i}", " ".join(rnd.choices(vocab, k=30)), " ".join(rnd.choices(vocab, k=20)) if i % 2 else None, 1) for i in range(20)]
    docs = []
    for d in range(80):
        w = rnd.choices(vocab + ["zz"], k=60)
        if d % 3 == 0:
            src = cases[d % 20][1].split()
            n = rnd.choice([11, 12, 25])
            w[10:10] = src[2 : 2 + n]
        docs.append((d, " ".join(w).title() + "."))
    docs += [(100, None), (101, ""), (None, cases[0][1]), (0, docs[0][1])]
    found = {tuple(r) for r in P.leaks(spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS), spark.createDataFrame(cases, CASES), shard_words=300, block_words=200).collect()}
    assert found == {x for x in brute(docs, cases) if x[0] is not None} and found


def test_spans_cover_the_passage(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Intro, {passage}. Outro", "x")], DOCS)
    r = P.leaked_spans(docs, spark.createDataFrame([("c", passage, None, 1)], CASES)).collect()
    assert [(x.start_pos, x.end_pos, x.n_words) for x in r] == [(8, 7 + len(passage), 20)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert P.leaks(none, spark.createDataFrame([("c", "a b", None, 1)], CASES)).count() == 0
    assert P.leaks(spark.createDataFrame([(1, "a b", "x")], DOCS), spark.createDataFrame([], CASES)).count() == 0
