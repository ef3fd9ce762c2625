import random

import numpy as np

from larkspur.llm import p06_near_copies as P
from larkspur.llm.text import words


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(n):
        base = [rnd.choice(vocab) for _ in range(60)]
        out[f"a{i:03d}"] = " ".join(base)
        edited = list(base)
        for _ in range(rnd.randint(0, 8)):
            edited[rnd.randrange(60)] = rnd.choice(vocab)
        out[f"b{i:03d}"] = " ".join(edited)
    return out


def brute(docs, least=0.5):
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t in docs.items() if len(w := words(t)) >= 40}
    keys, out = sorted(sets), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n >= least * (len(sets[a]) + len(sets[b]) - n) and "".join(words(docs[a])) != "".join(words(docs[b])):
                out.add((a, b))
    return out


def test_against_brute_force(spark):
    docs = texts(5, 60)
    docs["copy"] = docs["a000"].upper() + "!"
    docs["short"] = "too short"
    found = {tuple(r) for r in P.near_copies(spark.createDataFrame(list(docs.items()), "id string, content string")).collect()}
    truth = brute(docs)
    assert len(truth) > 30 and not found - truth and len(found & truth) >= 0.97 * len(truth)


def test_groups_and_links(spark):
    docs = texts(9, 12)
    docs["copy"] = docs["a000"].upper()
    rows = {r["id"]: r for r in P.near_copy_groups(spark.createDataFrame(list(docs.items()), "id string, content string")).collect()}
    assert set(rows) == set(docs) and rows["copy"]["group_id"] == rows["a000"]["group_id"]
    pairs = brute(docs)
    assert all(rows[a]["group_id"] == rows[b]["group_id"] for a, b in pairs)


def test_nulls_empty_repeats(spark):
    docs = list(texts(2, 3).items())
    data = [*docs, *docs, ("n", None), (None, docs[0][1]), ("e", "")]
    once = P.near_copies(spark.createDataFrame(docs, "id string, content string")).count()
    assert P.near_copies(spark.createDataFrame(data, "id string, content string")).count() == once
    assert P.near_copies(spark.createDataFrame([], "id string, content string")).count() == 0


def test_hot_bands_and_classes_are_split_without_losing_a_pair(spark, monkeypatch):
    docs = texts(7, 25)
    docs |= {f"c{i}": docs["a000"].upper() + "!" * i for i in range(6)} | {f"d{i}": docs["b000"] + "." * i for i in range(4)}
    frame = spark.createDataFrame(list(docs.items()), "id string, content string")
    plain = {tuple(r) for r in P.near_copies(frame).collect()}
    monkeypatch.setattr(P, "HOT_BAND", 2)
    monkeypatch.setattr(P, "HOT_SHARE", 1)
    monkeypatch.setattr(P, "HOT_ROWS", 3)
    assert {tuple(r) for r in P.near_copies(frame).collect()} == plain
    assert len(plain) >= 25 and len({p for p in plain if p[0][0] + p[1][0] == "cd"}) in (0, 24)


def test_rows_of_a_band_are_compared_tile_by_tile(monkeypatch):
    monkeypatch.setattr(P, "TILE", 7)
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 6, (40, 2), dtype=np.int64).astype(np.uint64)
    vid = rng.permutation(40)
    differ = [[sum((int(x) ^ int(y)) >> k & 3 > 0 for x, y in zip(prints[i], prints[j]) for k in range(0, 64, 2)) for j in range(40)] for i in range(40)]
    want = {(min(vid[i], vid[j]), max(vid[i], vid[j])) for i in range(40) for j in range(i) if differ[i][j] <= 3}
    a, b = P.close_in_band(vid, prints, 3)
    assert set(zip(a, b)) == want and len(a) == len(want)
    side = vid % 3 == 0
    a, b = P.close_in_band(vid, prints, 3, side)
    assert set(zip(a, b)) == {(x, y) for x, y in want if (x % 3 == 0) != (y % 3 == 0)}


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (600, 200, 200))
    h = P.minhashes(np.concatenate([shared, a, shared, b]), np.array([800, 800]), 512, 3)
    assert abs((h[0] == h[1]).mean() - 0.6) < 0.08
