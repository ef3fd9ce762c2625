"""Problem 6: records that share most of their content after small edits.

Contents are compared as sets of three consecutive words. Copies are collapsed to representatives first. Every
representative gets a fingerprint of min-hashes, cut to two bits each for distances. Representatives that agree in one
of several bands of full min-hashes are compared by the distance of their fingerprints, block by block, where they
meet, so only close pairs leave the task. The survivors are verified on their texts by the exact similarity. The README
gives the measured reason why distances to reference fingerprints (a pivot table) can't choose the candidates here.

Defined results: null ids and contents and contents of fewer than ``min_words`` words are left out; repeated rows
count once; rows equal in the sense of problem 5 are no pair; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.p05_format_copies import content_hashes, mix
from larkspur.llm.text import words
from larkspur.operators.components import components
from larkspur.operators.skew import HOT_ROWS, MOST_HOT, join_by_key
from larkspur.session import cut

MIN_WORDS = 40
SHINGLE = 3
LEAST = 0.5
BANDS = 32
ROWS = 3
SEED = 7
#: Standard deviations of slack that the fingerprint test leaves at the least similarity.
SLACK = 4.5
#: Rows of a part of a band that many rows share, and one in how many rows is looked at to find such bands.
HOT_BAND = 4096
HOT_SHARE = 64
#: Parts of a class of very many copies.
PARTS = 16
#: Rows of fingerprints that are compared with as many others at once.
TILE = 1024
_U = np.uint64


class Shingler:
    """Hashes of the word shingles of a batch of texts; word hashes are remembered."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def _hash(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            h = self.known[word] = xxhash.xxh64_intdigest(word)
            if len(self.known) > 2_000_000:
                self.known = {}
        return h

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingle hashes of all texts one after the other, how many each text has)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter((self._hash(w) for t in texts for w in t), _U, int(sizes.sum()))
        n = np.maximum(sizes - self.size + 1, 0)
        start = np.repeat(np.cumsum(sizes) - sizes, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            h = np.zeros(len(start), _U)
            for k in range(self.size):
                h = mix(h + flat[start + k] * _U(2 * k + 3))
        row = np.repeat(np.arange(len(texts)), n)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return h[new], np.bincount(row[new], minlength=len(texts))


def minhashes(shingles: np.ndarray, sizes: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Min-hashes (texts x count) of shingle sets that lie one after the other; every set has a member."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, count, dtype=np.int64).astype(_U) | _U(1)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), count), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(count):
            out[:, k] = np.minimum.reduceat(((shingles ^ (factors[k] >> _U(7))) * factors[k]) >> _U(32), starts)
    return out


def two_bits(hashes: np.ndarray) -> np.ndarray:
    """Two bits of every min-hash, 32 of them in a 64-bit word (texts x words)."""
    count = hashes.shape[1]
    bits = mix(hashes.astype(_U)) & _U(3)
    out = np.zeros((len(hashes), -(-count // 32)), _U)
    for k in range(count):
        out[:, k // 32] |= bits[:, k] << _U(2 * (k % 32))
    return out


def band_keys(hashes: np.ndarray, rows: int) -> np.ndarray:
    """One key for each group of ``rows`` min-hashes (texts x bands)."""
    bands = hashes.shape[1] // rows
    key = np.tile(np.arange(bands, dtype=_U), (len(hashes), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + hashes[:, k::rows][:, :bands].astype(_U))
    return key


def _keys(min_words: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for b in batches:
            texts = b["content"].to_pylist()
            tokens = [words(t) for t in texts]
            keep = [i for i, t in enumerate(tokens) if len(t) >= max(min_words, shingle)]
            if not keep:
                continue
            _, h1, h2 = content_hashes([texts[i] for i in keep])
            members, sizes = shingler([tokens[i] for i in keep])
            with np.errstate(over="ignore"):
                sets = np.add.reduceat(mix(members), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(keep)), *(pa.array(x.view(np.int64)) for x in (h1, h2, sets))], ["id", "h1", "h2", "shingles"])

    return run


def _prints(bands: int, rows: int, shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for b in batches:
            if not b.num_rows:
                continue
            members, sizes = shingler([words(t) for t in b["content"].to_pylist()])
            hashes = minhashes(members, sizes, bands * rows, seed)
            keys, prints = band_keys(hashes, rows), two_bits(hashes)
            offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
            fields = [pa.array(prints[:, i].copy().view(np.int64)) for i in range(prints.shape[1])]
            yield pa.RecordBatch.from_arrays([b["vid"], *fields, listed], ["vid", *(f"p{i}" for i in range(len(fields))), "bands"])

    return run


def _similar(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b["content_a"].to_pylist(), b["content_b"].to_pylist())):
                u, v = words(x), words(y)
                s, t = set(zip(*(u[k:] for k in range(shingle)))), set(zip(*(v[k:] for k in range(shingle))))
                shared = len(s & t)
                if shared >= least * (len(s) + len(t) - shared):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b["rep_a"].take(at), b["rep_b"].take(at)], ["rep_a", "rep_b"])

    return run


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two-bit symbols in which each fingerprint of ``a`` differs from each of ``b`` (rows x words both)."""
    odd, total = _U(0x5555555555555555), np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, None, k] ^ b[None, :, k]
        total += np.bitwise_count((x | x >> _U(1)) & odd)
    return total


def close_in_band(vid: np.ndarray, prints: np.ndarray, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller vid, larger vid) of one band whose fingerprints differ in at most ``most`` symbols.

    All rows are compared in tiles, however many there are. ``side`` marks the second of two parts of a split band, of
    which only pairs across are wanted; a part that meets itself has no second one.
    """
    rows, others = (np.arange(len(vid)), np.arange(len(vid))) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    out = []
    for i in range(0, len(rows), TILE):
        for j in range(i if side is None else 0, len(others), TILE):
            r, o = rows[i : i + TILE], others[j : j + TILE]
            x, y = np.nonzero(_differing(prints[r], prints[o]) <= most)
            a, b = vid[r[x]], vid[o[y]]
            keep = a < b if side is None and i == j else a != b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _met(words_: int, most: int):
    """Close pairs of rows that come sorted by where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: np.ndarray | None = None  # rows of a band that may go on in the next batch

        def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            starts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]])
            sizes = np.diff(starts)
            found = []
            # Groups of two, most of all, are compared all at once.
            two = starts[:-1][sizes == 2]
            if len(two):
                x, y = rows[two], rows[two + 1]
                bits = x[:, 3:].view(_U) ^ y[:, 3:].view(_U)
                apart = np.bitwise_count((bits | bits >> _U(1)) & _U(0x5555555555555555)).sum(1, dtype=np.int64)
                keep = (apart <= most) & (x[:, 2] != y[:, 2])
                found.append((np.minimum(x[keep, 2], y[keep, 2]), np.maximum(x[keep, 2], y[keep, 2])))
            for k in np.flatnonzero(sizes > 2):
                own = rows[starts[k] : starts[k + 1]]
                side = own[:, 1] > 0
                found.append(close_in_band(own[:, 2], own[:, 3:].view(_U), most, side if side.any() else None))
            a, b = (np.concatenate(f) for f in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            if len(a):
                both = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["vid_a", "vid_b"])

        for b in batches:
            rows = np.stack([np.asarray(b[c]).astype(np.int64) for c in ("meeting", "side", "vid", *(f"p{i}" for i in range(words_)))], axis=1)
            if left is not None:
                rows = np.concatenate([left, rows])
            if not len(rows):
                continue
            last = int(np.argmax(rows[:, 0] == rows[-1, 0]))
            yield from pairs(rows[:last])
            left = rows[last:]
        if left is not None:
            yield from pairs(left)

    return run


def most_differing(count: int, least: float) -> int:
    """Symbols that may differ at the least similarity, with slack for chance. A symbol agrees with J + (1 - J) / 4."""
    differ = 0.75 * (1 - least)
    return int(count * differ + SLACK * (count * differ * (1 - differ)) ** 0.5) + 1


def classes(rows: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """``rows``: id, content. Returns id, rep, h1, h2, n: the representative of all rows with the same copy hash and shingles."""
    usable = rows.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content")
    keyed = cut(usable.mapInArrow(_keys(min_words, shingle), "id string, h1 long, h2 long, shingles long"))
    keys = ["h1", "h2", "shingles"]
    groups = keyed.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    return cut(join_by_key(keyed, groups, keys, "n", F.col("id")).select("id", "rep", "h1", "h2", "n").distinct())


def class_pairs(rows: DataFrame, members: DataFrame, least: float = LEAST, bands: int = BANDS, band_rows: int = ROWS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """rep_a < rep_b: verified pairs of representatives that aren't copies of each other."""
    usable = rows.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content")
    reps = members.where("id = rep").select("id", "h1", "h2")
    texts = usable.join(reps, "id").groupBy("id", "h1", "h2").agg(F.min("content").alias("content"))
    texts = cut(texts.withColumn("vid", F.monotonically_increasing_id()))
    n = -(-bands * band_rows // 32)
    schema = "vid long, " + "".join(f"p{i} long, " for i in range(n)) + "bands array<long>"
    fields = ["vid", *(f"p{i}" for i in range(n))]
    printed = lambda rows: rows.select("vid", "content").mapInArrow(_prints(bands, band_rows, shingle, seed), schema)
    banded = printed(texts).select(*fields, F.explode("bands").alias("band"))
    # Bands that many rows share are cut into parts of about HOT_BAND rows, and every two parts meet in a group of their
    # own. Which bands these are is told by a hashed share of the rows; it decides who does the work, not what comes out.
    share = texts.where(F.pmod(F.xxhash64("vid"), F.lit(HOT_SHARE)) == 0)
    hot = printed(share).select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_SHARE >= HOT_BAND).orderBy(F.desc("_n")).limit(MOST_HOT).select("band", (F.floor(F.col("_n") * HOT_SHARE / HOT_BAND) + 1).cast("int").alias("_parts"))
    own = F.pmod(F.xxhash64("vid", F.lit(1)), F.coalesce("_parts", F.lit(1))).cast("int")
    # A group is the band, or a hash of the band and two of its parts; ``side`` marks the rows of the second part.
    two = lambda o: F.struct(F.xxhash64("band", F.least("own", o), F.greatest("own", o)).alias("meeting"), (F.col("own") > o).alias("side"))
    meets = F.when(F.col("_parts") > 1, F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), two)).otherwise(F.array(F.struct(F.col("band").alias("meeting"), F.lit(False).alias("side"))))
    dealt = banded.join(F.broadcast(hot), "band", "left").withColumn("own", own).select(*fields, F.explode(meets).alias("m")).select("m.meeting", "m.side", *fields)
    met = dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_met(n, most_differing(bands * band_rows, least)), "vid_a long, vid_b long")
    pairs = cut(met.distinct())
    of = lambda s: texts.select(F.col("vid").alias(f"vid_{s}"), F.col("id").alias(f"rep_{s}"), F.col("h1").alias(f"h1_{s}"), F.col("h2").alias(f"h2_{s}"), F.col("content").alias(f"content_{s}"))
    both = pairs.join(of("a"), "vid_a").join(of("b"), "vid_b").where("h1_a <> h1_b or h2_a <> h2_b")
    return both.select("rep_a", "rep_b", "content_a", "content_b").mapInArrow(_similar(shingle, least), "rep_a string, rep_b string")


def near_copies(rows: DataFrame, least: float = LEAST, min_words: int = MIN_WORDS, **settings) -> DataFrame:
    """id_a < id_b: every pair of rows whose similarity is at least ``least`` and that aren't copies of each other."""
    members = classes(rows, min_words)
    pairs = class_pairs(rows, members, least, **settings)
    # Classes of many copies are salted: their members are dealt out, and their pairs are repeated for each part.
    size = members.where("id = rep").select("rep", "n")
    part = F.when(F.col("n") > HOT_ROWS, F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(0).cast("int")

    def expanded(some: DataFrame, of: str, name: str) -> DataFrame:
        parts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT_ROWS, PARTS - 1).otherwise(0))).alias("part")
        spread = some.join(size.withColumnRenamed("rep", of), of).select(*some.columns, parts)
        return spread.join(members.select(F.col("rep").alias(of), F.col("id").alias(name), part.alias("part")), [of, "part"]).drop(of, "part")

    both = expanded(expanded(pairs, "rep_a", "x"), "rep_b", "y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_copy_groups(rows: DataFrame, least: float = LEAST, min_words: int = MIN_WORDS, **settings) -> DataFrame:
    """One row per text of at least ``min_words`` words: id, group_id (smallest id of its group), links.

    Groups are connected components over near copies and copies; links counts the near copies of the row's text
    among different texts.
    """
    members = classes(rows, min_words)
    pairs = cut(class_pairs(rows, members, least, **settings))
    copies = members.groupBy("h1", "h2").agg(F.min("rep").alias("first"))
    same = members.select("rep", "h1", "h2").distinct().join(copies, ["h1", "h2"]).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    found = components(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).union(same))
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    rows_ = members.select("id", "rep").join(found.withColumnRenamed("id", "rep"), "rep").join(links, "rep", "left")
    groups = rows_.groupBy("component").agg(F.min("id").alias("group_id"))
    return rows_.join(groups, "component").select("id", "group_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
