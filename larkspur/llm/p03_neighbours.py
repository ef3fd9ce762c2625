"""Problem 3: the most similar vectors of every vector, by overlapping cells.

Every usable vector is scaled to length 1; equal vectors are searched once. A hashed sample of the vectors are centres,
so there are more of them where vectors are dense, and every vector goes to the cells of its nearest few centres. All
vectors of a cell are compared in blocks (exact cosine), whatever their number; the best k of each cell are merged and
the best k of all are kept. Only pairs without a common cell are missed.

Defined results: a vector that is null, of another length, all zero or holding NaN or infinity is left out, as is
a row with a null id. Repeated rows count once (the smallest by content if an id comes with several vectors). Ties
of cosine go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators.skew import join_by_key
from larkspur.session import cut

DIMENSIONS = 64
K = 5
#: Vectors a centre, cells a vector, and centres that the driver takes at most (beyond these, cells grow).
PER_CENTRE = 256
CELLS = 6
MOST_CENTRES = 65_536
#: Cosine that a comparison in single precision allows for.
ROUGH = 2e-6
TILE = 512
#: Bytes that a comparing task should read, and of a row beside its vector.
TASK_BYTES = 8 << 20
ROW_BYTES = 32
SEED = 20240607


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows x axes, each below 2**bits), all rows at once."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curves: int, axes: int, bits: int, seed: int) -> np.ndarray:
    """Keys of unit vectors on each curve (rows x curves). A curve has its own random directions and shift."""
    dims = unit.shape[1]
    out = np.empty((len(unit), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng((seed, c))
        basis = np.linalg.qr(rng.standard_normal((dims, max(axes, 1))))[0][:, :axes]
        spread = (unit @ basis) * np.sqrt(dims)  # about standard normal for vectors without a favoured direction
        level = 1 / (1 + np.exp(-1.702 * np.clip(spread, -6, 6)))  # near the normal distribution function: even cells
        shifted = (level + rng.random(axes)) / 2
        out[:, c] = hilbert_keys(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)
    return out


def _floats(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dims)


def _unit(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _floats(b["v"], dims).astype(np.float64)
            size = np.sqrt((v * v).sum(1))
            keep = np.isfinite(size) & (size > 0)
            unit = (v[keep] / size[keep, None]).astype(np.float32)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b["collection"].take(at), b["id"].take(at), pa.array([r.tobytes() for r in unit], pa.binary())], ["collection", "id", "unit"])

    return run


def _in_cells(dims: int, centres: dict[str | None, np.ndarray], cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.array(b["collection"].to_pylist(), object)
            for collection in set(of):
                rows = np.flatnonzero(of == collection)
                at = pa.array(rows)
                own = centres.get(collection)
                near = np.zeros((len(rows), 1), np.int64)
                if own is not None and len(own) > cells:
                    unit = _units(b["unit"].take(at), dims)
                    step = max(1, (1 << 24) // len(own))
                    near = np.concatenate([np.argpartition(-(unit[i : i + step] @ own.T), cells - 1, axis=1)[:, :cells] for i in range(0, len(rows), step)])
                for c in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([b["collection"].take(at), pa.array(near[:, c].astype(np.int32)), b["vid"].take(at), b["unit"].take(at)], ["collection", "cell", "vid", "unit"])

    return run


def _units(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def best_in_cell(vid: np.ndarray, unit: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vid, other, cosine) of the ``k`` most similar others of each row, from cosine ``least``; ties go to the smaller vid."""
    out = []
    for i in range(0, len(vid), TILE):
        hi = min(len(vid), i + TILE)
        near = unit[i:hi] @ unit.T
        near[np.arange(hi - i), np.arange(i, hi)] = -2
        wanted = near >= least - ROUGH
        if not wanted.any():
            continue
        if near.shape[1] > k:
            floor = -np.partition(-near, k - 1, axis=1)[:, k - 1]
            wanted &= near >= floor[:, None] - ROUGH
        wanted[np.arange(hi - i), np.arange(i, hi)] = False
        r, c = np.nonzero(wanted)
        step = 1 << 18
        exact = np.concatenate([(unit[r[j : j + step] + i].astype(np.float64) * unit[c[j : j + step]]).sum(1) for j in range(0, max(len(r), 1), step)])
        order = np.lexsort((vid[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = (place < k) & (exact >= least)
        out.append((vid[r[keep] + i], vid[c[keep]], exact[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _compared(dims: int, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, vids, units = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if vids:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_in_cell(np.concatenate(vids), np.concatenate(units), k, least)], ["vid", "other", "cosine"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b["collection"].to_pylist(), b["cell"].to_pylist()))
            vid, unit = np.asarray(b["vid"]), _units(b["unit"], dims)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(starts, starts[1:]):
                if keys[s] != of:
                    yield from flush()
                    of, vids, units = keys[s], [], []
                vids.append(vid[s:e])
                units.append(unit[s:e])
        yield from flush()

    return run


def _centres(base: DataFrame, dims: int, per: int, seed: int) -> tuple[dict[str | None, np.ndarray], int]:
    """The centres of each collection (vectors whose hashed id is a multiple, so that runs repeat) and the number of vectors."""
    total = base.count()
    per = max(per, -(-total // MOST_CENTRES))
    chosen: dict[str | None, list[bytes]] = {}
    for r in base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(per)) == 0).select("collection", "unit").orderBy("collection", "unit").collect():
        chosen.setdefault(r["collection"], []).append(r["unit"])
    return {c: np.frombuffer(b"".join(u), np.float32).reshape(-1, dims) for c, u in chosen.items()}, total


def nearest(vectors: DataFrame, k: int = K, min_cosine: float = -1.0, dims: int = DIMENSIONS, per: int = PER_CENTRE, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """``vectors``: collection, id, v (array of float). Returns collection, id, neighbour, cosine, rank (1 to k).

    Neighbours come from the same collection; only those of at least ``min_cosine`` are looked for. A cell gives each of
    its vectors at most k partners, so what is merged is at most k * cells rows a vector. Of equal vectors the first k + 1
    ids stand for all, which is all that any row can need of them.
    """
    usable = vectors.where(F.col("id").isNotNull() & (F.size("v") == dims)).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("collection", "id", "v")
    unit = usable.mapInArrow(_unit(dims), "collection string, id string, unit binary")
    # The order of vid is that of the ids, so ties can be told by it.
    base = cut(unit.groupBy("collection", "id").agg(F.min("unit").alias("unit")).orderBy("collection", "id").withColumn("vid", F.monotonically_increasing_id()))
    distinct = cut(base.groupBy("collection", "unit").agg(F.min_by("id", "vid").alias("id"), F.min("vid").alias("vid"), F.count("*").alias("n")))
    centres, total = _centres(distinct, dims, per, seed)
    in_cells = distinct.select("collection", "vid", "unit").mapInArrow(_in_cells(dims, centres, cells), "collection string, cell int, vid long, unit binary")
    # As many tasks as the copies of the vectors need, however many there are: a task's share doesn't grow with the table.
    parts = max(base.sparkSession.sparkContext.defaultParallelism, -(-total * cells * (4 * dims + ROW_BYTES) // TASK_BYTES))
    compared = in_cells.repartition(parts, "collection", "cell").sortWithinPartitions("collection", "cell").mapInArrow(_compared(dims, k, min_cosine), "vid long, other long, cosine double")
    by_cosine = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("cosine"), "other"))
    close = compared.repartition("vid").groupBy("vid", "other").agg(F.max("cosine").alias("cosine")).withColumn("rank", by_cosine).where(F.col("rank") <= k).drop("rank")
    # Ids of equal vectors: the first k + 1 of each, and one row for each vector that others share.
    group = F.coalesce(F.concat(F.lit("of "), "collection"), F.lit("none")).alias("of")
    shared = distinct.where("n > 1").select(group, "unit", F.col("vid").alias("first"), "n")
    members = cut(join_by_key(base.select(group, "id", "vid", "unit"), shared, ["of", "unit"], "n", F.col("vid")).select("first", "id", "unit"))
    firsts = members.withColumn("place", F.row_number().over(Window.partitionBy("first").orderBy("id"))).where(F.col("place") <= k + 1)
    of_shared = firsts.select("first", F.col("id").alias("neighbour"))
    equal = firsts.select("first", F.col("id").alias("neighbour"), "unit").mapInArrow(_self_cosine(dims), "vid long, neighbour string, cosine double").where(F.col("cosine") >= min_cosine)
    names = distinct.select("collection", "vid", "id", "n")
    single = close.join(names.where("n = 1").select(F.col("vid").alias("other"), F.col("id").alias("neighbour")), "other").select("vid", "neighbour", "cosine")
    several = close.join(of_shared.withColumnRenamed("first", "other"), "other").select("vid", "neighbour", "cosine")
    lists = single.unionByName(several).unionByName(equal).withColumn("rank", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k + 1)
    listed = lists.join(names, "vid")
    alone = listed.where("n = 1").where(F.col("rank") <= k).select("collection", "id", "neighbour", "cosine", "rank")
    # Each of several equal vectors takes the first k of the list that aren't itself.
    kept = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "cosine")))
    of_group = listed.where("n > 1").groupBy("collection", "vid", "n").agg(kept.alias("kept")).withColumnRenamed("vid", "first")
    other = join_by_key(members.select("first", "id"), of_group, ["first"], "n", F.col("id")).select("collection", "id", F.posexplode(F.slice(F.filter("kept", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("at", "e"))
    return alone.unionByName(other.select("collection", "id", "e.neighbour", "e.cosine", (F.col("at") + 1).cast("int").alias("rank")))


def _self_cosine(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _units(b["unit"], dims).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b["first"], b["neighbour"], pa.array((x * x).sum(1))], ["vid", "neighbour", "cosine"])

    return run


def close_pairs(vectors: DataFrame, k: int = K, min_cosine: float = 0.9, **settings) -> DataFrame:
    """Pairs (collection, id_a < id_b) of which one is among the k most similar of the other and whose cosine is at least ``min_cosine``."""
    near = nearest(vectors, k, min_cosine, **settings)
    return near.select("collection", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
