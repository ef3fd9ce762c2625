"""Answer cache with a fixed time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import chains

TTL_SECONDS = 900


def _fold(key: str, order: str, ttl: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, written = None, 0.0
        for b in batches:
            hits = []
            for k, piece, s in zip(b["_k"].to_pylist(), b["_piece"].to_pylist(), b["_start"].to_pylist()):
                if (k, piece) != of:
                    of, written = (k, piece), float("-inf")
                hit = s - written < ttl
                hits.append(hit)
                if not hit:
                    written = s
            yield pa.RecordBatch.from_arrays([b["_k"], b["_o"], pa.array(hits, pa.bool_())], [key, order, "hit"])

    return run


def lookups(events: DataFrame, key: str, ts: str, order: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Each lookup with ``hit``: whether an entry was written less than ``ttl`` seconds before. A miss writes, a hit doesn't
    refresh. Rows with a null key or time are left out.

    Whether a lookup writes depends on the one before, so a key's lookups form a chain; no entry reaches across a pause
    of ``ttl``, so chains are cut there and the pieces are dealt to the tasks.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_o"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_start"))
    dealt = chains.pieces(rows.withColumn("_end", F.col("_start") + ttl), ttl)
    types = dict(events.dtypes)
    return dealt.mapInArrow(_fold(key, order, ttl), f"`{key}` {types[key]}, `{order}` {types[order]}, hit boolean")


def eligible(should_refine: Column) -> Column:
    """Only questions that stand on their own are looked up and stored."""
    return ~F.coalesce(should_refine, F.lit(False))


def usable(response: Column, retrieval_passed: Column) -> Column:
    """Whether a cached answer counts as a hit."""
    return (F.coalesce(F.trim(response), F.lit("")) != "") & F.coalesce(retrieval_passed, F.lit(False))


def fresh(issued_at: Column, now: Column, seconds: int = 60) -> Column:
    """Whether a time stamp lies within ``seconds`` of now, either way."""
    return F.coalesce(F.abs(now - issued_at) <= seconds, F.lit(False))
