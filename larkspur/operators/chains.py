"""Chains of intervals, cut into pieces that don't touch, so that a long chain isn't one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pieces(rows: DataFrame, slice_seconds: float) -> DataFrame:
    """``rows``: _k (key), _o (order among equal starts), _start and _end in seconds. Returns _k, _o, _start, _end, _piece.

    An interval that begins after all earlier ones of its key have ended depends on none of them. Such places are looked
    for among slices of time: starts and ends are aggregated by slice before any window, so a key costs one row per
    occupied slice there. Pieces, not keys, are dealt to the tasks and come in order; one without a cut is one task's
    work, in one pass.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col("_start") / slice_seconds))
    spans = sliced.groupBy("_k", "_slice").agg(F.min("_start").alias("low"), F.max("_end").alias("high"))
    w = Window.partitionBy("_k").orderBy("_slice")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("_cut", F.when(F.col("low") < before, 0).otherwise(1)).select("_k", "_slice", F.sum("_cut").over(w).alias("_piece"))
    dealt = sliced.join(cut, ["_k", "_slice"]).repartition("_k", "_piece").sortWithinPartitions("_k", "_piece", "_start", "_o")
    return dealt.select("_k", "_o", "_start", "_end", "_piece")
