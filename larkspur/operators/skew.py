"""Joins of many rows with one row per key when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
SALTS = 64
#: Hot keys at most; any other key then has no more than rows / MOST_HOT rows.
MOST_HOT = 10_000


def join_by_key(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread_by: Column, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, ``count`` = rows of the key).

    Keys with more than ``hot_rows`` rows are salted: their group row is repeated ``salts`` times and their rows
    are dealt out by a hash of ``spread_by``. The list of the most frequent hot keys is broadcast; it holds at most
    MOST_HOT keys, whatever the size of the tables. Keys that are null match nothing.
    """
    hot = groups.where(F.col(count) > hot_rows).orderBy(F.desc(count)).limit(MOST_HOT).select(*keys, F.lit(True).alias("_hot"))
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > hot_rows, salts - 1).otherwise(0))))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    return dealt.join(salted, [*keys, "_salt"]).drop("_salt")
