"""Telemetry aggregates over metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS = 300
# Histogram bounds in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
FAILURES = ("error", "timeout", "rate_limited")
#: Accuracy of the sketch that brackets an exact quantile.
ACCURACY = 20_000


def window_start(ts: str = "ts", seconds: int = WINDOW_SECONDS) -> Column:
    """Start of the tumbling window that holds a time stamp."""
    return F.window(ts, f"{seconds} seconds")["start"].alias("window_start")


def counters(points: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Number and sum by attributes."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def token_counters(points: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """Token sums; only positive counts are recorded."""
    return points.where(F.col(tokens) > 0).groupBy(*by).agg(F.sum(tokens).cast("long").alias("tokens"))


def hit_ratio(points: DataFrame, hit: Column, miss: Column, ts: str = "ts") -> DataFrame:
    """Hits among hits and misses by window; other outcomes don't count."""
    return points.where(hit | miss).groupBy(window_start(ts)).agg(F.count("*").alias("n"), (F.sum(F.when(hit, 1.0).otherwise(0.0)) / F.count("*")).alias("ratio"))


def rate(points: DataFrame, by: list[str], ts: str = "ts", amount: Column | None = None, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per-second rate by window and attributes: of points, or of an amount."""
    total = F.count("*") if amount is None else F.sum(amount)
    return points.groupBy(window_start(ts, seconds), *by).agg((total / float(seconds)).alias("per_second"))


def quantile(points: DataFrame, by: list[str], value: str, q: float, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantile of durations by group, interpolated between ranks; negative values count as 0, nulls not at all.

    A sketch of bounded size brackets the rank, to 2 / accuracy of the rows on either side; only values inside the
    bracket are counted one by one, those below it by a single number. No group is ever gathered in one buffer.
    """
    x = F.greatest(F.lit(0.0), F.col(value).cast("double"))
    rows = points.where(F.col(value).isNotNull()).select(*by, x.alias("_x"))
    near = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", near, accuracy).alias("_b"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    few = F.col("_n") <= 4 * accuracy  # all values of such a group may be counted, and its ranks lie close together
    low = F.when(few | F.lit(near[0] == 0), F.col("_low")).otherwise(F.col("_b")[0])
    high = F.when(few | F.lit(near[1] == 1), F.col("_high")).otherwise(F.col("_b")[1])
    brackets = sketch.select(*(F.col(c).alias(f"_{c}") for c in by), "_n", low.alias("_lo"), high.alias("_hi"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = rows.join(brackets, same).where(F.col("_x") <= F.col("_hi")).select(*by, "_n", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v"))
    counts = inside.groupBy(*by, "_n", "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(w))
    rank = F.lit(q) * (F.col("_n") - 1)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    ends = ranked.groupBy(*by, "_n").agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_z"))
    return ends.select(*by, (F.col("_a") + (F.col("_z") - F.col("_a")) * (rank - F.floor(rank))).alias("quantile"))


def p95(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact 95th percentile of durations."""
    return quantile(points, by, value, 0.95).withColumnRenamed("quantile", "p95")


def histogram(points: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Number of points up to each bound (``le``), cumulative, with "inf" as the last. One pass, one row per bound."""
    clamped = F.greatest(F.lit(0.0), F.col(value))
    sums = [F.sum(F.when(clamped <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = points.groupBy(*by).agg(*sums, F.count("*").alias(f"b{len(bounds)}"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").cast("long").alias("n")) for i, b in enumerate((*bounds, "inf"))))
    return wide.select(*by, F.explode(rows).alias("e")).select(*by, "e.le", "e.n")


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile interpolated from cumulative buckets, as dashboards compute it."""
    bound = F.when(F.col("le") == "inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    rows = buckets.select(*by, bound.alias("b"), F.col("n").cast("double").alias("c"))
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("s"))
    total = F.element_at("s", -1)["c"]
    at = F.array_position(F.transform("s", lambda x: x["c"] >= q * total), True).cast("int")
    here, before = F.element_at("s", at), F.try_element_at("s", at - 1)
    low_b, low_c = F.when(at > 1, before["b"]).otherwise(0.0), F.when(at > 1, before["c"]).otherwise(0.0)
    value = F.when(here["b"] == float("inf"), low_b).otherwise(low_b + (here["b"] - low_b) * (q * total - low_c) / (here["c"] - low_c))
    return listed.select(*by, F.when(total > 0, value).alias("quantile"))


def page_stats(elements: DataFrame) -> DataFrame:
    """Characters by document and page; lines are joined by one character. Only lengths are shuffled."""
    return elements.groupBy("doc_id", "page").agg((F.sum(F.length("text")) + F.count("text") - 1).cast("long").alias("characters"))


def heading_levels(spans: DataFrame, factor: float = 1.2, top: float = 1.35, longest: int = 200) -> DataFrame:
    """Lines (doc_id, ord, text, size) with heading_level (1, 2 or null) from the document's body size, the upper median.

    The median comes from counts by size, so a document of any length is a few rows.
    """
    counts = spans.where(F.col("size") > 0).groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("size")
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    body = ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("doc_id").agg(F.min("size").alias("body_size"))
    large = spans.join(body, "doc_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(11.0)))
    text = F.trim("text")
    is_head = (F.col("size") >= factor * F.col("body_size")) & (F.length(text) <= longest) & ~text.rlike(r"[,.;:?!]$")
    return large.withColumn("heading_level", F.when(is_head, F.when(F.col("size") >= top * F.col("body_size"), 1).otherwise(2)))


def highest_offsets(messages: DataFrame) -> DataFrame:
    """Offset to commit for each partition of a topic: one beyond the highest."""
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))
