"""Evaluation of retrieval against golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the metrics that every case has, and of those that need a reference answer.
METRICS = ("Faithfulness", "Answer Relevancy", "Contextual Relevancy")
REFERENCE_METRICS = ("Contextual Precision", "Contextual Recall", "Answer Correctness [GEval]")


def recall_at_k(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``hits``: query_id, item, rank; ``truth``: query_id, item. Share of the true items among the first k, per question."""
    found = truth.join(hits.where(F.col("rank") <= k).select("query_id", "item").distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    size = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    return size.join(found, "query_id", "left").select("query_id", "relevant", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Replace-upsert: of rows with equal keys the last in order stays."""
    both = stored.unionByName(new, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return both.withColumn("_last", last).where("_last = 1").drop("_last")


def numbered(cases: DataFrame, id: str) -> DataFrame:
    """Ids of a case file with ``case_number`` in their order. A file of cases is small; the numbers need one task."""
    return cases.select(id).distinct().withColumn("case_number", F.row_number().over(Window.orderBy(id)))


def latest_results(results: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The report of the last ``n`` results (a top-n by time)."""
    return results.select(*columns).orderBy(F.desc("created_at"), *columns).limit(n)


def metric_rows(has_reference: Column, judge=None) -> Column:
    """Metrics of a case: those that need a reference are skipped without one. ``judge``: name to score column."""
    score = judge or (lambda name: F.lit(None).cast("double"))
    rows = [F.struct(F.lit(m).alias("name"), F.lit("completed").alias("status"), score(m).alias("score")) for m in METRICS]
    rows += [F.struct(F.lit(m).alias("name"), F.when(has_reference, "completed").otherwise("skipped").alias("status"), F.when(has_reference, score(m)).alias("score")) for m in REFERENCE_METRICS]
    return F.array(*rows)
