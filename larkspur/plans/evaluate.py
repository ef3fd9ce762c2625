"""Offline evaluation: golden cases through the retrieval plan, judged by metrics, as one row per case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.models import text_model
from larkspur.operators import evaluation, routing, search
from larkspur.plans import requests
from larkspur.session import cut


def records(cases: DataFrame, roles: list[str], docs: DataFrame, vectors: DataFrame, slots: requests.Models, judge: Callable[[str], Column], run_id: str, threshold: float = search.THRESHOLD) -> DataFrame:
    """``cases``: id, input, expected_output, source_documents, source_url. One record per case, in the order of their ids.

    ``judge`` gives the score column of a metric by its name, over the columns query, response, passages and
    expected_output. A case without an answer or without readable passages has failed and carries the error instead of
    metrics. Cases skip signature, memory and cache.
    """
    compose = slots.compose or text_model()
    asked = cases.select("id", "expected_output", "source_documents", "source_url", F.col("input").alias("raw"), F.sha1(F.concat_ws("|", F.lit(run_id), "id")).alias("query_id"))
    routed = cut(asked.join(slots.classify(asked.select("query_id", F.col("raw").alias("query"))), "query_id").withColumn("route", routing.route_intent(F.col("intent"))).withColumn("roles", F.array(*map(F.lit, roles))))
    found = requests.retrieved(routed.where("route = 'knowledge'").select("query_id", "query", "roles"), docs, vectors, slots, threshold)
    whole = routed.join(found, "query_id", "left").withColumn("generated", compose(F.concat_ws("\n\n", "query", "context")))
    answered = whole.withColumn("response", F.when(F.size("passages") > 0, routing.synthesized(F.size("passages"), F.col("context"), F.col("generated"))).otherwise(routing.fallback(F.when(F.col("route") == "knowledge", "low_relevance"), F.col("intent"), F.col("generated"))))
    error = F.when(F.trim("response") == "", "the response is empty").when(F.col("context").isNull(), "no passage was retrieved")
    judged = cut(answered.withColumn("error", error))
    metrics = F.when(F.col("error").isNull(), evaluation.metric_rows(F.coalesce(F.trim("expected_output"), F.lit("")) != "", judge))
    numbered = judged.join(evaluation.numbered(cases, "id"), "id")
    return numbered.select(F.lit(run_id).alias("run_id"), "query_id", "case_number", F.col("id").alias("golden_case_id"), "query", "expected_output", "source_documents", "source_url", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", "intent", "response", "score", "passages", metrics.alias("metrics"), F.current_timestamp().alias("created_at"))


def run(stored: DataFrame, new: DataFrame, save: Callable[[DataFrame], None]) -> None:
    """Saves the records with those stored before, replacing equal (run_id, query_id); then failed cases are an error."""
    new = cut(new)
    save(evaluation.upsert(stored, new, ["run_id", "query_id"], ["created_at"]))
    bad = new.where("status = 'failed'").orderBy("case_number").first()
    if bad:
        raise RuntimeError(f"case {bad['case_number']} failed: {bad['error']}")
