"""The chat service as a stream: signed requests in, responses out, memory and cache kept in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import crypto
from larkspur.operators import memory, policy, search
from larkspur.plans import requests
from larkspur.session import cut
from larkspur.sources import topics
from larkspur.streaming.pipelines import run_stage

REQUESTS, RESPONSES = "chat-requests", "chat-responses"
REQUEST = "session_id string, connection_id string, message string, user_id string, roles array<string>, allowed_roles array<string>, issued_at long, signature string"
RESPONSE = f"session_id string, connection_id string, query_id string, user_id string, response string, intent string, sources {requests.SOURCES}"


def send(rows: DataFrame, folder: str, secret: str, headers: Column | None = None) -> None:
    """Signs requests (the fields of REQUEST but the signature) and produces them, keyed by session."""
    signed = rows.withColumn("signature", crypto.sign(crypto.request_body(), secret))
    topics.produce(signed.select(*(f.split()[0] for f in REQUEST.split(", "))), folder, REQUESTS, "session_id", headers)


def _table(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """What earlier batches have stored; a repeated batch doesn't see what it wrote before."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < number)
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def stores(spark: SparkSession, store: str, number: int = 1 << 62) -> requests.Stores:
    """The tables before a batch; of a session's summaries the last one counts."""
    sessions = memory.latest(_table(spark, f"{store}/sessions", requests.SESSION, number), list(memory.KEYS), ["batch"])
    return requests.Stores(_table(spark, f"{store}/entries", requests.ENTRY, number).drop("batch"), _table(spark, f"{store}/turns", requests.TURN, number).drop("batch"), sessions.select(*memory.KEYS, "state"))


def serve(
    spark: SparkSession, folder: str, checkpoint: str, store: str, secret: str, known_roles: list[str], expected: Column, scope: Column, docs: DataFrame, vectors: DataFrame,
    slots: requests.Models, key: Callable[[Column, Column], Column], now: Column | None = None, threshold: float = search.THRESHOLD,
) -> int:
    """Answers all requests that are there; returns the batches run.

    At least once: a batch is committed after its responses are produced; its table rows go to a folder of its own, so a
    repeated batch overwrites them. Requests that aren't rightly signed, fresh and permitted get a refusal. The
    passages are tokenised once for all batches.
    """
    stored = search.index(docs)
    now = F.unix_timestamp() if now is None else now

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.from_json("value", REQUEST).alias("r"), "headers").select("r.*", "headers")
        judged = cut(requests.admitted(rows, secret, now, known_roles, expected))
        accepted = judged.where("reject_reason is null").dropDuplicates(["query_id"]).withColumn("scope_id", scope)
        answers = requests.answer(accepted, docs, vectors, stores(spark, store, number), slots, key, now, threshold, stored)
        for name, table in (("entries", answers.entries), ("turns", answers.turns), ("sessions", answers.sessions)):
            table.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
        trace = judged.select("query_id", crypto.with_trace(crypto.trace_headers(F.col("headers"))).alias("_headers")).dropDuplicates(["query_id"])
        said = answers.responses.unionByName(requests.refused(judged)).join(trace, "query_id", "left")
        topics.produce(said, folder, RESPONSES, "session_id", F.col("_headers"))

    return run_stage(topics.consume(spark, folder, REQUESTS), write, checkpoint)


def responses(messages: DataFrame, live: DataFrame) -> DataFrame:
    """Messages of the response topic that go to the live connection of their session."""
    rows = messages.select(F.from_json("value", RESPONSE).alias("r")).select("r.*")
    return policy.deliverable(rows, live)
