"""Streaming forms of the pipeline's stages. Each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.cache import TTL_SECONDS
from larkspur.operators.memory import HISTORY
from larkspur.sources import generations, topics


#: Watermark of the keyed states, and seconds after its last turn that a session is kept.
LATE = "10 minutes"
IDLE_SECONDS = 7 * 86_400


def run_stage(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs a stream over all that is there, then ends. A batch is committed after its write; returns the batches run."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])


def embed_phase(spark: SparkSession, folder: str, checkpoint: str, schema: str, embed, source: str = "chunks", target: str = "embedded_chunks") -> int:
    """Chunk messages to embedded messages, at least once. An invalid message or vector fails the batch uncommitted."""

    def write(batch: DataFrame, _: int) -> None:
        good, bad = generations.valid_messages(batch, schema)
        if not bad.isEmpty():
            first = bad.first()
            raise ValueError(f"message at {first['topic']}/{first['partition']}/{first['offset']}: {first['reason']}")
        rows = good.drop("topic", "partition", "offset").withColumn("embedding_vector", embed(F.col("content")))
        topics.produce(rows, folder, target, "chunk_id")

    return run_stage(topics.consume(spark, folder, source), write, checkpoint)


def index_phase(spark: SparkSession, folder: str, checkpoint: str, schema: str, store: str, source: str = "embedded_chunks") -> int:
    """Embedded messages into a staging folder, one subfolder a batch (a repeated batch overwrites its own).

    Returns the messages written; ``staged`` reads them as an upsert by chunk_id.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.from_json("value", schema + ", embedding_vector array<float>").alias("r"), F.lit(number).alias("batch")).select("r.*", "batch")
        rows = rows.withColumn("embedding_vector", F.when(F.size("embedding_vector") > 0, F.col("embedding_vector")).otherwise(F.from_json(F.raise_error(F.lit("missing embedding")).cast("string"), "array<float>")))
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")

    run_stage(topics.consume(spark, folder, source), write, checkpoint)
    try:
        return spark.read.parquet(store).count()
    except Exception as e:  # nothing was written
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise


def staged(spark: SparkSession, store: str) -> DataFrame:
    """The staged rows, the last message of each chunk_id."""
    return generations.last_by_key(spark.read.parquet(store), "chunk_id", ["batch"]).drop("batch")


def _until(state: GroupState, value: tuple, seconds: float) -> None:
    """Keeps a state until the watermark passes a time; what is past already isn't kept."""
    if seconds * 1000 > state.getCurrentWatermarkMs():
        state.update(value)
        state.setTimeoutTimestamp(int(seconds * 1000))
    elif state.exists:
        state.remove()


def sliding_history(stream: DataFrame, session: str, ts: str, order: str, value: str, n: int = HISTORY, idle: float = IDLE_SECONDS, late: str = LATE) -> DataFrame:
    """Running turn numbers and the last ``n`` values of each session, one row per turn, in the order of ``ts`` and ``order``.

    A session's state holds those values only and ends once the watermark is ``idle`` seconds past its last turn; a
    session that comes back after that starts anew. Turns later than the watermark are dropped.
    """
    out = f"{session} string, {order} long, turn_no long, history array<string>"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, history, last = state.get if state.exists else (0, [], 0.0)
        history = list(history)
        turns = pd.concat(parts).sort_values([ts, order])
        rows = []
        for t, o, v in turns[[ts, order, value]].itertuples(index=False):
            count, last = count + 1, max(last, t.timestamp())
            history = [v, *history][:n]
            rows.append((key[0], o, count, history))
        _until(state, (count, history, last), last + idle)
        yield pd.DataFrame(rows, columns=[session, order, "turn_no", "history"])

    rows = stream.withWatermark(ts, late)
    return rows.groupBy(session).applyInPandasWithState(step, out, "count long, history array<string>, last double", "append", GroupStateTimeout.EventTimeTimeout)


def ttl_hits(stream: DataFrame, key: str, ts: str, order: str, ttl: int = TTL_SECONDS, late: str = LATE) -> DataFrame:
    """Cache lookups with their outcome. The state of a key is the time of the last write, and it ends with the entry: once
    the watermark is ``ttl`` past it, no lookup that still counts can hit it."""
    out = f"{key} string, {order} long, hit boolean"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        written = state.get[0] if state.exists else None
        rows = []
        for t, o in pd.concat(parts).sort_values([ts, order])[[ts, order]].itertuples(index=False):
            s = t.timestamp()
            hit = written is not None and s - written < ttl
            written = written if hit else s
            rows.append((k[0], o, hit))
        _until(state, (written,), written + ttl)
        yield pd.DataFrame(rows, columns=[key, order, "hit"])

    rows = stream.withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(step, out, "written double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; the watermark bounds the state, rows later than that are dropped by definition."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
