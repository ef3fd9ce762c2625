"""Topics of keyed JSON messages: append-only folders of files, or a message broker.

Both forms have the same columns. The broker form uses format("kafka") and needs its connector on the class path; the
folder form needs nothing and serves tests and single machines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "topic string, partition int, offset long, key string, value string, headers array<struct<key:string,value:binary>>"
PARTITIONS = 3


def messages(rows: DataFrame, topic: str, key: str, partitions: int = PARTITIONS, headers: Column | None = None) -> DataFrame:
    """Rows as keyed JSON messages; equal keys go to the same partition. ``headers``: array of key and binary value.

    Columns whose names begin with an underscore are no part of the message.
    """
    value = F.to_json(F.struct(*(c for c in rows.columns if not c.startswith("_"))))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(partitions)).cast("int")
    none = F.lit(None).cast("array<struct<key:string,value:binary>>")
    return rows.select(F.lit(topic).alias("topic"), part.alias("partition"), F.lit(None).cast("long").alias("offset"), F.col(key).cast("string").alias("key"), value.alias("value"), (none if headers is None else headers).alias("headers"))


def produce(rows: DataFrame, folder: str, topic: str, key: str, headers: Column | None = None) -> None:
    """Appends messages; a failed write fails the call, and nothing of it shows."""
    messages(rows, topic, key, headers=headers).write.mode("append").json(f"{folder}/{topic}")


def consume(spark: SparkSession, folder: str, topic: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of a topic from its beginning."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(f"{folder}/{topic}")


@dataclass
class Broker:
    """Topics of a message broker. ``timeout``: seconds until an unconfirmed message fails the write, and with it the batch."""

    servers: str
    timeout: int = 30
    options: dict[str, str] = field(default_factory=dict)

    def _sink(self) -> dict[str, str]:
        # Every replica confirms, one request at a time keeps the order.
        delivery = {"kafka.acks": "all", "kafka.max.in.flight.requests.per.connection": "1", "kafka.delivery.timeout.ms": str(self.timeout * 1000), "kafka.request.timeout.ms": str(self.timeout * 1000), "kafka.linger.ms": "0"}
        return {"kafka.bootstrap.servers": self.servers, "includeHeaders": "true"} | delivery | self.options

    def produce(self, rows: DataFrame, topic: str, key: str, headers: Column | None = None) -> None:
        """Writes messages and returns once all are confirmed; a failure or time-out is an error."""
        sent = messages(rows, topic, key, headers=headers).select("topic", "key", "value", "headers")
        sent.write.format("kafka").options(**self._sink()).save()

    def consume(self, spark: SparkSession, topic: str, per_batch: int = 100_000) -> DataFrame:
        """Stream of a topic from its earliest message; the offsets are kept by the stream's checkpoint."""
        source = {"kafka.bootstrap.servers": self.servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_batch), "includeHeaders": "true"} | self.options
        raw = spark.readStream.format("kafka").options(**source).load()
        return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "headers")
