"""Versioned tables with one live pointer, and idempotent upserts.

A collection is a folder of generations (parquet folders) and a pointer file. A generation is written completely and
checked before the pointer moves; the pointer moves by one rename, so readers see the old or the new generation. Old
ones stay. Paths go through Hadoop's file system, so object stores work where their connector renames.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "_LIVE"


def generation_name(base: str, now: datetime | None = None) -> str:
    return f"{base}-rebuild-{(now or datetime.now(timezone.utc)):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"


class Generations:
    """Generations of one collection. ``alias`` is the name of the live one, by default the base with _live."""

    def __init__(self, spark: SparkSession, root: str, base: str, alias: str | None = None):
        if not re.fullmatch(r"[a-z0-9_-]+", base):
            raise ValueError("a collection's name has lower-case letters, digits, _ and - only")
        self.spark, self.root, self.base, self.alias = spark, root.rstrip("/"), base, alias or f"{base}_live"
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def location(self, generation: str) -> str:
        return f"{self.root}/{generation}"

    def _pointer(self, base: str) -> str | None:
        """What a pointer file names."""
        pointer = self._path(f"{self.root}/{POINTER}-{base}")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def live(self) -> str | None:
        """Name of the live generation: the pointer's; else what the plain name stands for, which may be a pointer of
        its own (to one generation only) or a folder; else the first generation, if it exists."""
        if named := self._pointer(self.alias):
            return named
        if self._fs.exists(self._path(self.location(self.alias))):
            raise ValueError(f"{self.alias} is a generation of its own, so it can't be the name of the live one")
        if older := self._pointer(self.base):
            targets = older.split()
            if len(targets) != 1:
                raise ValueError(f"{self.base} stands for several generations: {', '.join(targets)}")
            return targets[0]
        for name in (self.base, f"{self.base}-000001"):
            if self._fs.exists(self._path(self.location(name))):
                return name
        return None

    def read(self) -> DataFrame | None:
        name = self.live()
        return None if name is None else self.spark.read.parquet(self.location(name))

    def stage(self, rows: DataFrame, partition_by: str | None = None, generation: str | None = None) -> str:
        """Writes a generation without making it live; its name comes back."""
        name = generation or generation_name(self.base)
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.location(name))
        return name

    def publish(self, generation: str, expected_rows: int | None = None, produced: int | None = None, failed: int = 0) -> None:
        """Moves the pointer, if the counts agree and nothing failed; else the live generation stays."""
        rows = self.spark.read.parquet(self.location(generation)).count()
        if failed:
            raise ValueError(f"{failed} files failed; {generation} is not published")
        if expected_rows is not None and rows != expected_rows or produced is not None and produced != rows:
            raise ValueError(f"{generation} has {rows} rows, expected {expected_rows}, produced {produced}; it is not published")
        pointer, new = self._path(f"{self.root}/{POINTER}-{self.alias}"), self._path(f"{self.root}/.{POINTER}-{self.alias}-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(generation.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if "://" in self.root else self.spark._jvm.java.net.URI("file:///"))
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = overwrite
        context.rename(new, pointer, array)


def last_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in order."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last")


def valid_messages(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Splits messages (value: JSON bytes or text, plus topic, partition, offset) into rows and a quarantine with reasons.

    A row needs to be a JSON object with a chunk_id and content that isn't blank.
    """
    row = F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"})
    named = messages.withColumn("_row", row).withColumn("_kind", F.expr("try_parse_json(cast(value as string))").isNotNull())
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"\s", ""), F.lit("")) == ""
    reason = F.when(~F.col("_kind") | F.col("_row").isNull(), "not JSON").when(~F.trim(F.col("value").cast("string")).startswith("{"), "not an object").when(blank("_row.content"), "content blank").when(blank("_row.chunk_id"), "chunk_id missing")
    judged = named.withColumn("reason", reason)
    good = judged.where("reason is null").select("topic", "partition", "offset", "_row.*")
    return good, judged.where("reason is not null").select("topic", "partition", "offset", "value", "reason")


def checked_vectors(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """Rows whose vector has the right number of values; any other fails the query."""
    ok = F.coalesce(F.size(column) == dims, F.lit(False))
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.from_json(F.raise_error(F.lit(f"{column} must have {dims} values")).cast("string"), "array<float>")))
