"""Batch ingestion: document files to a published generation of embedded chunks, as one plan."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import chunker, policy, routing
from larkspur.session import cut
from larkspur.sources import files, generations
from larkspur.sources import pdf as pdf_file


@dataclass
class Result:
    """``files``: processed ones; ``failed``: names of the others, the first ``NAMED`` of them; ``seconds`` by stage."""

    status: str
    files: int
    chunks: int
    generation: str | None
    failed: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


#: Failed files whose names a result lists.
NAMED = 100


class Failed(RuntimeError):
    """An ingestion that was given up; the live generation is as it was."""


def parsed(found: DataFrame, pdf=pdf_file.elements, see=None) -> DataFrame:
    """``found``: file_name, file_type, content. Layout elements, read once; a bad file is one row with ``error``."""
    return cut(files.elements(found.withColumn("doc_id", F.sha1("file_name")), pdf, see))


def chunks_of(elements: DataFrame, found: DataFrame, roles: DataFrame, max_chars: int = chunker.MAX_CHARS, overlap: int = chunker.OVERLAP) -> DataFrame:
    """Standard chunks of the files (file_name, file_type) that could be read, with their document roles and a time stamp."""
    parts = chunker.build_sections(elements.where("error is null"))
    chunks = chunker.create_chunks(parts, max_chars, overlap)
    kept = chunker.near_first(chunker.exact_first(chunks, ["doc_id"], ["heading", "subheading", "content"], ["ord"]))
    owners = policy.assign_roles(found.select(F.sha1("file_name").alias("doc_id"), "file_name", "file_type"), roles).withColumnRenamed("document_role", "allowed_role")
    return chunker.standard_chunks(kept.join(owners, "doc_id")).withColumn("created_at", F.current_timestamp())


def judged(found: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_name, chunks and error of every file; one without chunks has failed, too."""
    counts = chunks.groupBy("file_name").agg(F.count("*").alias("chunks"))
    errors = elements.where("error is not null").select("doc_id", "error")
    rows = found.select("file_name", F.sha1("file_name").alias("doc_id")).join(errors, "doc_id", "left").join(counts, "file_name", "left")
    return rows.select("file_name", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("error", F.when(F.col("chunks").isNull(), "no chunks")).alias("error"))


def summary(files_: DataFrame, dry_run: bool) -> DataFrame:
    """One row: files, chunks, failed and the status that follows."""
    counted = files_.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count("error").alias("failed"))
    return counted.withColumn("status", routing.run_status(F.lit(dry_run), F.col("files") - F.col("failed"), F.col("failed")))


def ingest(spark: SparkSession, folder: str, roles: DataFrame, store: generations.Generations, embed, dims: int, dry_run: bool = False, pdf=pdf_file.elements, see=None) -> Result:
    """Reads a folder, chunks, embeds, stages, reconciles and publishes.

    A bad file doesn't end the reading, but nothing is published then (``Failed``); any failure leaves the live
    generation as it is. A dry run writes nothing and tells what would come.
    """
    seconds: dict[str, float] = {}
    began = time.perf_counter()

    def done(stage: str) -> None:
        nonlocal began
        seconds[stage], began = time.perf_counter() - began, time.perf_counter()

    found = files.scan(spark, folder)
    elements = parsed(found, pdf, see)
    done("extract")
    chunks = cut(chunks_of(elements, found, roles))
    whole = cut(judged(found, elements, chunks))
    total = summary(whole, dry_run).first()
    done("chunk")
    bad = [r["file_name"] for r in whole.where("error is not null").orderBy("file_name").limit(NAMED).collect()]
    result = Result(total["status"], total["files"] - total["failed"], total["chunks"], None, bad, seconds)
    if dry_run or not result.files:
        return result
    if bad:
        raise Failed(f"{total['failed']} files failed, among them {', '.join(bad)}; the live generation is {store.live()}")
    embedded = generations.checked_vectors(chunks.withColumn("embedding_vector", embed(F.col("content"))), "embedding_vector", dims)
    result.generation = store.stage(embedded, partition_by="allowed_role")
    done("embed")
    store.publish(result.generation, expected_rows=total["chunks"], produced=chunks.select("chunk_id").distinct().count())
    done("publish")
    return result
