"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import p01_split, p02_personal, p03_neighbours, p04_scans, p05_format_copies, p06_near_copies, p07_pairs, p08_leaks, p09_mix, p10_quality
from larkspur.tables import spread, table


def _chunk_content(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "content"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("collection"), F.col("chunk_id").alias("id"), F.col("embedding_vector").alias("v"))
    turns = table(spark, d, "conversations").select(F.lit("conversations").alias("collection"), F.col("turn_id").alias("id"), F.col("combined_embedding").alias("v"))
    return spread(chunks).unionByName(spread(turns))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return p01_split.items(spread(table(spark, d, "ingestion_state").select("run_id", "extracted_text", "chunks", "chunking_config")))


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p01_split.oversized(_items(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p01_split.split_oversized(_items(spark, d)).drop("piece").distinct()


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "conversations").select("turn_id", "user_message", "bot_response"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p02_personal.items(_turns(spark, d)).drop("end_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return p02_personal.redacted(_turns(spark, d)).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p03_neighbours.close_pairs(_vectors(spark, d))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return p03_neighbours.nearest(_vectors(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "ingestion_state").select("run_id", F.col("extracted_text").alias("text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p04_scans.noise(_runs(spark, d))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return p04_scans.repaired(_runs(spark, d)).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p05_format_copies.format_copies(_chunk_content(spark, d))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    return p05_format_copies.copy_counts(_chunk_content(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p06_near_copies.near_copies(_chunk_content(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return p06_near_copies.near_copy_groups(_chunk_content(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p07_pairs.defects(_turns(spark, d).toDF("turn_id", "question", "answer"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p08_leaks.leaks(_documents(spark, d), table(spark, d, "eval_cases"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return p08_leaks.leaked_spans(_documents(spark, d), table(spark, d, "eval_cases"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return p09_mix.mix(_documents(spark, d, "source"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return p09_mix.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_quality.not_prose(_documents(spark, d))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return p10_quality.quality(_documents(spark, d)).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_redacted, p3_found, p3_nearest, p4_found, p4_repaired, p5_found, p5_copies, p6_found, p6_groups, p7_found, p8_found, p8_spans, p9_mix, p9_shares, p10_found, p10_statistics)}
