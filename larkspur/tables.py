"""Access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that one task should get when a table comes as a single file of one row group.
TASK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it is stored; scans stay prunable."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to more tasks where a scan has fewer tasks than the session has cores.

    A table stored as one file of one row group is read by one task. Where the scan already has enough
    partitions (any table of real size) nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= max(2, cores // 2):
        return df
    return df.repartition(cores)
