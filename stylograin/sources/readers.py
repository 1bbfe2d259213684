"""Parquet readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_texts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Read a table of texts, spread by key if it comes in fewer pieces than there are cores.

    Text expressions are bound by the processor, and a small table may sit in a single
    row group, which one task would have to work through alone. A large table has more
    pieces than cores and is read as it is, without a shuffle. Filters and column pruning
    pass through the repartition down to the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if pieces(df) >= cores else df.repartition(cores, key)


def pieces(df: DataFrame) -> int:
    """Number of input partitions of a plain scan; reads file sizes only."""
    return df.rdd.getNumPartitions()
