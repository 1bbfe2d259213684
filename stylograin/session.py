"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "stylograin", driver_memory: str = "12g",
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return (
        builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine may name none: a fresh folder is then made and set as the
    checkpoint folder. On a cluster the executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stylograin-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def importable_on_workers(spark: SparkSession) -> None:
    """Put this package's folder on the path of the Python workers, where they can see it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def batches_of_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows, for rows that hold texts or vectors, where the session leaves them at Spark's 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: Rows of vectors that are in memory at once, and bytes of a file that are.
VECTOR_ROWS, VECTOR_BYTES = 128, 16 << 20
READER_SETTING = "spark.sql.parquet.columnarReaderBatchSize"


def stored_vectors(df: DataFrame, schema) -> DataFrame:
    """Write rows of vectors to the shared folder and read them back with another schema.

    A task holds a batch of rows and a row group of the file in memory. Spark's 4,096 rows are
    millions of entries, so where the session leaves a batch at those it is set to ``VECTOR_ROWS``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "vectors")
    df.write.option("parquet.block.size", VECTOR_BYTES).parquet(path)
    if spark.conf.get(READER_SETTING) == "4096":
        spark.conf.set(READER_SETTING, VECTOR_ROWS)
    return spark.read.schema(schema).parquet(path)


_kept: list[DataFrame] = []


def reused(df: DataFrame) -> DataFrame:
    """Keep an aggregated table that one plan reads several times.

    Blocks go to disk when memory is short and are recomputed when an executor is lost.
    ``release`` frees everything that was kept.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Count ``df`` and hint a broadcast only if it has at most ``rows`` rows.

    For group tables that should be small but need not be: a large one is joined by
    shuffle. The counted result is kept, so it is not computed again for the join.
    """
    kept = reused(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def release() -> None:
    """Drop all tables held by ``reused``."""
    while _kept:
        _kept.pop().unpersist()
