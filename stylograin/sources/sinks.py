"""Sinks: features, result tables, metrics, submissions, reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylograin.operators.ordering import row_index


def materialised(spark: SparkSession, folder: str, split: str, variant: str,
                 compute: Callable[[], DataFrame]) -> DataFrame:
    """Features of one (split, variant): read back if stored, else computed and stored.

    The variant is part of the path, so two ways to compute a feature never share a file.
    """
    path = f"{folder.rstrip('/')}/variant={variant}/split={split}"
    if not written(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has ended: Spark then leaves an empty file as a mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


def write_results_csv(df: DataFrame, path: str) -> None:
    """Result rows as CSV, list-valued columns left out."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def metrics_json(best: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """One JSON document: the best row and the whole history, a few rows long."""
    rows = history.agg(F.array_sort(F.collect_list(F.struct(
        order, *[c for c in history.columns if c != order]))).alias("history"))
    one = best.select(F.struct(*best.columns).alias("best"))
    return one.select(F.to_json(F.struct("best", rows.scalar().alias("history"))).alias("value"))


def submission(df: DataFrame, pred: str = "pred", order: str | None = None) -> DataFrame:
    """(id, label): the id column, else 0, 1, … in the order of a key."""
    known = [c for c in ("id", "ID") if c in df.columns]
    if known:
        return df.select(F.col(known[0]).alias("id"), F.col(pred).alias("label"))
    numbered = row_index(df, [order])
    return numbered.select((F.col("row_no") - 1).alias("id"), F.col(pred).alias("label"))


def write_encoded(df: DataFrame, path: str, text: str = "code", split: str = "split") -> None:
    """Encoded samples without their raw text, one folder per split."""
    df.drop(text).write.mode("overwrite").partitionBy(split).parquet(path)


def report_lines(metrics: DataFrame, names: Sequence[str], title: Column | None = None) -> DataFrame:
    """One formatted line per metric of a one-row table: (line_no, line)."""
    lines = [F.format_string("%-20s: %.4f", F.lit(n), F.col(n)) for n in names]
    if title is not None:
        lines = [title, F.lit("=" * 55), *lines]
    return metrics.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def summary_lines(results: DataFrame) -> DataFrame:
    """``name: val=…, ood=…, gain=…`` for a table of (model, val_f1, ood_f1, gain)."""
    return results.select(F.format_string(
        "%s: val=%.4f, ood=%.4f, gain=%+.4f", "model", "val_f1", "ood_f1", "gain").alias("line"))
