"""Readers that bring sample tables into one shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted names of the text and the label column, in order of preference.
COLUMN_ALIASES = {
    "code": ["source", "snippet", "text", "content"],
    "label": ["target", "is_ai", "generated", "class"],
}


def read_splits(spark: SparkSession, paths: Mapping[str, str], columns: Sequence[str] = ("*",)) -> DataFrame:
    """Read one parquet path per split into one table with a ``split`` column."""
    parts = [spark.read.parquet(path).select(*columns, F.lit(split).alias("split"))
             for split, path in paths.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def normalised_columns(df: DataFrame, aliases: Mapping[str, list[str]] = COLUMN_ALIASES) -> DataFrame:
    """Lower-case, trimmed names; aliases renamed; integer label; an error names all that are missing."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    sources = {wanted: next((n for n in (wanted, *others) if n in df.columns), None) for wanted, others in aliases.items()}
    missing = [wanted for wanted, source in sources.items() if source is None]
    if missing:
        raise KeyError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    df = df.withColumnsRenamed({source: wanted for wanted, source in sources.items()})
    return df.withColumn("label", F.col("label").cast("int")) if "label" in df.columns else df


def with_defaults(df: DataFrame, language: str, unlabelled: int = -1) -> DataFrame:
    """Absent label or language columns, or missing values in them, get a default."""
    def filled(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    return df.withColumns({"label": filled("label", F.lit(unlabelled)),
                           "language": filled("language", F.lit(language))})


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows of an explicit order."""
    return df.orderBy(order).limit(n)
