"""Isotonic regression by pooling adjacent violators, in buckets and then between them.

Rows of equal score are added up first. The ordered scores are cut into buckets, and each pools its violators
on its own; what pools is the same in whatever order neighbours are pooled. While the last mean of a bucket is
not below the first of the next, the pools are dealt out again, with the cuts moved by half a bucket, so that
what was a border is inside. Every round that is not the last pools at least one pair.

Labels of 0 and 1 allow few pools: their means are different fractions, so n rows give about n^(2/3) pools at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylograin.operators.ordering import with_quantile_bucket
from stylograin.session import importable_on_workers, scratch_path

POOLS = "low double, high double, total double, n double"
BUCKET_ROWS = 200_000


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Neighbours are pooled until means rise."""
    out: list[tuple[float, float, float, float]] = []
    for pool in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        while out and out[-1][2] * pool[3] >= pool[2] * out[-1][3]:
            last = out.pop()
            pool = (last[0], pool[1], last[2] + pool[2], last[3] + pool[3])
        out.append(pool)
    return out


def pools(scored: DataFrame, score: str, label: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(low, high, total, n) of the pools: ranges of scores with the sum and number of their labels."""
    spark = scored.sparkSession
    importable_on_workers(spark)

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "pools")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def pool(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        made = pooled(*[table.column(name).to_numpy() for name in ("low", "high", "total", "n")])
        bucket = table.column("_bucket")[0].as_py()
        columns = [pa.array([row[k] for row in made], pa.float64()) for k in range(4)]
        return pa.table([*columns, pa.array([bucket] * len(made), pa.int32())], names=["low", "high", "total", "n", "_bucket"])

    value = F.col(score).cast("double")
    rows = scored.where(value.isNotNull() & F.col(label).isNotNull()).groupBy(value.alias("low")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    current = stored(rows.select("low", F.col("low").alias("high"), "total", "n"))
    shift = 0
    while True:
        buckets = max(1, -(-current.count() // bucket_rows))
        dealt = current.withColumn("_bucket", F.lit(0)) if buckets == 1 else with_quantile_bucket(current, "low", 2 * buckets).withColumn(
            "_bucket", F.floor((F.col("_bucket") + shift) / 2).cast("int"))
        current = stored(dealt.groupBy("_bucket").applyInArrow(pool, POOLS + ", _bucket int"))
        mean = F.col("total") / F.col("n")
        ends = current.groupBy("_bucket").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        in_order = Window.orderBy("_bucket")  # one row per bucket
        if ends.withColumn("before", F.lag("last").over(in_order)).where("before >= first").isEmpty():
            return current.drop("_bucket")
        current, shift = current.drop("_bucket"), 1 - shift


class IsotonicModel:
    """Means of the pools, with straight lines between them, and constant beyond the ends."""

    def __init__(self, scored: DataFrame, score: str, label: str):
        found = np.array([[r.low, r.high, r.total / r.n] for r in pools(scored, score, label).orderBy("low").collect()]).reshape(-1, 3)
        self.score = score
        self.at, self.values = found[:, :2].ravel(), np.repeat(found[:, 2], 2)

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.at, self.values))

        @F.pandas_udf("double")
        def value(x):
            import pandas as pd

            at, values = shared.value
            return pd.Series(np.interp(x.to_numpy(), at, values) if len(at) else np.full(len(x), np.nan))

        return df.withColumn("prediction", value(F.col(self.score).cast("double")))
