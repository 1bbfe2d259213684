"""Ranked lists over terms, importances and groups.

The ``k`` of a list is found by counts and its rows are numbered in ranges, so a list may be long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.operators.ordering import top_per_group
from stylograin.session import reused


def top_k(df: DataFrame, value: str, k: int, tie: str = "term") -> DataFrame:
    """The ``k`` largest."""
    return ranked(df, value, k, tie).drop("rank")


def ranked(df: DataFrame, value: str, k: int, tie: str = "term") -> DataFrame:
    """The ``k`` largest with their rank 1 … k."""
    return top_per_group(reused(df), k, value, tie)


def two_sided(df: DataFrame, value: str, k: int, by: Sequence[str] = (), tie: str = "term") -> DataFrame:
    """The ``k`` highest and the ``k`` lowest per group, as ``side`` and ``rank``."""
    df = reused(df)
    high = top_per_group(df, k, value, tie, by).withColumn("side", F.lit("high"))
    low = top_per_group(df, k, value, tie, by, descending=False).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def gain_over_first(results: DataFrame, value: str, order: str) -> DataFrame:
    """Difference to the first row and to the row before, for a results table of a few rows."""
    by_order = Window.orderBy(order)
    return results.withColumns({
        "gain_over_first": F.col(value) - F.first(value).over(by_order),
        "gain_over_previous": F.col(value) - F.lag(value).over(by_order)})


def above_mean(df: DataFrame, value: str) -> Column:
    """Whether a value exceeds the mean of the shown rows."""
    return F.col(value) > F.avg(value).over(Window.partitionBy())
