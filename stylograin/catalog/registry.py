"""The register of queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylograin.catalog.tables import Tables
from stylograin.session import release

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = ["sources", "columns", "profile", "metrics", "drill", "joins", "sampling", "ranking", "surface", "terms",
            "trees", "arrays", "models", "studies"]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, as sums of doubles depend on their order in the last digits."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def query(name: str, sql: str | None = None, places: int = 6):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL if there is one."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            release()  # what the query before kept
            return rounded(fn(Tables(spark, folder)), places)

        _queries[name] = run
        if sql is not None:
            _sql[name] = sql
        return fn
    return register


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"stylograin.catalog.{family}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
