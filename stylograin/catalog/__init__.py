"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from stylograin.catalog.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
