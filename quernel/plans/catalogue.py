"""Every registered query of the core with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (query, SQL or None)
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def load() -> None:
    """Import the modules that register queries."""
    from . import clean_queries, dedup_queries, extra_queries, instruct_queries, more_queries, pipeline_queries, select_queries, stream_queries, text_queries  # noqa: F401
