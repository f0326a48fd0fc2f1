"""All core queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text_queries", "manifest_queries", "dedup_queries", "mix_queries", "case_queries", "run_queries", "source_queries")


def query(sql: str | None = None):
    """Register a function (spark, directory) under its name, with SQL if there is any."""

    def take(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return take


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    import importlib

    for m in _MODULES:
        importlib.import_module(f"textloom.plans.{m}")
