"""Registered queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("filters", "windows", "joins", "selections", "reports")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for name in MODULES:
        import_module(f"eventweir.queries.{name}")
    return QUERIES, SQL
