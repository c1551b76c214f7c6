"""The registered queries: a name, a Spark query, and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duck_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name the input views."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = duck_sql(sql)
        return function

    return register
