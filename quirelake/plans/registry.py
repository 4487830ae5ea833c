"""Registered queries: a Spark plan and, where SQL can say it, a check query."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quirelake.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id and name."""

    def register(run: Query) -> Query:
        @wraps(run)
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        QUERIES[name] = configured
        if sql is not None:
            CHECKS[name] = sql
        return configured

    return register
