"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of view DataFrames as a query over the given tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register
