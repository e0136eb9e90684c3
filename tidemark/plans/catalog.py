"""All registered queries of the market-data and research operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import companies, feeds, holdings, issuers, market, more, registry, reports, research, specs, studies, texts, upkeep  # noqa: F401  importing a plan module registers its queries

FLAGSHIP = "brd_01_breadth"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
