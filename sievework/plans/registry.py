"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import analysis, deliveries, outputs, reports
from sievework.streaming import deliveries as streams

MODULES = [deliveries, reports, analysis, outputs, streams]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return reports.flagship(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
