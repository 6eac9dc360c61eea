"""All queries of the domain's operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstead.plans import analysis, incremental, jobs, landing, reanalysis, relational, scalars, writes

PARTS = (relational.query, scalars.query, writes.query, incremental.query, analysis.query, reanalysis.query, jobs.query, landing.query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
