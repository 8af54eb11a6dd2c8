"""All queries of the core, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setaudit.plans import audit, reports, training  # noqa: F401  reports adds to audit's queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**audit.QUERIES, **training.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**audit.SQL, **training.SQL}
