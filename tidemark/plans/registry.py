"""Registry of the library's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import files, overview, positioning, regimes, signals

MODULES = [positioning, signals, regimes, overview, files]


def entries() -> dict[str, tuple]:
    """Every query with its SQL (None where SQL can't express it)."""
    return {name: pair for module in MODULES for name, pair in module.entries().items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: pair[0] for name, pair in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for name, pair in entries().items() if pair[1]}
