"""Registered queries: each family's module has QUERIES (name to function) and ORACLE (name to SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    from overlapkit.plans import inventory, seams, series, sessions, streaming, text

    found: dict[str, Query] = {}
    for family in (seams, text, series, sessions, inventory, streaming):
        found |= family.QUERIES
    return found


def all_oracles() -> dict[str, str]:
    from overlapkit.plans import inventory, seams, series, sessions, streaming, text

    found: dict[str, str] = {}
    for family in (seams, text, series, sessions, inventory, streaming):
        found |= family.ORACLE
    return found
