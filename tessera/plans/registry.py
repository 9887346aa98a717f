"""All queries of the core, by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import engine_queries, preparation_queries

_MODULES = (engine_queries, preparation_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cube_query_flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for module in _MODULES:
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in _MODULES:
        out |= module.oracle_sql()
    return out
