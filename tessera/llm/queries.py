"""Queries p7_ to p9_ over the documents. No SQL says them; their tests are brute force and round trips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import canonical, mixing, packing
from tessera.plans.tables import table
from tessera.session import cut


def _pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def _fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_pack(spark, d))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = cut(mixing.document_sizes(table(spark, d, "documents")), "sizes"), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets, mixing.plan_of(sizes, targets))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_looking_pairs(table(spark, d, "documents"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_documents(table(spark, d, "documents"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p7_pack": _pack,
        "p7_fill": _fill,
        "p8_mix": _mix,
        "p8_shares": _shares,
        "p9_found": _pairs,
        "p9_texts": _texts,
        "p9_classes": _classes,
    }


def oracle_sql() -> dict[str, str]:
    return {}
