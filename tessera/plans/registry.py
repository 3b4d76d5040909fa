"""All queries of the panel library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import attribution, base, evaluation, features, formulas, indicators, market, more, panel, research, structure  # noqa: F401  (they register themselves)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["flagship_reversal"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.ORACLES
