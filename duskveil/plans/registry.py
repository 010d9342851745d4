"""All queries of the core and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import activity, auditing, detection, fixtures

MODULES = [activity, auditing, detection, fixtures]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.scan_flags(spark, sf_dir)
