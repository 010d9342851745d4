"""Texts, rules and audit events from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "id string, ts timestamp_ntz, mode string, tool string, provider string, flags array<string>, counts map<string,bigint>, "
    "action_taken string, hashed_values array<string>, severity string, ts_unix bigint"
)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows ``path, text``; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def inline_text(spark: SparkSession, text: str) -> DataFrame:
    """S3: one row ``path, text``."""
    return spark.createDataFrame([("inline", text)], "path string, text string")


def audit_table(spark: SparkSession, path: str, nested_as_json: bool = False) -> DataFrame:
    """Audit events; ``nested_as_json`` reads lists and maps that were stored as JSON text."""
    df = spark.read.parquet(path)
    if nested_as_json:
        kinds = {"flags": "array<string>", "counts": "map<string,bigint>", "hashed_values": "array<string>"}
        df = df.withColumns({c: F.from_json(c, k) for c, k in kinds.items()})
    return df
