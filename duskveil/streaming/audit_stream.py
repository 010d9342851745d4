"""Structured Streaming over audit events: deduplication, windows, retention, rule reload (extensions of C10, K5, K9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.rules import Rule
from ..operators.scan import scan


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counted_windows(events: DataFrame, size: str = "1 hour", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Events and findings of each provider and window; ids that come twice within the watermark count once."""
    timed = events.withColumn("event_time", F.timestamp_seconds("ts_unix")).withWatermark("event_time", late)
    once = timed.dropDuplicatesWithinWatermark(["id"])
    total = F.aggregate(F.coalesce(F.map_values("counts"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0).cast("bigint")))
    return (
        once.groupBy(F.window("event_time", size, slide or size).alias("w"), F.coalesce("provider", F.lit("unknown")).alias("provider"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(total).alias("n_findings"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "provider", "n_events", "n_findings")
    )


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each tool with Spark's session windows."""
    timed = events.where("tool is not null").withColumn("event_time", F.timestamp_seconds("ts_unix")).withWatermark("event_time", late)
    return timed.groupBy(F.session_window("event_time", gap).alias("w"), "tool").agg(F.count(F.lit(1)).alias("n_events")).select("tool", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def scan_stream(texts: DataFrame, ids: list[str], text: str, rules: Callable[[], list[Rule]], sink: Callable[[DataFrame, int], None], key: bytes | None = None) -> DataStreamWriter:
    """Scans each micro-batch with the rules of that moment and hands the findings to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        sink(scan(batch, ids, text, rules(), key=key), number)

    return texts.writeStream.foreachBatch(run)
