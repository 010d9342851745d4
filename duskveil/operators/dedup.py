"""Latest version of every keyed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: str, payload: dict[str, Column]) -> DataFrame:
    """One row per ``key``: the payload of the row with the largest ``order``.

    The maximum is one aggregate over ``struct(order, payload)``, so exact copies and re-deliveries
    collapse map-side and a hot key never reaches one task whole. Ties in ``order`` go to the larger
    payload, null orders sort first. Rows without key are never merged unless all of their payload
    and order agree. Payload columns must be orderable (no maps).
    """
    fields = [F.col(order).alias("__order"), *(col.alias(name) for name, col in payload.items())]
    packed = df.select(F.col(key).alias("__key"), F.struct(*fields).alias("__row"))
    return (
        packed.groupBy("__key", F.when(F.col("__key").isNull(), F.col("__row")).alias("__orphan"))
        .agg(F.max("__row").alias("__row"))
        .select(F.col("__key").alias(key), *(F.col(f"__row.{name}").alias(name) for name in payload))
    )
