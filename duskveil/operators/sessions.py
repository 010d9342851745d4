"""Grouping of activity into sessions by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage


def sessions(events: DataFrame, entity: str, seconds: str, gap: int) -> DataFrame:
    """Sessions of each entity: a new one starts if more than ``gap`` seconds passed.

    Columns ``entity, start_unix, end_unix, n_events``. Method: time is cut into tiles of ``gap``
    seconds, so all events of one (entity, tile) belong together and are pre-aggregated map-side to
    (first, last, count). A tile links to the tile before it if the pause between them is at most
    ``gap``; no tile further back can be within reach. Pointers are doubled by repeated self-joins on
    (entity, tile) until no pointer moves, then tiles are aggregated by their root. The join key
    holds the tile, so an entity with a third of all events is spread over all tasks, and no window
    ever runs over a whole entity.

    Nulls: events without entity or time are left out. Repeated rows count as events of their own;
    ties in time are one instant. Empty input gives no rows. Extra columns are ignored.
    """
    if gap < 1:
        raise ValueError("gap must be at least one second")
    tiles = (
        events.select(F.col(entity).alias("e"), F.col(seconds).cast("bigint").alias("s"))
        .where("e is not null and s is not null")
        .groupBy("e", F.floor(F.col("s") / gap).cast("bigint").alias("tile"))
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    tile_stage = Stage(tiles, "session-tiles")
    tiles = tile_stage.df
    before = tiles.select("e", (F.col("tile") + 1).alias("tile"), F.col("hi").alias("hi_before"))
    # Only tiles that have a predecessor are nodes of the pointer table; a pointer without entry is a root.
    stage = Stage(
        tiles.join(before, ["e", "tile"]).where(F.col("lo") - F.col("hi_before") <= gap)
        .select("e", "tile", (F.col("tile") - 1).alias("ptr")),
        "session-pointers",
    )
    while True:
        target = stage.df.select("e", F.col("tile").alias("ptr"), F.col("ptr").alias("next"))
        moved = stage.df.select("e", "tile", "ptr").join(target, ["e", "ptr"], "left").select("e", "tile", F.coalesce("next", "ptr").alias("ptr"), F.col("next").isNotNull().alias("moved"))
        following = Stage(moved, "session-pointers")
        stage.drop()
        stage = following
        if stage.df.where("moved").isEmpty():
            break
    return (
        tiles.join(stage.df, ["e", "tile"], "left")
        .groupBy("e", F.coalesce("ptr", "tile").alias("root"))
        .agg(F.min("lo").alias("start_unix"), F.max("hi").alias("end_unix"), F.sum("n").alias("n_events"))
        .select(F.col("e").alias(entity), "start_unix", "end_unix", "n_events")
    )
