"""Rolling totals over trailing days: banded window matrices over dense blocks with halos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_DAYS = 64
#: Groups (entity, tile) that are made dense at a time: bounds a worker's memory.
BLOCK_GROUPS = 2048


def _band(window: int, halo: int, days: int) -> np.ndarray:
    """Matrix that sums, for each of ``days``, the day and the ``window - 1`` days before it."""
    source, target = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((source <= target) & (source > target - window)).astype(np.float64)


def rolling_totals(
    daily: DataFrame, entity: str, day: str, value: str, first_day: int, last_day: int, windows: tuple[int, ...] = (7, 30),
    tile_days: int = TILE_DAYS,
) -> DataFrame:
    """Trailing totals, averages and active days for every entity and every day of a range.

    ``daily`` has one row for each entity and active day (day as a day number, value a bigint).
    The result has a row for every entity and every day from ``first_day`` to ``last_day``:
    ``entity, day, total`` and for each window w ``sum_w, avg_w, active_w`` (days with a value above
    0). Days before the first count as empty, averages divide by w.

    Days are cut into tiles; a daily row is sent to its own tile and, as halo, to each later tile
    whose windows reach back to it. Rows are partitioned by (entity, tile) and sorted, so each task
    streams groups of at most halo + tile_days rows, packs a block of groups into a dense matrix and
    multiplies it by one band matrix for each window. Sums are exact below 2**53.

    Nulls: rows without day are dropped, a null value counts 0, the null entity is an entity of its
    own. Repeated (entity, day) rows add up. Empty input gives no rows.
    """
    halo = max(windows) - 1
    first_tile, last_tile = first_day // tile_days, last_day // tile_days
    rows = daily.select(F.col(entity).alias("e"), F.col(day).cast("int").alias("d"), F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint")).alias("v")).where(
        F.col("d").between(first_day, last_day)
    )
    own = rows.select(
        "e",
        F.explode(F.sequence(F.floor(F.col("d") / tile_days), F.least(F.floor((F.col("d") + halo) / tile_days), F.lit(last_tile).cast("bigint")))).alias("t"),
        "d", "v",
    )
    marks = rows.select("e").distinct().select(
        "e", F.explode(F.sequence(F.lit(first_tile).cast("bigint"), F.lit(last_tile).cast("bigint"))).alias("t"),
        F.lit(None).cast("int").alias("d"), F.lit(0).cast("bigint").alias("v"),
    )
    out_fields = ["e string", "d int", "total bigint"]
    for w in windows:
        out_fields += [f"sum_{w} bigint", f"avg_{w} double", f"active_{w} int"]
    bands = {w: _band(w, halo, tile_days) for w in windows}

    def dense(names: list, tiles: np.ndarray, group: np.ndarray, days: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        block = np.zeros((len(names), halo + tile_days))
        at = days - tiles[group] * tile_days + halo
        np.add.at(block, (group, at), values)
        active = (block > 0).astype(np.float64)
        all_days = tiles[:, None] * tile_days + np.arange(tile_days)[None, :]
        keep = (all_days >= first_day) & (all_days <= last_day)
        out = {"e": np.repeat(np.array(names, dtype=object), tile_days)[keep.ravel()], "d": all_days[keep].astype(np.int32), "total": block[:, halo:][keep].astype(np.int64)}
        for w in windows:
            sums = np.rint(block @ bands[w])[keep]
            out[f"sum_{w}"] = sums.astype(np.int64)
            out[f"avg_{w}"] = sums / w
            out[f"active_{w}"] = np.rint(active @ bands[w])[keep].astype(np.int32)
        return pd.DataFrame(out)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            e, t = frame["e"].to_numpy(object), frame["t"].to_numpy(np.int64)
            new = np.ones(len(frame), bool)
            new[1:] = (t[1:] != t[:-1]) | (e[1:] != e[:-1])
            starts = np.flatnonzero(new)
            if len(starts) < 2:
                rest = frame
                continue
            yield from emit(frame.iloc[: starts[-1]])
            rest = frame.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from emit(rest)

    def emit(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        e, t = frame["e"].to_numpy(object), frame["t"].to_numpy(np.int64)
        new = np.ones(len(frame), bool)
        new[1:] = (t[1:] != t[:-1]) | (e[1:] != e[:-1])
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        days, values = frame["d"].to_numpy(np.float64), frame["v"].to_numpy(np.float64)
        for a in range(0, len(starts), BLOCK_GROUPS):
            part = starts[a : a + BLOCK_GROUPS]
            stop = starts[a + BLOCK_GROUPS] if a + BLOCK_GROUPS < len(starts) else len(frame)
            some = slice(part[0], stop)
            real = ~np.isnan(days[some])
            yield dense([e[i] for i in part], t[part], group[some][real] - a, days[some][real].astype(np.int64), values[some][real])

    return (
        own.unionByName(marks)
        .repartition("e", "t")
        .sortWithinPartitions("e", "t", "d")
        .mapInPandas(work, ", ".join(out_fields))
        .withColumnRenamed("e", entity)
        .withColumnRenamed("d", day)
    )
