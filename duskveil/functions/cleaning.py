"""Cleaning of spelling variants and of event times; the same rules as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: RE2 has no Unicode white space class; fixed values: the code points of White_Space.
SQL_SPACE = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def clean(col: Column) -> Column:
    """White space of any kind off both ends, lower case; null or empty is null."""
    return F.nullif(F.lower(F.regexp_replace(col, _EDGE, "")), F.lit(""))


def clean_sql(expr: str) -> str:
    return f"nullif(lower(regexp_replace({expr}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')), '')"


#: ``ts_unix`` above this is milliseconds (as seconds it would lie beyond the year 5000).
MILLISECONDS_FROM = 100_000_000_000


def event_seconds(ts_unix: Column, ts: Column) -> Column:
    """Event time in whole seconds: ``ts_unix`` (milliseconds recognised), else ``ts`` without fraction."""
    whole = F.when(F.abs(ts_unix) >= MILLISECONDS_FROM, F.floor(ts_unix / 1000)).otherwise(ts_unix)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.coalesce(whole, F.floor(micros / 1_000_000)).cast("bigint")


EVENT_SECONDS_SQL = (
    f"coalesce(case when abs(ts_unix) >= {MILLISECONDS_FROM} then cast(floor(ts_unix / 1000.0) as bigint) else ts_unix end, "
    "cast(floor(epoch_us(ts) / 1000000.0) as bigint))"
)


def map_total(col: Column) -> Column:
    """Sum of a map's values; null values count as 0, a null map as 0."""
    return F.coalesce(
        F.aggregate(F.map_values(col), F.lit(0).cast("bigint"), lambda acc, v: acc + F.coalesce(v, F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
    )
