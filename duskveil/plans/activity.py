"""Queries on the audit table for trailing totals (p3) and sessions (p5), with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import EVENT_SECONDS_SQL, clean, clean_sql, event_seconds, map_total
from ..operators.dedup import latest_per_key
from ..operators.rolling import rolling_totals
from ..operators.sessions import sessions
from ..session import Stage, read_table

SESSION_GAP = 1800


def _timed(spark: SparkSession, sf_dir: str, **payload) -> DataFrame:
    return latest_per_key(read_table(spark, sf_dir, "audit_events"), "id", "received_at", payload | {"s": event_seconds(F.col("ts_unix"), F.col("ts"))}).where("s is not null")


def tool_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5: sessions of every cleaned tool, with their duration."""
    events = _timed(spark, sf_dir, tool=clean(F.col("tool")))
    return sessions(events, "tool", "s", SESSION_GAP).withColumn("duration_s", F.col("end_unix") - F.col("start_unix"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_sessions(spark, sf_dir).select("tool", "start_unix", "end_unix", "n_events")


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.coalesce(clean(F.col("provider")), F.lit("unknown"))
    events = _timed(spark, sf_dir, provider=provider, findings=map_total(F.col("counts")))
    daily = Stage(
        events.groupBy("provider", F.floor(F.col("s") / 86400).cast("int").alias("day")).agg(F.sum("findings").alias("findings")), "daily-findings"
    ).df
    bounds = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if bounds["lo"] is None:
        bounds = {"lo": 0, "hi": 0}
    # All providers together are one more entity, the null one, of the same operator.
    together = daily.groupBy("day").agg(F.sum("findings").alias("findings")).select(F.lit(None).cast("string").alias("provider"), "day", "findings")
    return rolling_totals(daily.unionByName(together), "provider", "day", "findings", bounds["lo"], bounds["hi"]).withColumn(
        "on_day", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    )


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3: totals and averages of findings for every provider and day over the last 7 and 30 days."""
    return _rolling(spark, sf_dir).where("provider is not null").select("provider", "on_day", "total", "sum_7", "avg_7", "sum_30", "avg_30", "active_30")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = _rolling(spark, sf_dir)
    every = rolled.where("provider is null").select("day", F.col("sum_7").alias("all_7"))
    kind = F.when((2 * F.col("sum_7") >= F.col("sum_30")) & (F.col("active_30") >= 20), F.lit("surge")).when(
        (F.col("sum_7") == 0) & (F.col("sum_30") >= 10) & (F.col("all_7") > 0), F.lit("silence")
    )
    return rolled.where("provider is not null").join(every, "day").select("provider", "on_day", kind.alias("kind")).where("kind is not null")


_EVENTS_SQL = f"""
ev as (select id, ts, ts_unix, tool, provider, counts from audit_events
  qualify row_number() over (partition by id order by received_at desc) = 1),
timed as (select *, {EVENT_SECONDS_SQL} as s from ev)"""

_ROLLED_SQL = f"""
with {_EVENTS_SQL},
e as (select coalesce({clean_sql('provider')}, 'unknown') as provider, cast(floor(s / 86400.0) as int) as day,
  coalesce(list_sum(map_values(counts)), 0) as findings from timed where s is not null),
daily as (select provider, day, sum(findings) as f from e group by all),
days as (select unnest(range((select min(day) from e), (select max(day) from e) + 1)) as day),
grid as (select provider, day, coalesce(f, 0) as f from (select distinct provider from e) p cross join days left join daily using (provider, day)),
rolled as (select provider, day, f as total,
  sum(f) over (partition by provider order by day rows 6 preceding) as sum_7,
  sum(f) over (partition by provider order by day rows 29 preceding) as sum_30,
  sum((f > 0)::int) over (partition by provider order by day rows 29 preceding) as active_30 from grid)"""

QUERIES = {"p3_found": p3_found, "p3_rolling": p3_rolling, "p5_found": p5_found, "p5_sessions": tool_sessions}

ORACLES = {
    "p3_rolling": _ROLLED_SQL
    + """ select provider, strftime(date '1970-01-01' + cast(day as int), '%Y-%m-%d') as on_day, cast(total as bigint) as total,
    cast(sum_7 as bigint) as sum_7, sum_7 / 7.0 as avg_7, cast(sum_30 as bigint) as sum_30, sum_30 / 30.0 as avg_30, cast(active_30 as int) as active_30 from rolled""",
    "p3_found": _ROLLED_SQL
    + """, every as (select day, sum(sum_7) as all_7 from rolled group by day)
    select provider, strftime(date '1970-01-01' + cast(day as int), '%Y-%m-%d') as on_day,
      case when 2 * sum_7 >= sum_30 and active_30 >= 20 then 'surge' else 'silence' end as kind
    from rolled join every using (day) where (2 * sum_7 >= sum_30 and active_30 >= 20) or (sum_7 = 0 and sum_30 >= 10 and all_7 > 0)""",
}
_SESSIONS_SQL = f"""
with {_EVENTS_SQL},
e as (select {clean_sql('tool')} as tool, s from timed where s is not null),
marked as (select tool, s, coalesce(s - lag(s) over (partition by tool order by s) > {SESSION_GAP}, true)::int as fresh from e where tool is not null),
numbered as (select tool, s, sum(fresh) over (partition by tool order by s rows unbounded preceding) as k from marked)
select tool, min(s) as start_unix, max(s) as end_unix, count(*) as n_events"""
ORACLES["p5_found"] = _SESSIONS_SQL + " from numbered group by tool, k"
ORACLES["p5_sessions"] = _SESSIONS_SQL + ", max(s) - min(s) as duration_s from numbered group by tool, k"
