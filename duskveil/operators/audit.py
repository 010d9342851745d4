"""Audit events: building, write gate, retention, filters, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, unrank

SNAPSHOT_LIMIT, TOP_FLAGS, RETENTION_DAYS = 10_000, 10, 90


def first_seen(values: Column, order: Column) -> Column:
    """Distinct values in the order of their first appearance, as an aggregate."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def events_from_findings(findings: DataFrame, ids: list[str]) -> DataFrame:
    """A4: one row for each text: ``flags`` and ``hashed_values`` distinct in reported order, ``counts`` by flag, worst ``severity``, ``total``.

    Counts are added per flag first; the lists of one text are bounded by its findings. No raw value is kept.
    """
    per_flag = findings.groupBy(*ids, "flag").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("sev_rank").alias("sev"), F.collect_list(F.struct("seq", "hashed_value")).alias("h")
    )
    return per_flag.groupBy(*ids).agg(
        first_seen(F.col("flag"), F.col("first")).alias("flags"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", F.col("n").cast("bigint"))))).alias("counts"),
        F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("h"))), lambda x: x["hashed_value"])).alias("hashed_values"),
        unrank(F.coalesce(F.max("sev"), F.lit(0)), SEVERITIES).alias("severity"),
        F.sum("n").alias("total"),
    )


def feedback(findings: DataFrame, ids: list[str]) -> DataFrame:
    """Counts by flag, action and category as maps, worst severity, total and a summary line for each text."""

    def counted(name: str) -> DataFrame:
        per = findings.groupBy(*ids, name).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(f"by_{name}"))

    total = findings.groupBy(*ids).agg(F.count(F.lit(1)).alias("total"), unrank(F.max("sev_rank"), SEVERITIES).alias("max_severity"))
    out = reduce(lambda a, b: a.join(b, ids), [counted(n) for n in ("flag", "action", "category")], total)
    parts = F.transform(F.map_entries("by_action"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    return out.withColumn("summary", F.concat(F.col("total").cast("string"), F.lit(" finding(s) ["), F.array_join(parts, ", "), F.lit("]")))


def scan_report(findings: DataFrame, ids: list[str], shadow: bool = False) -> DataFrame:
    """Counts by flag, all hashes in order, and the action (warn in shadow mode)."""
    per = findings.groupBy(*ids, "flag").agg(F.count(F.lit(1)).alias("n"), F.max("act_rank").alias("r"), F.collect_list(F.struct("seq", "hashed_value")).alias("h"))
    out = per.groupBy(*ids).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("counts"),
        F.transform(F.array_sort(F.flatten(F.collect_list("h"))), lambda x: x["hashed_value"]).alias("hashed_values"), F.max("r").alias("r"),
    )
    action = F.lit("warn") if shadow else unrank(F.col("r"), ("allow", "warn", "redact", "block"))
    return out.withColumn("action", action).drop("r")


def writable(hashes: Column, allow_legacy: bool = False) -> Column:
    """K2: every hash is keyed (``hmac:`` or ``bypass-hash:``; ``sha256:`` only if allowed). No hashes pass, a null hash does not."""
    starts = ["hmac:", "bypass-hash:"] + ["sha256:"] * allow_legacy
    return F.forall(F.coalesce(hashes, F.array().cast("array<string>")), lambda h: F.coalesce(reduce(lambda a, b: a | b, (h.startswith(s) for s in starts)), F.lit(False)))


def gate(events: DataFrame, allow_legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """K1, K2: (events to write, rejected events)."""
    ok = writable(F.col("hashed_values"), allow_legacy)
    return events.where(ok), events.where(~ok)


def append_outcomes(events: DataFrame, stored: DataFrame | None = None, allow_legacy: bool = False) -> DataFrame:
    """K1-K3: adds ``outcome``: ``written``, ``rejected-unkeyed`` or ``duplicate-id``.

    The first event of an id (by time, then content) among the new ones is written unless ``stored`` has the id; all others of that
    id are duplicates. Events that the gate rejects take no id. A null id is an error of its own: it counts as a duplicate.
    """
    marked = events.withColumn("__ok", writable(F.col("hashed_values"), allow_legacy))
    order = Window.partitionBy("id", "__ok").orderBy(*([F.asc_nulls_last("ts_unix")] if "ts_unix" in events.columns else []), F.xxhash64(F.to_json(F.struct(*events.columns))))
    marked = marked.withColumn("__n", F.row_number().over(order))
    if stored is not None:
        marked = marked.join(stored.select(F.col("id").alias("__old")).where("__old is not null").distinct(), F.col("id") == F.col("__old"), "left")
    taken = F.col("id").isNull() | (F.col("__n") > 1) | (F.col("__old").isNotNull() if stored is not None else F.lit(False))
    outcome = F.when(~F.col("__ok"), "rejected-unkeyed").when(taken, "duplicate-id").otherwise("written")
    return marked.select(*events.columns, outcome.alias("outcome"))


def append_events(events: DataFrame, path: str, allow_legacy: bool = False) -> dict[str, int]:
    """K1-K4: writes the events whose outcome is ``written`` to the table at ``path``; how many events had each outcome.

    The counts name what the reference surfaces as drops and errors. The commit is Spark's, so nothing is left to flush or close.
    """
    spark = events.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    done = append_outcomes(events, spark.read.parquet(path) if exists else None, allow_legacy)
    counts = {r["outcome"]: r["n"] for r in done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    done.where("outcome = 'written'").drop("outcome").write.mode("append").parquet(path)
    return counts


def retained(events: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """K5: events not older than the retention; the cutoff itself stays. Events without time go."""
    return events.where(F.col("ts_unix") >= now - days * 86400)


def recent(events: DataFrame, n: int = SNAPSHOT_LIMIT) -> DataFrame:
    """K6, O1: the newest ``n`` events, ties by id. The limit is the feature."""
    return events.orderBy(F.desc("ts_unix"), F.asc("id")).limit(n)


def snapshot(memory: DataFrame, stored: DataFrame, n: int = SNAPSHOT_LIMIT) -> DataFrame:
    """Union by id, memory before store, newest first."""
    both = memory.withColumn("__src", F.lit(0)).unionByName(recent(stored, n).withColumn("__src", F.lit(1)))
    one = Window.partitionBy("id").orderBy("__src", F.desc("ts_unix"))
    return recent(both.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__src"), n)


def filtered(events: DataFrame, provider: str | None = None, tool: str | None = None, since: int | None = None) -> DataFrame:
    """provider and tool equal, time not before ``since``; None filters nothing."""
    out = events
    if provider is not None:
        out = out.where(F.col("provider") == provider)
    if tool is not None:
        out = out.where(F.col("tool") == tool)
    if since is not None:
        out = out.where(F.col("ts_unix") >= since)
    return out


def recent_filtered(events: DataFrame, provider: str | None = None, tool: str | None = None, since: int | None = None, n: int = SNAPSHOT_LIMIT) -> DataFrame:
    """the filters look at the newest ``n`` events only."""
    return filtered(recent(events, n), provider, tool, since)


def top_flags(events: DataFrame, by: list[str], k: int = TOP_FLAGS) -> DataFrame:
    """A1, O2: the ``k`` flags with most findings of each group (summed ``counts``, a map or its entries), ties by name: ``by, flag, n, place``."""
    entries = F.col("counts") if dict(events.dtypes)["counts"].startswith("array") else F.map_entries("counts")
    summed = events.select(*by, F.explode(entries).alias("e")).select(*by, F.col("e.key").alias("flag"), F.col("e.value").alias("v")).groupBy(*by, "flag").agg(F.sum(F.coalesce("v", F.lit(0))).alias("n"))
    if not by:
        # The first of each task, then the first of these: no task sorts all flags.
        summed = summed.orderBy(F.desc("n"), F.asc("flag")).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("flag"))
    return summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def stats_by(events: DataFrame, name: str) -> DataFrame:
    """A1, A2, O3: ``name, total`` and actions as a map, most events first."""
    per = events.groupBy(name, "action_taken").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy(name)
        .agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("action_taken").isNotNull(), F.struct("action_taken", "n"))))).alias("by_action"))
        .orderBy(F.desc("total"), F.asc(name))
    )


def summary(events: DataFrame) -> DataFrame:
    """``kind, name, n``: the total, the events of each provider, tool and action, and the findings of the flags most often found.

    One pass counts all kinds; a row for each name, as tools grow with the installations. Without events the total is 0.
    """
    names = ("provider", "tool", "action_taken")
    kinds = F.array(F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name")), *(F.struct(F.lit(n).alias("kind"), F.col(n).alias("name")) for n in names))
    counted = events.select(F.explode(kinds).alias("k")).where("k.kind = 'total' or k.name is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k.kind", "k.name", "n")
    zero = events.sparkSession.range(1).select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("n"))
    total = counted.unionByName(zero).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    flags = top_flags(events, []).select(F.lit("flag").alias("kind"), F.col("flag").alias("name"), "n")
    return total.unionByName(flags)


def interventions(events: DataFrame, after: int | None = None) -> DataFrame:
    """Events that touched a request, newer than the cursor; at most one for each second, the first by id."""
    some = events.where(F.col("action_taken").isin("block", "redact", "warn"))
    if after is not None:
        some = some.where(F.col("ts_unix") > after)
    first = Window.partitionBy("ts_unix").orderBy("id")
    return some.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def without_raw(df: DataFrame, raw: list[str]) -> Column:
    """true where no raw value stands in the row's JSON."""
    text = F.to_json(F.struct(*df.columns))
    return ~reduce(lambda a, b: a | b, (F.contains(text, F.lit(r)) for r in raw), F.lit(False))


def as_json(events: DataFrame) -> DataFrame:
    """K7: each event as a JSON line ``value``."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def telemetry(events: DataFrame, n_rules: int, version: str, uptime_s: int) -> DataFrame:
    """One row of counters, nothing else."""
    return events.agg(F.count(F.lit(1)).alias("event_count")).select(F.lit(version).alias("version"), F.lit(uptime_s).alias("uptime_s"), F.lit(n_rules).alias("rule_count"), "event_count")
