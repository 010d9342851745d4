"""Queries on audit events, routing and decisions, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.cleaning import EVENT_SECONDS_SQL, clean, clean_sql, event_seconds
from ..operators import audit, decision, grants, routing
from ..operators.dedup import latest_per_key
from ..session import Stage, read_table
from ..streaming.audit_stream import counted_windows

#: A fixed clock for queries that need one: the end of the table's days.
NOW = 1_745_884_800


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events: of each id the delivery that came last, names cleaned, a time in seconds, counts by cleaned flag."""
    entries = F.array_sort(F.map_entries("counts"))
    events = latest_per_key(
        read_table(spark, sf_dir, "audit_events"), "id", "received_at",
        {
            "provider": F.coalesce(clean(F.col("provider")), F.lit("unknown")), "tool": clean(F.col("tool")), "action_taken": clean(F.col("action_taken")), "mode": clean(F.col("mode")),
            "ts_unix": event_seconds(F.col("ts_unix"), F.col("ts")), "entries": F.transform(entries, lambda e: F.struct(clean(e["key"]).alias("key"), e["value"].alias("value"))),
        },
    )
    return events.withColumnRenamed("entries", "counts")


def stats_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audit.stats_by(_events(spark, sf_dir), "provider")
    return s.select("provider", "total", F.coalesce(F.element_at("by_action", F.lit("block")), F.lit(0)).alias("blocked"), F.coalesce(F.element_at("by_action", F.lit("warn")), F.lit(0)).alias("warned"))


def stats_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audit.stats_by(_events(spark, sf_dir).where("tool is not null"), "tool")
    actions = F.array_join(F.transform(F.map_entries("by_action"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("tool", "total", actions.alias("actions"))


def top_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_flags(_events(spark, sf_dir), []).select("flag", "n", "place")


def top_flags_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_flags(_events(spark, sf_dir), ["provider"])


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each kind and name, with the flags most often found."""
    return audit.summary(_events(spark, sf_dir))


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events; the limit is the feature."""
    return audit.recent(_events(spark, sf_dir).where("ts_unix is not null").select("id", "ts_unix"), 100)


def recent_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters after the newest events were taken."""
    return audit.recent_filtered(_events(spark, sf_dir).where("ts_unix is not null").select("id", "ts_unix", "provider"), provider="openai", n=1000)


def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = text.parse_since("30d", NOW)
    return audit.filtered(_events(spark, sf_dir), provider="anthropic", since=since).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def events_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two sources of events by id, memory first."""
    e = _events(spark, sf_dir).where("ts_unix is not null").select("id", "ts_unix", "mode")
    memory = e.where("mode = 'api'").withColumn("mode", F.lit("memory"))
    return audit.snapshot(memory, e, 500)


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.retained(_events(spark, sf_dir), NOW, 90).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether all their hashes are keyed; hashes of ids that end with 0 are made plain here."""
    e = read_table(spark, sf_dir, "audit_events").select("id", F.when(F.col("id").endswith("0"), F.transform("hashed_values", lambda h: F.replace(h, F.lit("hmac:"), F.lit("sha256:")))).otherwise(F.col("hashed_values")).alias("hashed_values"))
    ok, rejected = audit.gate(e)
    return ok.select(F.lit("written").alias("outcome")).unionByName(rejected.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that touched a request, one for each second."""
    return audit.interventions(_events(spark, sf_dir).where("ts_unix is not null")).select("ts_unix", "id")


def telemetry_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.telemetry(_events(spark, sf_dir), 15, "1.0.0", 60)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "audit_events").select(clean(F.col("provider")).alias("p")).where("p is not null")
    return e.select(F.concat(F.lit("/"), "p", F.when(F.col("p") == "gemini", "/v2/chat").otherwise("/v1/chat")).alias("path")).distinct()


def route_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = read_table(spark, sf_dir, "upstreams")
    return routing.with_mode(routing.route(_requests(spark, sf_dir), "path", up), up).select("path", "upstream", "mode")


def route_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = read_table(spark, sf_dir, "upstreams")
    hosts = up.select(text.url_host(F.col("url")).alias("host")).distinct().unionByName(up.select(F.upper("name").alias("host"))).unionByName(spark.createDataFrame([("other.example",)], "host string"))
    return routing.route_host(hosts, "host", up).select("host", "upstream")


def provider_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("path", text.provider_of_path(F.col("path")).alias("provider"))


FX_DECISIONS = [
    (i, *row)
    for i, row in enumerate(
        (o, n, m, p, b, d, r, k, o == "block" or i % 2 == 1, large)
        for i, (o, n) in enumerate((("allow", 0), ("allow", 1), ("warn", 1), ("redact", 1), ("redact", 2), ("block", 1))) for m in ("enforce", "shadow") for p in ("open", "closed", "closed-on-critical")
        for b in (None, "bypass", "break-glass") for d in (False, True) for r in (False, True) for k, large in ((0, False), (2, False), (1, True))
    )
]


def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of strongest action, findings, mode, fail policy, bypass, failures, binary parts and size."""
    kind = "id int, overall string, n_findings int, mode string, fail_policy string, bypass string, decode_failed boolean, redact_failed boolean, binary_parts int, has_critical boolean, too_large boolean"
    return decision.decide(spark.createDataFrame(FX_DECISIONS, kind)).select("id", "outcome", "forwarded", "http_status", F.when(F.col("has_event"), F.col("action_taken")).alias("action_taken"), F.array_join("audit_flags", ",").alias("audit_flags"), "has_event")


FX_UPSTREAMS = [("default", None), ("openai", None), ("mistral", "/m/"), ("alpha", "/openai/v9/"), ("beta", "/openai/v9/"), ("long", "/openai/v9/chat/"), ("Groq", None)]
FX_PATHS = ["/openai/v1", "/openai/v9/x", "/openai/v9/chat/y", "/anthropic/v1", "/mistral/v1", "/m/v1", "/groq/v1", "/", "", "/openai", "openai/v1"]


def route_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing where built-in providers have no upstream, with and without a ``default``."""
    ups = spark.createDataFrame(FX_UPSTREAMS, "name string, path_prefix string")
    paths = spark.createDataFrame([(p,) for p in FX_PATHS], "path string")
    bare = routing.route(paths, "path", ups.where("name <> 'default'")).select("path", F.col("upstream").alias("without_default"))
    return routing.route(paths, "path", ups).select("path", "upstream").join(bare, "path")


FX_GRANTS = [("n1", "openai", 100, 60), ("n2", "*", 100, None), ("n3", "gemini", 100, 99999), ("n5", "groq", 100, 60), ("n6", "*", 100, 60)]
FX_ATTEMPTS = [
    ("n1", "gemini", 110), ("n1", "openai", 120), ("n1", "openai", 130), ("n2", "mistral", 161), ("n2", "mistral", 162), ("n3", "gemini", 3700), ("n4", "openai", 5), ("n5", "groq", 159), ("n6", "groq", 160), ("n6", "groq", 159),
]


def grant_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame(FX_GRANTS, "nonce string, scope string, issued_at bigint, ttl_s int")
    return grants.redeem(given, spark.createDataFrame(FX_ATTEMPTS, "nonce string, provider string, at bigint"))


def _streamed_windows(spark: SparkSession, source: Stage) -> DataFrame:
    """A stream that runs over what there is and counts in windows of a day."""
    import os
    import uuid

    from ..session import shared_dir

    place = os.path.join(shared_dir(spark), f"duskveil-stream-{uuid.uuid4().hex}")
    windows = counted_windows(spark.readStream.schema(source.df.schema).parquet(source.path), "1 day", "400 days")

    def keep_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")

    query = windows.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep_batch).start()
    query.awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{place}/out").withColumn("on_day", F.date_format("window_start", "yyyy-MM-dd"))


def windows_of_all(events: DataFrame) -> DataFrame:
    """Events and findings of each provider and day by a stream over every row, repeated ids included.

    The rows of one id stand in one file, the latest received first: the stream keeps the first it meets. An event
    without a time is in no window.
    """
    timed = events.select("id", clean(F.col("provider")).alias("provider"), event_seconds(F.col("ts_unix"), F.col("ts")).alias("ts_unix"), "counts", "received_at")
    source = Stage(timed.repartition("id").sortWithinPartitions("id", F.desc("received_at")).drop("received_at"), "stream-source")
    return _streamed_windows(events.sparkSession, source).select("on_day", "provider", "n_events", "n_findings")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and findings of each provider and day, the whole table through the stream."""
    return windows_of_all(read_table(spark, sf_dir, "audit_events"))


QUERIES = {
    f.__name__: f
    for f in (
        stats_by_provider, stats_by_tool, top_flags, top_flags_by_provider, stats_summary, recent_events, recent_openai, events_since, events_snapshot, retention_keep, write_gate,
        interventions, telemetry_row, route_longest_prefix, route_host, provider_of_path, route_fallbacks, decision_table, grant_replay, stream_windows,
    )
}

_EV = f"""raw as (select * from audit_events qualify row_number() over (partition by id order by received_at desc) = 1),
ev as (select id, coalesce({clean_sql('provider')}, 'unknown') as provider, {clean_sql('tool')} as tool, {clean_sql('action_taken')} as action_taken, {clean_sql('mode')} as mode, {EVENT_SECONDS_SQL} as ts_unix, counts from raw)"""
_COUNTS = f"{_EV}, c as (select provider, unnest(map_entries(counts)) as e from ev), s as (select provider, {clean_sql('e.key')} as flag, sum(coalesce(e.value, 0))::bigint as n from c group by all)"
_REQUESTS = f"r as (select distinct '/' || p || case when p = 'gemini' then '/v2/chat' else '/v1/chat' end as path from (select {clean_sql('provider')} as p from audit_events) where p is not null)"
ORACLES = {
    "stats_by_provider": f"with {_EV} select provider, count(*) as total, count(*) filter (action_taken = 'block') as blocked, count(*) filter (action_taken = 'warn') as warned from ev group by provider",
    "stats_by_tool": f"""with {_EV}, a as (select tool, action_taken, count(*) as n from ev where tool is not null group by all)
    select tool, sum(n)::bigint as total, coalesce(string_agg(action_taken || '=' || n, ',' order by action_taken) filter (action_taken is not null), '') as actions from a group by tool""",
    "top_flags": f"with {_COUNTS}, t as (select flag, sum(n)::bigint as n from s group by flag) select flag, n, row_number() over (order by n desc, flag) as place from t qualify place <= 10",
    "top_flags_by_provider": f"with {_COUNTS} select provider, flag, n, row_number() over (partition by provider order by n desc, flag) as place from s qualify place <= 10",
    "stats_summary": f"""with {_COUNTS}, t as (select flag, sum(n)::bigint as n from s group by flag order by n desc, flag limit 10)
    select 'total' as kind, null as name, count(*) as n from ev union all select 'provider', provider, count(*) from ev group by provider union all select 'tool', tool, count(*) from ev where tool is not null group by tool
    union all select 'action_taken', action_taken, count(*) from ev where action_taken is not null group by action_taken union all select 'flag', flag, n from t""",
    "recent_events": f"with {_EV} select id, ts_unix from ev where ts_unix is not null order by ts_unix desc, id limit 100",
    "recent_openai": f"with {_EV}, r as (select id, ts_unix, provider from ev where ts_unix is not null order by ts_unix desc, id limit 1000) select * from r where provider = 'openai'",
    "events_since": f"with {_EV} select tool, count(*) as n from ev where provider = 'anthropic' and ts_unix >= {NOW - 30 * 86400} group by tool",
    "events_snapshot": f"""with {_EV}, e as (select id, ts_unix, mode from ev where ts_unix is not null),
    r as (select * from e order by ts_unix desc, id limit 500),
    b as (select id, ts_unix, 'memory' as mode from e where mode = 'api' union all select * from r where coalesce(mode, '') <> 'api')
    select * from b order by ts_unix desc, id limit 500""",
    "retention_keep": f"with {_EV} select mode, count(*) as n from ev where ts_unix >= {NOW - 90 * 86400} group by mode",
    "write_gate": """select case when len(list_filter(coalesce(hashed_values, []), lambda h: h is null or not starts_with(case when ends_with(id, '0') then replace(h, 'hmac:', 'sha256:') else h end, 'hmac:'))) = 0
    then 'written' else 'rejected' end as outcome, count(*) as n from audit_events group by 1""",
    "interventions": f"with {_EV} select ts_unix, min(id) as id from ev where ts_unix is not null and action_taken in ('block', 'redact', 'warn') group by ts_unix",
    "telemetry_row": f"with {_EV} select '1.0.0' as version, 60 as uptime_s, 15 as rule_count, count(*) as event_count from ev",
    "route_longest_prefix": f"""with {_REQUESTS},
    j as (select r.path, u.name, length(u.path_prefix) as n from r left join upstreams u on length(u.path_prefix) > 0 and starts_with(r.path, u.path_prefix)),
    b as (select path, name from j qualify row_number() over (partition by path order by n desc nulls last, name) = 1),
    k as (select path, name, regexp_extract(path, '^/(openai|anthropic|gemini|mistral|groq)/', 1) as own from b),
    c as (select path, case when name is not null then name when own in (select name from upstreams) then own when exists (select 1 from upstreams where name = 'default') then 'default' else 'unknown' end as upstream from k)
    select path, upstream, coalesce((select lower(min(mode)) from upstreams u where u.name = upstream and mode is not null), 'enforce') as mode from c""",
    "route_host": """with h as (select distinct lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) as host from upstreams union all select upper(name) from upstreams union all select 'other.example')
    select host, coalesce((select min(name) from upstreams where lower(name) = lower(host)), (select min(name) from upstreams where lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) = lower(host)), host) as upstream from h""",
    "provider_of_path": f"with {_REQUESTS} select path, coalesce(nullif(regexp_extract(path, '^/(openai|anthropic|gemini|mistral|groq)/', 1), ''), 'unknown') as provider from r",
    # One select for each way a request can go, in the order in which it is handled.
    "decision_table": "with t(id, overall, n, mode, policy, bypass, undecoded, unredacted, parts, critical, large) as (values "
    + ", ".join("(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in FX_DECISIONS)
    + """), big as (select * from t where large), l1 as (select * from t where not large),
    undec as (select * from l1 where undecoded and policy <> 'open'), l2 as (select * from l1 where not (undecoded and policy <> 'open')),
    stopped as (select * from l2 where mode = 'enforce' and overall = 'block' and bypass is null), l3 as (select * from l2 where not (mode = 'enforce' and overall = 'block' and bypass is null)),
    failed as (select *, policy = 'open' or (policy = 'closed-on-critical' and not critical) as lenient from l3 where mode = 'enforce' and overall = 'redact' and unredacted),
    fine as (select * from l3 where not (mode = 'enforce' and overall = 'redact' and unredacted)),
    own as (select id, n > 0 and bypass is not null as b, n > 0 and bypass = 'break-glass' as g, undecoded as d, mode = 'shadow' and n > 0 as s, parts > 0 as p from l3)
    select id, 'too-large' as outcome, 'none' as forwarded, 413 as http_status, null as action_taken, '' as audit_flags, false as has_event from big
    union all select id, 'reject-undecoded', 'none', 502, 'fail-closed', 'decode-failed', true from undec
    union all select id, 'block', 'none', 403, case when n > 0 then 'block' end, '', n > 0 from stopped
    union all select id, 'reject-unredacted', 'none', 502, 'fail-closed', concat_ws(',', case when d then 'decode-failed' end, case when p then 'binary-unscanned' end, 'redact-failed'), true from failed join own using (id) where not lenient
    union all select id, 'forward', 'original', 200, 'fail-open', concat_ws(',', case when b then 'bypass' end, case when g then 'break-glass' end, case when d then 'decode-failed' end, case when p then 'binary-unscanned' end, 'redact-failed'), true
      from failed join own using (id) where lenient
    union all select id, case when mode = 'enforce' and overall = 'redact' then 'forward-redacted' else 'forward' end, case when mode = 'enforce' and overall = 'redact' then 'redacted' else 'original' end, 200,
      case when n > 0 and bypass is not null then 'bypass' when n > 0 then overall when d then 'fail-open' when p then 'allow' end,
      concat_ws(',', case when b then 'bypass' end, case when g then 'break-glass' end, case when d then 'decode-failed' end, case when s then 'shadow' end, case when p then 'binary-unscanned' end), n > 0 or d or p
      from fine join own using (id)""",
    "route_fallbacks": """select * from (values ('/openai/v1', 'openai', 'openai'), ('/openai/v9/x', 'alpha', 'alpha'), ('/openai/v9/chat/y', 'long', 'long'), ('/anthropic/v1', 'default', 'unknown'), ('/mistral/v1', 'mistral', 'mistral'),
    ('/m/v1', 'mistral', 'mistral'), ('/groq/v1', 'default', 'unknown'), ('/', 'default', 'unknown'), ('', 'default', 'unknown'), ('/openai', 'default', 'unknown'), ('openai/v1', 'default', 'unknown')) as t(path, upstream, without_default)""",
    "grant_replay": """select * from (values ('n1', 'gemini', 110, 'scope-mismatch'), ('n1', 'openai', 120, 'granted'), ('n1', 'openai', 130, 'unknown-nonce'), ('n2', 'mistral', 161, 'expired'),
    ('n2', 'mistral', 162, 'unknown-nonce'), ('n3', 'gemini', 3700, 'expired'), ('n4', 'openai', 5, 'unknown-nonce'),
    ('n5', 'groq', 159, 'granted'), ('n6', 'groq', 159, 'granted'), ('n6', 'groq', 160, 'unknown-nonce')) as t(nonce, provider, "at", result)""",
    "stream_windows": f"""with {_EV} select strftime(make_timestamp(ts_unix * 1000000), '%Y-%m-%d') as on_day, provider, count(*) as n_events, sum(coalesce(list_sum(map_values(counts)), 0))::bigint as n_findings
    from ev where ts_unix is not null group by all""",
}
