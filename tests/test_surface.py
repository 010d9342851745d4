"""SQL functions, command line, sources, streaming, routing."""

import json

import pytest
from pyspark.sql import functions as F

from duskveil.__main__ import main
from duskveil.functions.sql import register
from duskveil.operators import decision, routing
from duskveil.operators.rules import DEFAULT_RULES, Policy, fingerprint, rule_dict
from duskveil.sources.packs import load_pack, load_packs
from duskveil.sources.tables import AUDIT_SCHEMA, audit_table, text_files
from duskveil.streaming.audit_stream import scan_stream, session_windows

TOKEN = "sk-" + "a1B2" * 6


def test_sql_functions(spark):
    register(spark)
    rows = spark.sql(f"select * from scan_text('x {TOKEN} y')").collect()
    assert ("secret.openai_api_key", 2, 29, TOKEN) in {tuple(r) for r in rows}
    assert spark.sql("select text_entropy('ab'), text_entropy(null)").first()[0] == 1.0


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"rules": [rule_dict(DEFAULT_RULES[0])]}))
    bad.write_text('[{"flag": "x", "category": "pii", "severity": "low", "patterns": ["("]}]')
    assert main(["validate", str(good)]) == 0 and main(["validate", str(bad)]) == 1
    assert "secret.openai_api_key" in capsys.readouterr().out


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\xff")
    assert text_files(spark, str(tmp_path / "a.txt")).first()["text"] == "one�"
    events = spark.createDataFrame([("a", '["f"]', '{"f": 2}', "[]")], "id string, flags string, counts string, hashed_values string")
    events.write.parquet(str(tmp_path / "e"))
    row = audit_table(spark, str(tmp_path / "e"), nested_as_json=True).first()
    assert row["flags"] == ["f"] and row["counts"] == {"f": 2} and "ts_unix" in AUDIT_SCHEMA
    pack = tmp_path / "packs"
    pack.mkdir()
    (pack / "p.json").write_text(json.dumps({"pack": {"name": "p", "version": "1", "rules": [rule_dict(DEFAULT_RULES[0])]}, "signature": "s"}))
    assert load_pack(str(pack / "p.json")).rules == [DEFAULT_RULES[0]] and len(load_packs(str(pack))) == 1


def test_allowlist():
    p = Policy().allow(" raw ", b"k").allow("raw", b"k")
    assert p.allowlist == [fingerprint("raw", b"k")] and p.disallow("raw", b"k").allowlist == []
    assert Policy(allowlist=["raw"]).migrated(b"k").allowlist == p.allowlist


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, f"key {TOKEN}"), (2, None)], "id int, text string").write.parquet(source)
    found = []
    query = scan_stream(spark.readStream.schema("id int, text string").parquet(source), ["id"], "text", lambda: DEFAULT_RULES, lambda df, n: found.extend(df.collect()))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["id"], r["flag"]) for r in found if r["flag"].startswith("secret")] == [(1, "secret.openai_api_key")]
    events = spark.createDataFrame([("t", 0), ("t", 1799), ("t", 9000), (None, 5)], "tool string, ts_unix bigint")
    assert sorted(r["n_events"] for r in session_windows(events).collect()) == [1, 2]


def test_routing_edge_cases(spark):
    up = spark.createDataFrame([("a", "https://H.x/1", "/p/", None), ("b", "https://h.x/2", "/p/q/", "Shadow"), ("c", None, None, None), (None, "u", "", None)], "name string, url string, path_prefix string, mode string")
    req = spark.createDataFrame([("/p/q/r",), ("/p/x",), ("/groq/v1",), ("/zz",), (None,)], "path string")
    got = {r["path"]: (r["upstream"], r["mode"]) for r in routing.with_mode(routing.route(req, "path", up), up).collect()}
    assert got == {"/p/q/r": ("b", "shadow"), "/p/x": ("a", "enforce"), "/groq/v1": ("unknown", "enforce"), "/zz": ("unknown", "enforce"), None: ("unknown", "enforce")}
    assert routing.route(req, "path", up.limit(0)).count() == 5


def test_decision_levels(spark):
    df = spark.createDataFrame([("block", "block"), ("forward", "warn"), ("forward", "allow")], "o string, a string")
    assert [r[0] for r in df.select(decision.log_level(F.col("o"), F.col("a"))).collect()] == ["error", "warn", "info"]


@pytest.mark.parametrize("name", ["duskveil.llm"])
def test_core_does_not_need_the_subpackage(name):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.modules['{name}'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'scan_flags' in q and 'p5_found' in q and 'p4_found' not in q and 'p1_found' not in e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root)
    assert done.returncode == 0, done.stderr


def test_stream_windows_over_the_whole_table(spark):
    """Milliseconds, missing times, repeated ids and counts: the stream gives what a batch does."""
    from duskveil.functions.cleaning import clean, event_seconds, map_total
    from duskveil.operators.dedup import latest_per_key
    from duskveil.plans.auditing import stream_windows, windows_of_all

    from .conftest import MEDIUM

    day = 1_740_000_000 // 86400 * 86400
    rows = [
        ("a", " OpenAI", day, {"x": 2, "y": None}, 1), ("a", "openai", day, {"x": 5}, 9), ("a", "openai", day, {"x": 3}, 2), ("b", "openai", (day + 60) * 1000, {"x": 1}, 1), ("b", "openai", (day + 60) * 1000, {"x": 1}, 1),
        ("c", None, day + 86400, None, 1), ("d", "gemini", None, {"x": 7}, 1), ("d", "gemini", None, {"x": 7}, 1),
        ("e", "gemini", day, {"x": 1}, 1), ("e", "gemini", None, {"x": 1}, 2), ("f", "gemini", None, None, 1),
    ]
    df = spark.createDataFrame(rows, "id string, provider string, ts_unix bigint, counts map<string,bigint>, r int")
    stamp = F.to_timestamp_ntz(F.lit("2025-02-20 10:00:00"))
    df = df.select("id", "provider", "ts_unix", "counts", F.when(F.col("id") == "d", stamp).alias("ts"), F.timestamp_seconds(F.col("r")).alias("received_at"))
    got = sorted(tuple(r) for r in windows_of_all(df).select("on_day", "provider", "n_events", "n_findings").collect())
    assert got == [("2025-02-19", "openai", 2, 6), ("2025-02-20", "gemini", 1, 7), ("2025-02-20", "unknown", 1, 0)]

    payload = {"provider": F.coalesce(clean(F.col("provider")), F.lit("unknown")), "s": event_seconds(F.col("ts_unix"), F.col("ts")), "n": map_total(F.col("counts"))}
    table = spark.read.parquet(f"{MEDIUM}/audit_events.parquet")
    once = latest_per_key(table, "id", "received_at", payload).where("s is not null")
    want = once.groupBy(F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd"), "provider").agg(F.count(F.lit(1)), F.sum("n"))
    got = stream_windows(spark, MEDIUM).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and table.count() > sum(r["n_events"] for r in got)
