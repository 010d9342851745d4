"""Sessions, trailing totals, latest rows: edge cases against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from duskveil.operators.dedup import latest_per_key
from duskveil.operators.rolling import rolling_totals
from duskveil.operators.sessions import sessions


def brute_sessions(rows, gap):
    by = {}
    for e, s in rows:
        if e is not None and s is not None:
            by.setdefault(e, []).append(s)
    out = []
    for e, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((e, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((e, start, last, n))
    return sorted(out)


def test_sessions_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(0, 40000)])) for _ in range(600)]
    rows += [("hot", i * 10) for i in range(3000)] + [("hot", 0)] * 5  # one long chain of many tiles, repeated rows
    rows += [("edge", 0), ("edge", 10), ("edge", 21), ("neg", -25), ("neg", -15), ("neg", 5)]
    df = spark.createDataFrame([(e, s, "x", 1) for e, s in rows], "e string, s bigint, tile string, lo int")
    for gap in (10, 1800):
        got = sorted(tuple(r) for r in sessions(df, "e", "s", gap).collect())
        assert got == brute_sessions(rows, gap)


def test_sessions_of_nothing(spark):
    assert sessions(spark.createDataFrame([], "e string, s bigint"), "e", "s", 5).collect() == []
    assert sessions(spark.createDataFrame([(None, 1), ("a", None)], "e string, s bigint"), "e", "s", 5).collect() == []
    with pytest.raises(ValueError):
        sessions(spark.createDataFrame([], "e string, s bigint"), "e", "s", 0)


def test_rolling_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(100, 260), rng.randrange(0, 9)) for _ in range(200)]
    rows += [("a", None, 3), ("b", 120, None), ("late", 259, 7)]
    df = spark.createDataFrame([(e, d, v, "x") for e, d, v in rows], "who string, day int, v bigint, e string")
    got = {(r["who"], r["day"]): r for r in rolling_totals(df, "who", "day", "v", 100, 259, tile_days=16).collect()}
    total = {}
    for e, d, v in rows:
        if d is not None:
            total[e, d] = total.get((e, d), 0) + (v or 0)
    assert len(got) == 4 * 160
    for e in ("a", "b", None, "late"):
        for d in range(100, 260):
            r = got[e, d]
            for w in (7, 30):
                some = [total.get((e, x), 0) for x in range(d - w + 1, d + 1)]
                assert (r[f"sum_{w}"], r[f"active_{w}"]) == (sum(some), sum(v > 0 for v in some))
                assert r[f"avg_{w}"] == pytest.approx(sum(some) / w)


def test_rolling_of_nothing(spark):
    assert rolling_totals(spark.createDataFrame([], "e string, d int, v bigint"), "e", "d", "v", 0, 3).collect() == []


def test_latest_per_key(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 1, "p"), (None, 1, "p"), (None, 1, "q")], "id string, at int, v string"
    )
    got = sorted(((r["id"], r["v"]) for r in latest_per_key(df, "id", "at", {"v": F.col("v")}).collect()), key=str)
    assert got == sorted([("a", "z"), ("b", "n"), (None, "p"), (None, "q")], key=str)
