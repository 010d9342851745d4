"""Pairs, terms and mixes against brute force; edge cases."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskveil.functions.cleaning import clean
from duskveil.llm.cooccurrence import cooccurrence, distinct_items
from duskveil.llm.mixing import mix, pivotal, token_counts
from duskveil.llm.term_frequency import term_frequency


def test_pairs_match_brute_force(spark):
    rng = random.Random(2)
    baskets = [[rng.choice([" A", "a", "b\t", "C", "d", "", None]) for _ in range(rng.randrange(0, 6))] for _ in range(300)] + [None, []]
    df = spark.createDataFrame([(b, "x", 1) for b in baskets], "items array<string>, b string, w int")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in cooccurrence(df.withColumn("items", distinct_items(F.col("items"), clean)), "items").collect()}
    sets = [{x.strip().lower() for x in b or [] if x and x.strip()} for b in baskets]
    single, pair = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    assert got == {(a, b): (n, single[a], single[b], len(baskets)) for (a, b), n in pair.items()}


def test_pairs_of_nothing(spark):
    assert cooccurrence(spark.createDataFrame([], "items array<string>"), "items").collect() == []
    assert cooccurrence(spark.createDataFrame([(None,), (["a"],)], "items array<string>"), "items").collect() == []


def test_terms_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("fg"), rng.choice(["t1", "t2", "hot", None]), rng.choice(["r%d" % rng.randrange(40), None]), rng.randrange(1, 3)) for _ in range(500)]
    rows += [("f", "hot", f"r{i}", 1) for i in range(3000)]  # one term in far more records than the rest
    df = spark.createDataFrame([(*r, "x") for r in rows], "field_name string, term string, record string, times int, mark string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r["field_name"], r["term"]): (r["n_occurrences"], r["n_records"], r["mark"]) for r in term_frequency(df, 3000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    times, records = Counter(), {}
    for f, t, r, n in rows:
        if t is not None and r is not None:
            times[f, t] += n
            records.setdefault((f, t), set()).add(r)
    assert {k: v[:2] for k, v in got.items()} == {k: (times[k], len(records[k])) for k in times}
    assert got["f", "hot"][2] == "common" and all(v[2] is None for k, v in got.items() if k != ("f", "hot"))
    assert term_frequency(spark.createDataFrame([], "field_name string, term string, record string, times int"), 0).collect() == []


def test_pivotal_keeps_the_sum_and_the_expectations():
    rng = np.random.default_rng(1)
    p = rng.random(50) * 0.9 + 0.05
    mean = np.zeros(50)
    for _ in range(4000):
        out = pivotal(p, rng.random(50))
        assert ((out == 0) | (out == 1)).sum() >= 49 and out.sum() == pytest.approx(p.sum())
        mean += out
    assert np.abs(mean / 4000 - p).max() < 0.06


def documents(spark, n=1500):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(1, 60), "Big " if i % 3 == 0 else "mid" if i % 3 == 1 else "rare" if i % 50 == 2 else None) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "mid"), (n + 1, "", "big")], "doc_id bigint, text string, source string")


def test_mix_reaches_its_shares(spark):
    tokens = token_counts(documents(spark), "doc_id", clean(F.col("source")))
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 3), ("rare", 0.15, 2), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    copies, report = mix(tokens, targets, "doc_id")
    rows = copies.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == tokens.where("source is not null").count()
    limit = {"big": 1, "mid": 3, "rare": 2}
    assert all(0 <= r["copies"] <= limit[r["source"]] for r in rows)
    got = {r["source"]: r for r in report.collect()}
    for s in ("big", "mid"):
        assert got[s]["reachable"] and got[s]["mixed_tokens"] == pytest.approx(got[s]["target_tokens"], rel=0.01)
    assert not got["rare"]["reachable"] and got["rare"]["mixed_tokens"] == got["rare"]["capacity_tokens"] and not got["none"]["reachable"]
    for s in limit:
        n = sum(r["copies"] for r in rows if r["source"] == s)
        want = sum(1 for r in rows if r["source"] == s) * min(got[s]["target_tokens"] / got[s]["source_tokens"], limit[s])
        assert abs(n - want) <= 1  # the number of copies is rounded as a whole
    again, _ = mix(tokens, targets, "doc_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    copies, report = mix(empty, targets, "doc_id")
    assert copies.collect() == [] and [r["source"] for r in report.collect()] == ["a"]
    copies, report = mix(spark.createDataFrame([(1, "a", 5)], "doc_id bigint, source string, n_tokens bigint"), targets.limit(0), "doc_id")
    assert copies.collect() == [] and report.collect() == []
