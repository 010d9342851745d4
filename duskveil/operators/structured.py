"""Scan and redaction of JSON and multipart bodies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import decode, leaves, parse_json
from .redact import redact_text, resolved, token
from .rules import Rule
from .scan import scan


def scan_json(df: DataFrame, ids: list[str], body: str, rules: list[Rule], **options) -> tuple[DataFrame, DataFrame]:
    """Findings of JSON bodies: (decision findings, findings of the leaves with ``leaf_idx``).

    The flat text and every leaf are scanned with the whole body as context. J4: the decision holds
    the flat findings and those leaf findings whose (flag, hash) the flat ones lack; leaf findings
    that repeat are kept.
    """
    flat_source = decode(df.withColumn("__type", F.lit("application/json")), body, "__type").where("decoded.kind = 'json'").select(*ids, F.col("decoded.text").alias("__flat"), F.col(body).cast("string").alias("__body"))
    flat = scan(flat_source, ids, "__flat", rules, context="__body", **options)
    rows = leaves(df, ids, body).join(df.select(*ids, F.col(body).cast("string").alias("__body")), ids)
    by_leaf = scan(rows, [*ids, "leaf_idx"], "leaf", rules, context="__body", **options)
    rest = by_leaf.drop("leaf_idx").join(flat.select(*ids, "flag", "hashed_value").distinct(), [*ids, "flag", "hashed_value"], "left_anti")
    return flat.unionByName(rest.select(*flat.columns)), by_leaf


def uncovered(decision: DataFrame, by_leaf: DataFrame, ids: list[str]) -> DataFrame:
    """Findings to redact that stand in no leaf by (flag, hash); redaction of such a body must fail."""
    return decision.where("action = 'redact'").join(by_leaf.select(*ids, "flag", "hashed_value").distinct(), [*ids, "flag", "hashed_value"], "left_anti")


def redact_json(df: DataFrame, by_leaf: DataFrame, ids: list[str], body: str) -> DataFrame:
    """Adds ``redacted_body`` (leaves redacted, keys sorted, no spaces) and ``blocked_by``; null where it cannot be done."""
    packed = (
        by_leaf.groupBy(*ids)
        .agg(F.array_sort(F.collect_list(F.struct("leaf_idx", "seq", "start", "end", "flag", "act_rank"))).alias("s"))
        .select(*ids, F.transform("s", lambda x: F.struct(x["leaf_idx"].alias("leaf"), x["start"].alias("start"), x["end"].alias("end"), x["flag"].alias("flag"), x["act_rank"].alias("act_rank"))).alias("__s"))
    )

    @F.pandas_udf("struct<body:string,blocked_by:string>")
    def work(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, spans in parts:
            yield pd.DataFrame([_splice(b, s) for b, s in zip(bodies, spans, strict=True)], columns=["body", "blocked_by"])

    out = df.join(packed, ids, "left").withColumn("__r", work(F.col(body).cast("string"), "__s"))
    return out.select(*df.columns, F.col("__r.body").alias("redacted_body"), F.col("__r.blocked_by").alias("blocked_by"))


def _splice(body: str | None, spans) -> tuple[str | None, str | None]:
    try:
        tree = parse_json(body) if body is not None else None
    except (ValueError, RecursionError):
        return None, None
    if body is None:
        return None, None
    by_leaf: dict[int, list] = {}
    for s in [] if spans is None else spans:
        by_leaf.setdefault(s["leaf"], []).append(s)
    count, blocked = [0], []

    def walk(x):
        if isinstance(x, str):
            i, count[0] = count[0], count[0] + 1
            new, flag = redact_text(x, by_leaf.get(i, []))
            if flag is not None:
                blocked.append(flag)
            return new
        if isinstance(x, list):
            return [walk(y) for y in x]
        if isinstance(x, dict):
            return {k: walk(x[k]) for k in sorted(x)}
        return x

    done = walk(tree)
    return (None, blocked[0]) if blocked else (json.dumps(done, ensure_ascii=False, separators=(",", ":")), None)


def scan_multipart(df: DataFrame, ids: list[str], body: str, content_type: str, rules: list[Rule], **options) -> DataFrame:
    """Findings of the text regions of multipart bodies, with ``region_idx`` (J6: equal spans of one region once)."""
    decoded = decode(df, body, content_type).where("decoded.kind = 'multipart'")
    regions = decoded.select(*ids, F.posexplode("decoded.regions").alias("region_idx", "r"), F.col(body).cast("binary").alias("__b"), F.col("decoded.text").alias("__all"))
    texts = regions.select(*ids, "region_idx", "__all", F.make_valid_utf8(F.col("__b").substr(F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).cast("string")).alias("__t"))
    return scan(texts, [*ids, "region_idx"], "__t", rules, context="__all", **options)


def redact_bytes(raw: bytes, spans: list) -> tuple[bytes | None, str | None]:
    """Redaction of bytes by spans of their text form, in which every malformed sequence is one replacement character."""
    at = [0]  # raw offset of each byte of the text form
    text, pos = b"", 0
    while True:
        try:
            part = raw[pos:].decode("utf-8").encode()
            bad = 0
        except UnicodeDecodeError as e:
            part, bad = raw[pos : pos + e.start], e.end - e.start
        at += range(pos + 1, pos + len(part) + 1)
        text += part
        pos += len(part)
        if not bad:
            break
        text += "\ufffd".encode()
        at += [pos + bad] * 3
        pos += bad
    moved = [{"start": at[s["start"]], "end": at[s["end"]], "flag": s["flag"], "act_rank": s["act_rank"]} if 0 <= s["start"] <= s["end"] < len(at) else {"start": 1, "end": 0, "flag": s["flag"], "act_rank": s["act_rank"]} for s in spans]
    for s in moved:
        if s["start"] > s["end"] or s["act_rank"] == 3:
            return None, s["flag"]
    done = raw
    for s in reversed(resolved(moved)):
        if s["act_rank"] == 2:
            done = done[: s["start"]] + token(s["flag"], s["end"] - s["start"]).encode() + done[s["end"] :]
    return done, None


def redact_multipart(df: DataFrame, by_region: DataFrame, ids: list[str], body: str, content_type: str) -> DataFrame:
    """Adds ``redacted_body`` (binary) and ``blocked_by``; binary parts keep their bytes."""
    packed = (
        by_region.groupBy(*ids)
        .agg(F.array_sort(F.collect_list(F.struct("region_idx", "seq", "start", "end", "flag", "act_rank"))).alias("s"))
        .select(*ids, F.transform("s", lambda x: F.struct(x["region_idx"].alias("region"), x["start"].alias("start"), x["end"].alias("end"), x["flag"].alias("flag"), x["act_rank"].alias("act_rank"))).alias("__s"))
    )

    @F.pandas_udf("struct<body:binary,blocked_by:string>")
    def work(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, regions, spans in parts:
            rows = []
            for b, places, found in zip(bodies, regions, spans, strict=True):
                data, blocked = (None if b is None else bytes(b)), None
                for i in range(len(places) - 1 if places is not None else -1, -1, -1):
                    own = [s for s in (found if found is not None else []) if s["region"] == i]
                    a, z = places[i]["start"], places[i]["end"]
                    new, flag = redact_bytes(data[a:z], own) if own else (None, None)
                    if flag is not None:
                        blocked = flag
                    elif new is not None:
                        data = data[:a] + new + data[z:]
                rows.append((None, blocked) if blocked else (data, None))
            yield pd.DataFrame(rows, columns=["body", "blocked_by"])

    out = decode(df, body, content_type).join(packed, ids, "left").withColumn("__r", work(F.col(body).cast("binary"), "decoded.regions", "__s"))
    return out.select(*df.columns, F.col("__r.body").alias("redacted_body"), F.col("__r.blocked_by").alias("blocked_by"))
