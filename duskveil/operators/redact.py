"""Redaction of findings and its way back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = "[REDACTED:{flag}]"
VAULT_CAPACITY, VAULT_TTL_S = 1024, 300
_RESULT = "struct<text:string,blocked_by:string>"
_SPANS = "array<struct<start:int,end:int,flag:string,act_rank:int>>"


def resolved(spans: list[dict]) -> list[dict]:
    """R2: spans in the order of their start (ties in the given order); one that overlaps the last kept is dropped unless its action is stronger, then it takes the place."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and out[-1]["end"] > s["start"]:
            if s["act_rank"] > out[-1]["act_rank"]:
                out[-1] = s
            continue
        out.append(s)
    return out


def token(flag: str, size: int, template: str = TEMPLATE, preserve_length: bool = False) -> str:
    """Replacement text; with ``preserve_length`` exactly ``size`` bytes."""
    text = template.replace("{flag}", flag)
    if not preserve_length:
        return text
    cut = text.encode()[:size].decode("utf-8", "ignore")
    return cut + "*" * (size - len(cut.encode()))


def redact_text(text: str, spans: list[dict], template: str = TEMPLATE, preserve_length: bool = False, make=None) -> tuple[str | None, str | None]:
    """Text with all ``redact`` spans replaced, or None and the flag that blocks it.

    A span out of bounds or a finding to block stops it; spans are bytes.
    """
    if not spans:
        return text, None
    data = text.encode("utf-8", "surrogatepass")
    for s in spans:
        if not 0 <= s["start"] <= s["end"] <= len(data):
            return None, s["flag"]
    for s in spans:
        if s["act_rank"] == 3:
            return None, s["flag"]
    for s in reversed(resolved(spans)):
        if s["act_rank"] == 2:
            new = make(s, data[s["start"] : s["end"]]) if make else token(s["flag"], s["end"] - s["start"], template, preserve_length)
            data = data[: s["start"]] + new.encode() + data[s["end"] :]
    return data.decode("utf-8", "surrogatepass"), None


def with_spans(df: DataFrame, findings: DataFrame, ids: list[str]) -> DataFrame:
    """Texts with their findings as one array, in reported order; a text without findings has an empty one."""
    spans = findings.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "flag", "act_rank"))).alias("__s"))
    packed = spans.withColumn("__s", F.transform("__s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["flag"].alias("flag"), s["act_rank"].alias("act_rank"))))
    return df.join(packed, ids, "left").withColumn("__s", F.coalesce("__s", F.array().cast(_SPANS)))


def redact(df: DataFrame, findings: DataFrame, ids: list[str], text: str, template: str = TEMPLATE, preserve_length: bool = False) -> DataFrame:
    """``df`` with ``redacted_text`` and ``blocked_by`` (the flag that forbids the text, then the text is null).

    Texts without findings never leave the JVM. Null texts stay null. The findings of one text are
    bounded by its length.
    """

    @F.pandas_udf(_RESULT)
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            done = [(None, None) if t is None else redact_text(t, list(s), template, preserve_length) for t, s in zip(texts, spans, strict=True)]
            yield pd.DataFrame(done, columns=["text", "blocked_by"])

    has = F.size("__s") > 0
    out = with_spans(df, findings, ids).withColumn("__r", apply(F.when(has, F.col(text)), F.when(has, F.col("__s"))))
    return (
        out.withColumn("redacted_text", F.when(has, F.col("__r.text")).otherwise(F.col(text)))
        .withColumn("blocked_by", F.when(has, F.col("__r.blocked_by")))
        .drop("__s", "__r")
    )


def redact_reversible(df: DataFrame, findings: DataFrame, ids: list[str], text: str, salt: str) -> DataFrame:
    """Like ``redact`` with vault tokens; adds ``vault``, an array of (token, flag, value).

    A token is 128 bits of a hash of salt, ids and place, so a lost task yields the same tokens
    again; with a secret random salt they cannot be guessed.
    """
    import hashlib

    kind = "struct<text:string,blocked_by:string,vault:array<struct<token:string,flag:string,value:string>>>"

    @F.pandas_udf(kind)
    def apply(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans, keys in parts:
            rows = []
            for t, s, k in zip(texts, spans, keys, strict=True):
                vault: list[dict] = []

                def make(span: dict, raw: bytes, k=k, vault=vault) -> str:
                    name = hashlib.sha256(f"{salt}\0{k}\0{span['start']}\0{span['end']}".encode()).hexdigest()[:32]
                    vault.append({"token": name, "flag": span["flag"], "value": raw.decode("utf-8", "surrogatepass")})
                    return f"[VAULT:{name}]"

                done = (None, None) if t is None else redact_text(t, list(s), make=make)
                rows.append((*done, vault if done[0] is not None else []))
            yield pd.DataFrame(rows, columns=["text", "blocked_by", "vault"])

    key = F.concat_ws("\0", *(F.col(c).cast("string") for c in ids))
    out = with_spans(df, findings, ids).withColumn("__r", apply(F.col(text), F.col("__s"), key))
    return out.select(*df.columns, F.col("__r.text").alias("redacted_text"), F.col("__r.blocked_by").alias("blocked_by"), F.col("__r.vault").alias("vault"))


def vault_table(redacted: DataFrame, stored_at: Column) -> DataFrame:
    """Side table ``token, flag, value, stored_at`` (epoch seconds) of all tokens."""
    return redacted.select(F.explode("vault").alias("v"), stored_at.alias("stored_at")).select("v.token", "v.flag", "v.value", "stored_at")


def live_entries(vault: DataFrame, now: int, ttl: int = VAULT_TTL_S, capacity: int = VAULT_CAPACITY) -> DataFrame:
    """Entries that have not expired, of these the newest ``capacity`` (first in, first out)."""
    fresh = vault.where(F.col("stored_at") + ttl > now)
    return fresh.orderBy(F.desc("stored_at"), F.desc("token")).limit(capacity)


def unredact(df: DataFrame, ids: list[str], text: str, vault: DataFrame) -> DataFrame:
    """Every known token replaced by its value; unknown ones stay. Adds ``restored_text``.

    Tokens of a text are exploded, joined with the vault on the token, and folded back.
    """
    pieces = F.split(F.col(text), r"(?=\[VAULT:[0-9a-f]{32}\])|(?<=\[VAULT:[0-9a-f]{32}\])", -1)
    parts = df.where(F.col(text).contains("[VAULT:")).select(*ids, F.posexplode(pieces).alias("i", "p"))
    parts = parts.withColumn("token", F.nullif(F.regexp_extract("p", r"\A\[VAULT:([0-9a-f]{32})\]\z", 1), F.lit("")))
    known = vault.groupBy("token").agg(F.min("value").alias("value"))
    back = (
        parts.join(known, "token", "left")
        .groupBy(*ids)
        .agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", "p").alias("p")))).alias("s"))
        .select(*ids, F.array_join(F.col("s.p"), "").alias("restored_text"))
    )
    return df.join(back, ids, "left").withColumn("restored_text", F.coalesce("restored_text", text))


_TOKEN = re.compile(r"\[VAULT:([0-9a-f]{32})\]")
_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def unredact_json(body: str, values: dict[str, str]) -> str:
    """Tokens inside JSON strings replaced by their escaped values; every other byte unchanged."""
    from .decode import json_escape

    return _JSON_STRING.sub(lambda s: _TOKEN.sub(lambda m: json_escape(values[m.group(1)]) if m.group(1) in values else m.group(0), s.group(0)), body)
