"""The scan: rules over texts to findings.

Spans come from one of two engines. ``arrow`` scans each text of an Arrow batch once: patterns with
a required literal or keyword are tried only where it stands, card runs and entropy values follow.
``native`` is one projection: matches are marked by a replacement, the text is split at the marks,
byte offsets are summed along the pieces, all rules' arrays are concatenated and exploded once; only
card runs and entropy values, which need a sequential scan, go through an Arrow function. What
follows, constraints, validators, hashes and deduplication, is native for both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import finding_hash, unicode_trim
from ..functions.text import ACTIONS, SEVERITIES, rank, unrank
from ..functions.validators import all_pass
from . import entropy
from .cards import card_spans
from .guards import guard_of
from .rules import CARD_PATTERN, CARD_VALIDATOR, Rule, check_rules, is_multiline, java_pattern, python_pattern

SPAN = "array<struct<rule:int,phase:int,start:int,end:int,value:string,line:string>>"
_SPAN_FIELDS = {"rule": pa.int32(), "phase": pa.int32(), "start": pa.int32(), "end": pa.int32(), "value": pa.string(), "line": pa.string()}
OPEN, CLOSE = "\u0001", "\u0002"
MARKS = f"[{OPEN}{CLOSE}]"
_CARD_GUARD = r"[0-9][0-9 \x{a0}./-]{11,}[0-9]"
#: Every entropy keyword holds one of these; the two letters that fold to s and k may stand in one as well.
_FOLDED = ("\u017f", "\u212a")


def _may_have_keyword(text: Column) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [*(F.contains(lower, F.lit(p)) for p in entropy.PARTS), *(F.contains(text, F.lit(p)) for p in _FOLDED)])


ENTROPY_RULE = Rule(entropy.FLAG, "secrets", "medium", (), "warn")


def _java_class(run: str) -> str:
    """A run of a guard for the JVM: only the class's escapes differ."""
    return run.replace("\\ ", " ")


def _may_match(text: Column, pattern: str) -> Column:
    """A necessary condition of a match."""
    guard = guard_of(pattern)
    if guard.run is not None and not (guard.literals and min(map(len, guard.literals)) > 1):
        return text.rlike(_java_class(guard.run))
    if guard.literals is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in guard.literals))


def _spans(text: Column, number: int, phase: int, pattern: str, keywords: tuple[str, ...], near: Column | None) -> Column:
    """Spans of one pattern as an array of structs.

    Where the rule asks for context keywords, a text that holds none of them is not searched at all.
    """
    with_line = bool(keywords) and near is None
    java = java_pattern(pattern)
    pieces = F.split(F.regexp_replace(text, java, OPEN + "$0" + CLOSE), MARKS, -1)

    def starts(p: Column) -> Column:
        # Piece 1, 3, 5, ... are matches; the bytes of all pieces before one are its start.
        return F.aggregate(
            p, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, x: F.struct((acc["at"] + F.octet_length(x)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")),
        )["starts"]

    def build(bound: Column) -> Column:
        p, start = bound["p"], bound["starts"]

        def edge(i: Column, rest: Column, side: int) -> Column:
            # What of the line lies on one side: mostly in the next piece, else in all of them.
            piece = F.get(p, i)
            whole = F.when(F.contains(piece, F.lit("\n")), piece).otherwise(F.array_join(rest, ""))
            return F.substring_index(whole, "\n", side)

        def one(i: Column) -> Column:
            value, begin = F.get(p, i), F.get(start, i)
            line = F.concat(edge(i - 1, F.slice(p, F.lit(1), i), -1), value, edge(i + 1, F.slice(p, i + 2, F.size(p)), 1)) if with_line else F.lit(None).cast("string")
            return F.struct(
                F.lit(number).alias("rule"), F.lit(phase).alias("phase"), begin.cast("int").alias("start"),
                (begin + F.octet_length(value)).cast("int").alias("end"), value.alias("value"), line.alias("line"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one)

    # One-element arrays bind the pieces and their starts: a lambda's variable is computed once.
    paired = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), starts(p).alias("starts")))
    built = F.get(F.transform(paired, build), F.lit(0))
    can = _may_match(text, pattern)
    if keywords:
        lower = F.lower(text if near is None else near)
        folds = [F.contains(text if near is None else near, F.lit(c)) for c in _FOLDED]
        can = can & reduce(lambda a, b: a | b, [*(F.contains(lower, F.lit(k)) for k in keywords if k), *folds])
    return F.when(can & text.rlike(java), built).otherwise(F.array().cast(SPAN))


class _Search:
    """One pattern with its guard, compiled once for each task."""

    def __init__(self, number: int, rule: Rule, pattern: str) -> None:
        guard = guard_of(pattern)
        self.number, self.phase, self.pattern = number, _phase(pattern), python_pattern(pattern)
        self.keywords = tuple(k for k in rule.context_keywords if k)
        #: A single character says little; a run of few characters says more.
        telling = guard.literals is not None and (guard.run is None or min(map(len, guard.literals)) > 1)
        self.literals = guard.literals if telling else None
        self.run = None if telling or guard.run is None else guard.run

    def spans(self, text: str, runs: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
        if self.literals is not None and not any(x in text for x in self.literals):
            return
        if self.run is None:
            yield from (m.span() for m in self.pattern.finditer(text))
            return
        if self.run not in runs:
            runs[self.run] = [m.span() for m in _run(self.run).finditer(text)]
        for a, z in runs[self.run]:
            # One character more: what looks around a match looks at one at most.
            yield from (m.span() for m in self.pattern.finditer(text, a, min(len(text), z + 1)))


@lru_cache(maxsize=256)
def _run(pattern: str) -> re.Pattern:
    return re.compile(pattern)


class Scanner:
    """The sequential scan of one text after another; patterns are compiled once for each task."""

    def __init__(self, rules: list[Rule], cards: int | None, entropy_rule: int | None, threshold: float) -> None:
        self.rules, self.cards, self.entropy_rule, self.threshold = rules, cards, entropy_rule, threshold
        self.searches = [_Search(i, rule, p) for i, rule in enumerate(rules) if i != cards for p in rule.patterns]

    def spans(self, text: str, everything: bool = True, near: str | None = None) -> list[tuple]:
        """Spans with byte offsets, as rows of SPAN; ``everything``: those of the patterns too, not only cards and entropy.

        ``near`` is the text that context keywords are looked for in, the text itself by default; a
        rule none of whose keywords stands there is not tried.
        """
        found: list[tuple[int, int, int, int]] = []
        if everything:
            lower, runs = None, {}
            for search in self.searches:
                if search.keywords:
                    around = text if near is None else near
                    lower = around.lower() if lower is None else lower
                    if not any(k in lower for k in search.keywords) and not any(c in around for c in _FOLDED):
                        continue
                found += [(search.number, search.phase, a, z) for a, z in search.spans(text, runs)]
        if self.cards is not None:
            found += [(self.cards, 2, a, z) for a, z in card_spans(text)]
        if self.entropy_rule is not None:
            found += [(self.entropy_rule, 4, a, z) for a, z in entropy.entropy_spans(text, self.threshold)]
        if not found:
            return []
        bytes_at = {} if text.isascii() else _byte_offsets(text, {x for f in found for x in f[2:]})
        out = []
        for number, phase, a, z in found:
            line = None
            if number < len(self.rules) and self.rules[number].context_keywords:
                end = text.find("\n", z)
                line = text[text.rfind("\n", 0, a) + 1 : end if end >= 0 else len(text)]
            out.append((number, phase, bytes_at.get(a, a), bytes_at.get(z, z), text[a:z], line))
        return out


def _byte_offsets(text: str, places: set[int]) -> dict[int, int]:
    """UTF-8 offset of each character offset."""
    out, at, byte = {}, 0, 0
    for place in sorted(places):
        byte += len(text[at:place].encode("utf-8", "surrogatepass"))
        at = place
        out[place] = byte
    return out


def python_spans(text: str, rules: list[Rule], cards: int | None, entropy_rule: int | None, threshold: float, everything: bool) -> list[tuple]:
    """Spans of one text by the sequential scan, as rows of SPAN."""
    return Scanner(rules, cards, entropy_rule, threshold).spans(text, everything)


_PREFIX = re.compile(r"(?:\\[bB])*(?:[^\\()\[\].?*+|^${}]|\\[^A-Za-z0-9]){2}")


def _phase(pattern: str) -> int:
    """Order in which the scan reports: patterns that begin with two letters or more, others, cards, multi-line ones, entropy."""
    if is_multiline(pattern):
        return 3
    return 0 if _PREFIX.match(pattern) else 1


def _card_rule(rules: list[Rule]) -> int | None:
    return next((i for i, r in enumerate(rules) if r.patterns == (CARD_PATTERN,) and CARD_VALIDATOR in r.validators), None)


def _arrow_spans(base: DataFrame, ids: list[str], rules: list[Rule], entropy_threshold: float | None, context: bool) -> DataFrame:
    """All spans of all texts by the sequential scan over Arrow batches, one row each."""
    kept = [*ids, *(["__context"] if context else [])]
    kinds = dict(base.dtypes)
    cards, entropy_rule = _card_rule(rules), len(rules) if entropy_threshold is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, cards, entropy_rule, entropy_threshold or 0.0)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            nears = batch.column(len(ids)).to_pylist() if context else None
            at, found = [], []
            for i, text in enumerate(texts):
                if text:
                    spans = scanner.spans(text, near=(nears[i] or "") if context else None)
                    at += [i] * len(spans)
                    found += spans
            take, columns = pa.array(np.array(at, np.int64)), list(zip(*found, strict=True)) or [()] * len(_SPAN_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(len(kept))), *(pa.array(c, t) for c, t in zip(columns, _SPAN_FIELDS.values(), strict=True))], names=[*kept, *_SPAN_FIELDS]
            )

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", rule int, phase int, start int, `end` int, value string, line string"
    # Texts that can hold no finding never leave the JVM.
    some = base.where(_may_hold(F.col("__text"), rules, cards, entropy_threshold, F.col("__context") if context else None))
    return some.select(*kept, "__text").mapInArrow(work, fields)


def _may_hold(text: Column, rules: list[Rule], cards: int | None, threshold: float | None, near: Column | None) -> Column:
    """A necessary condition of any span, cheap parts first."""
    lower = F.lower(text if near is None else near)
    parts: list[Column] = []
    for i, rule in enumerate(rules):
        if i == cards:
            parts.append(text.rlike(_CARD_GUARD))
            continue
        for pattern in rule.patterns:
            can = _may_match(text, pattern)
            words = [F.contains(lower, F.lit(k)) for k in rule.context_keywords if k]
            if words:
                folded = [F.contains(text if near is None else near, F.lit(c)) for c in _FOLDED]
                can = can & reduce(lambda a, b: a | b, [*words, *folded])
            parts.append(can)
    if threshold is not None:
        parts.append(_may_have_keyword(text) & text.rlike(entropy.long_run(threshold)))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def spans_column(text: Column, rules: list[Rule], entropy_threshold: float | None, near: Column | None = None) -> Column:
    """All spans of a text as one array, before lengths, examples, validators and the exact look at context keywords.

    ``near``: the column that keywords are looked for in, if it is not the match's own lines.
    """
    cards = _card_rule(rules)
    native = [_spans(text, i, _phase(p), p, rule.context_keywords, near) for i, rule in enumerate(rules) if i != cards for p in rule.patterns]
    entropy_rule = len(rules) if entropy_threshold is not None else None

    @F.pandas_udf(SPAN)
    def sequential(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules, cards, entropy_rule, entropy_threshold or 0.0)
        for texts in chunks:
            yield pd.Series([[] if t is None else scanner.spans(t, OPEN in t or CLOSE in t) for t in texts])

    marked = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    guards = [marked]
    if cards is not None:
        guards.append(text.rlike(_CARD_GUARD))
    if entropy_rule is not None:
        guards.append(_may_have_keyword(text))
    sent = F.when(reduce(lambda a, b: a | b, guards), text)
    arrays = F.concat(*native) if native else F.array().cast(SPAN)
    return F.concat(F.when(marked, F.array().cast(SPAN)).otherwise(arrays), F.coalesce(sequential(sent), F.array().cast(SPAN)))


def keyword_pattern(keywords: tuple[str, ...]) -> str:
    """any keyword between characters that are no word characters; the underscore is none. Empty keywords match nothing."""
    words = [f"\\Q{k}\\E" for k in keywords if k]
    return r"(?iuU)(?<![\w&&[^_]])(?:" + "|".join(words) + r")(?![\w&&[^_]])" if words else r"(?!)"


def scan(
    df: DataFrame, ids: list[str], text: str, rules: list[Rule], *, key: bytes | None = None, context: str | None = None,
    entropy_threshold: float | None = entropy.DEFAULT_THRESHOLD, keep_value: bool = False, engine: str = "arrow",
) -> DataFrame:
    """Findings of all texts, one row each.

    ``engine``: ``arrow`` finds spans by a sequential scan over Arrow batches, ``native`` by JVM
    expressions (see the module's text). Both give the same; the first was measured to take about
    half of the CPU time, since the JVM's matcher walks the text once for every pattern and converts
    it each time.

    ``ids, seq, flag, category, severity, sev_rank, action, act_rank, start, end, hashed_value``;
    offsets are UTF-8 bytes, end exclusive. ``seq`` is the order in which a sequential scan reports.
    Length limits, examples, validators and the hash look at the value without white space at its
    ends, the span is the whole match. Context keywords must stand on a line the match touches or,
    with ``context``, anywhere in that column. Equal (flag, start, end) of one text are one finding.

    Nulls: null and empty texts have no findings, null ids are kept. Equal rows are scanned each for
    itself only if their ids differ; equal ids share one set of findings. Other columns are ignored.
    """
    rules = check_rules(rules)
    base = df.select(*ids, F.col(text).alias("__text"), *([F.col(context).alias("__context")] if context else []))
    if engine not in ("arrow", "native"):
        raise ValueError(f"unknown engine: {engine}")
    if engine == "arrow":
        found = _arrow_spans(base, ids, rules, entropy_threshold, context is not None)
    else:
        found = base.select(*ids, *(["__context"] if context else []), F.explode(spans_column(F.col("__text"), rules, entropy_threshold, F.col("__context") if context else None)).alias("__s"))
        found = found.select(*ids, *(["__context"] if context else []), *(F.col(f"__s.{n}").alias(n) for n in _SPAN_FIELDS))
    value = unicode_trim(F.col("value"))
    keep = F.lit(True)
    for i, rule in enumerate(rules):
        own = F.lit(True)
        if rule.min_length is not None:
            own = own & (F.octet_length(value) >= rule.min_length)
        if rule.max_length is not None:
            own = own & (F.octet_length(value) <= rule.max_length)
        if rule.allowed_examples:
            own = own & ~value.isin(*rule.allowed_examples)
        if rule.context_keywords:
            own = own & F.coalesce(F.col("__context" if context else "line").rlike(keyword_pattern(rule.context_keywords)), F.lit(False))
        keep = keep & ((F.col("rule") != i) | own)
    for checks in dict.fromkeys(r.validators for r in rules if r.validators):
        numbers = [i for i, r in enumerate(rules) if r.validators == checks]
        keep = keep & (~F.col("rule").isin(*numbers) | all_pass(list(checks), value))
    every = [*rules, ENTROPY_RULE]

    def of_rule(field: str) -> Column:
        return F.get(F.array(*(F.lit(getattr(r, field)) for r in every)), F.col("rule"))

    out = (
        found.where(keep)
        .withColumns({"flag": of_rule("flag"), "category": of_rule("category"), "severity": of_rule("severity"), "action": of_rule("action"), "hashed_value": finding_hash(key, value)})
        .withColumns({"sev_rank": rank(F.col("severity"), SEVERITIES), "act_rank": rank(F.col("action"), ACTIONS)})
    )
    order = F.struct("phase", "rule", "start")
    extra = [F.min_by("value", order).alias("value")] if keep_value else []
    cols = ["category", "severity", "sev_rank", "action", "act_rank", "hashed_value"]
    return (
        out.groupBy(*ids, "flag", "start", "end")
        .agg(F.min(order).alias("seq"), *(F.min_by(c, order).alias(c) for c in cols), *extra)
        .select(*ids, "seq", "flag", *cols[:5], "start", "end", "hashed_value", *(["value"] if keep_value else []))
    )


def overall_action(df: DataFrame, findings: DataFrame, ids: list[str]) -> DataFrame:
    """The strongest action of each text, ``allow`` without findings."""
    strongest = findings.groupBy(*ids).agg(F.max("act_rank").alias("r"), F.count(F.lit(1)).alias("n_findings"))
    return df.select(*ids).distinct().join(strongest, ids, "left").select(
        *ids, unrank(F.coalesce("r", F.lit(0)), ACTIONS).alias("action_overall"), F.coalesce("n_findings", F.lit(0)).alias("n_findings")
    )


def first_match(text: Column, rule: Rule) -> Column:
    """First match of a rule's multi-line patterns, without constraints; null without match."""
    found = [F.nullif(F.regexp_extract(text, java_pattern(p), 0), F.lit("")) for p in rule.patterns if is_multiline(p)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def without_allowed(findings: DataFrame, fingerprints: DataFrame, key: bytes | None, value: str = "value") -> DataFrame:
    """findings whose keyed fingerprint is not on the list ``fingerprint``; without key all stay."""
    if key is None:
        return findings
    from ..functions.hashing import allowlist_fingerprint

    marked = findings.withColumn("__print", F.lower(allowlist_fingerprint(key, F.col(value))))
    listed = fingerprints.select(F.lower("fingerprint").alias("__print")).where("__print is not null").distinct()
    return marked.join(listed, "__print", "left_anti").drop("__print")
