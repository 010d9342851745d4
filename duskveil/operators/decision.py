"""Mode, fail policy and outcome of each request as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAIL_POLICIES = ("open", "closed", "closed-on-critical")


def fail_allows(policy: Column, has_critical: Column) -> Column:
    """Open lets pass, closed rejects, closed-on-critical rejects only with a critical finding; other values count as closed-on-critical."""
    return F.when(policy == "open", True).when(policy == "closed", False).otherwise(~F.coalesce(has_critical, F.lit(False)))


def decide(df: DataFrame) -> DataFrame:
    """Adds ``outcome, forwarded, http_status, action_taken, audit_flags, has_event``.

    Needs ``overall`` (strongest action), ``n_findings``, ``has_critical``, ``mode`` (shadow or
    enforce), ``fail_policy``, ``bypass`` (null, ``bypass`` or ``break-glass``), ``decode_failed``,
    ``redact_failed``, ``binary_parts`` and ``too_large``. Null flags count as false, a null overall
    as allow, a null mode as enforce.

    A bypass lets a request through that would be blocked; it marks the event of a request with
    findings only, and no event is made for it alone. A request that is rejected because it can't be
    redacted is no bypass. A request that passes although it could not be decoded is ``fail-open`` only
    if it has no findings, otherwise its findings name the action.
    """
    overall = F.coalesce("overall", F.lit("allow"))
    enforce = ~F.coalesce(F.col("mode") == "shadow", F.lit(False))
    found = F.coalesce("n_findings", F.lit(0)) > 0
    by_pass = F.col("bypass").isNotNull()
    undecoded = F.coalesce("decode_failed", F.lit(False))
    unredacted = enforce & (overall == "redact") & F.coalesce("redact_failed", F.lit(False))
    outcome = (
        F.when(F.coalesce("too_large", F.lit(False)), "too-large")
        .when(undecoded & ~F.coalesce(F.col("fail_policy") == "open", F.lit(False)), "reject-undecoded")
        .when(enforce & (overall == "block") & ~by_pass, "block")
        .when(unredacted & ~fail_allows(F.col("fail_policy"), F.col("has_critical")), "reject-unredacted")
        .when(enforce & (overall == "redact") & ~unredacted, "forward-redacted")
        .otherwise("forward")
    )
    passed = F.col("outcome").startswith("forward")
    rejected = F.col("outcome").startswith("reject")
    action = (
        F.when(rejected, "fail-closed")
        .when(passed & unredacted, "fail-open")
        .when(passed & by_pass & found, "bypass")
        .when(passed & undecoded & ~found, "fail-open")
        .otherwise(F.when(found, overall).otherwise("allow"))
    )
    scanned = passed | (F.col("outcome") == "reject-unredacted")
    marks = [
        ("bypass", passed & by_pass & found), ("break-glass", passed & found & (F.col("bypass") == "break-glass")), ("decode-failed", (scanned | rejected) & undecoded),
        ("shadow", scanned & ~enforce & found), ("binary-unscanned", scanned & (F.coalesce("binary_parts", F.lit(0)) > 0)), ("redact-failed", scanned & unredacted),
    ]
    return (
        df.withColumn("outcome", outcome)
        .withColumn("forwarded", F.when(F.col("outcome") == "forward", "original").when(F.col("outcome") == "forward-redacted", "redacted").otherwise("none"))
        .withColumn("http_status", F.when(F.col("outcome") == "too-large", 413).when(F.col("outcome") == "block", 403).when(rejected, 502).otherwise(200))
        .withColumn("action_taken", action)
        .withColumn("audit_flags", F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in marks))))
        .withColumn("has_event", (F.col("outcome") != "too-large") & (rejected | found | (F.size("audit_flags") > 0)))
    )


def log_level(outcome: Column, action: Column) -> Column:
    """K8: level of the security log line."""
    return F.when(outcome.isin("block") | outcome.startswith("reject"), "error").when(action.isin("redact", "warn", "bypass", "fail-open"), "warn").otherwise("info")
