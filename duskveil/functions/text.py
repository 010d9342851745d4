"""Small text functions."""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders of the enumerations; all comparisons use the rank.
CATEGORIES = ("secrets", "pii", "internal_code")
SEVERITIES = ("low", "medium", "high", "critical")
ACTIONS = ("allow", "warn", "redact", "block")
INTERVENTIONS = ("block", "redact", "warn")
#: Providers known by their path.
BUILTIN_PROVIDERS = ("openai", "anthropic", "gemini", "mistral", "groq")


def rank(col: Column, names: tuple[str, ...]) -> Column:
    """Place of a name in its order; null for others."""
    at = F.array_position(F.array(*map(F.lit, names)), F.lower(col)) - 1
    return F.when(at >= 0, at.cast("int"))


def unrank(col: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), col)


def truncate_bytes(col: Column, limit: int = 200) -> Column:
    """At most ``limit`` bytes, cut at a character boundary."""
    cut = F.substring(col.cast("binary"), 1, limit)
    choices = [F.try_validate_utf8(F.substring(cut, 1, limit - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(col) <= limit, col).otherwise(F.coalesce(*choices))


def token_ids(col: Column) -> Column:
    """Ids of vault tokens in a text, each once in the order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(r"\[VAULT:([0-9a-f]{32})\]"), 1))


def strip_token(col: Column) -> Column:
    """P10: the id of ``[VAULT:id]``; other texts unchanged."""
    return F.regexp_replace(col, r"\A\[VAULT:(.*)\]\z", "$1")


def provider_of_path(col: Column) -> Column:
    """Built-in provider of a request path, else ``unknown``."""
    found = F.regexp_extract(col, rf"\A/({'|'.join(BUILTIN_PROVIDERS)})/", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def url_host(col: Column) -> Column:
    """Host of a URL in lower case, null where it is none."""
    return F.lower(F.try_parse_url(col, F.lit("HOST")))


def semver(col: Column) -> Column:
    """``major, minor, patch`` of a version, null where it is none."""
    pattern = r"\Av?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?\z"
    part = [F.regexp_extract(col, pattern, i).try_cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"), 1)]
    return F.when(col.rlike(pattern), F.struct(*part))


def last_lines(col: Column, n: int) -> Column:
    """The last ``n`` lines."""
    lines = F.split(F.regexp_replace(col, r"\n\z", ""), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def percentile_nearest_rank(col: Column, share: float) -> Column:
    """Nearest-rank percentile as an aggregate."""
    return F.expr(f"percentile_disc({share}) within group (order by {_name(col)})")


def _name(col: Column) -> str:
    return f"`{col._jc.toString()}`" if hasattr(col, "_jc") else str(col)


def is_intervention(col: Column) -> Column:
    """F18."""
    return F.coalesce(col.isin(*INTERVENTIONS), F.lit(False))


def event_id() -> Column:
    """P20."""
    return F.concat(F.lit("evt_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def query_param(query: str, name: str) -> str | None:
    """F16: last value that is not empty; nothing is decoded."""
    out = None
    for part in query.split("&"):
        key, _, value = part.partition("=")
        if key == name and value:
            out = value
    return out


def parse_since(raw: str, now: float | None = None) -> int:
    """epoch seconds, RFC 3339, or ``Ns``/``Nm``/``Nh``/``Nd`` before now."""
    raw = raw.strip()
    if re.fullmatch(r"-?\d+", raw):
        return int(raw)
    if m := re.fullmatch(r"(\d+)([smhd])", raw):
        return int(time.time() if now is None else now) - int(m.group(1)) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m.group(2)]
    try:
        at = datetime.fromisoformat(raw.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not a time: {raw}") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
