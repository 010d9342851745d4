"""One-shot bypass grants replayed over a log of requests (C11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_TTL_S, MAX_TTL_S = 60, 3600


def redeem(grants: DataFrame, attempts: DataFrame) -> DataFrame:
    """C11: result of every attempt: ``granted, unknown-nonce, expired`` or ``scope-mismatch``.

    ``grants``: ``nonce, scope`` (a provider or ``*``), ``issued_at, ttl_s``; ``attempts``: ``nonce,
    provider, at``. Times are epoch seconds. A grant works once and until its
    last second begins; a mismatch does not use it up, expiry does. Attempts of one nonce are taken in the order of time; a nonce is random, so groups
    are small. Null nonces are unknown.
    """
    fields = "nonce string, provider string, at bigint, result string"

    def replay(key, given: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        out, open_grant = [], None
        if len(given) and key[0] is not None:
            g = given.sort_values("issued_at").iloc[0]
            ttl = DEFAULT_TTL_S if pd.isna(g["ttl_s"]) else min(int(g["ttl_s"]), MAX_TTL_S)
            open_grant = (g["scope"], int(g["issued_at"]) + ttl)
        for row in tried.sort_values(["at", "provider"]).itertuples():
            if open_grant is None:
                result = "unknown-nonce"
            elif row.at >= open_grant[1]:
                result, open_grant = "expired", None
            elif open_grant[0] not in ("*", row.provider):
                result = "scope-mismatch"
            else:
                result, open_grant = "granted", None
            out.append((row.nonce, row.provider, row.at, result))
        return pd.DataFrame(out, columns=["nonce", "provider", "at", "result"])

    left = grants.select("nonce", "scope", "issued_at", "ttl_s").groupBy("nonce")
    return left.cogroup(attempts.select("nonce", "provider", "at").groupBy("nonce")).applyInPandas(replay, fields)
