"""Hashes and fingerprints as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the message domains; they keep hashes of different uses apart.
DOMAIN_FINDING = "duskveil:finding:v1"
DOMAIN_ALLOWLIST = "duskveil:allowlist:v1"


def unicode_trim(col: Column) -> Column:
    """P5: white space of any script off both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def sha256_value(col: Column) -> Column:
    """``sha256:`` and the hex digest."""
    return F.concat(F.lit("sha256:"), F.sha2(col.cast("binary"), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 after RFC 2104, composed of built-in functions; keys over 64 bytes are hashed first."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer = F.lit(bytearray(b ^ 0x5C for b in padded))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def domain_hash(key: bytes, domain: str, col: Column) -> Column:
    """``hmac:`` and HMAC(key, domain, zero byte, value)."""
    return F.concat(F.lit("hmac:"), hmac_sha256(key, F.concat(F.lit(bytearray(domain.encode() + b"\0")), col.cast("binary"))))


def finding_hash(key: bytes | None, col: Column) -> Column:
    """Keyed hash of a finding's trimmed value; without key the plain one, which the write gate rejects."""
    return sha256_value(col) if key is None else domain_hash(key, DOMAIN_FINDING, col)


def allowlist_fingerprint(key: bytes, col: Column) -> Column:
    """Domain hash of the trimmed value."""
    return domain_hash(key, DOMAIN_ALLOWLIST, unicode_trim(col))


def is_fingerprint(col: Column) -> Column:
    """``hmac:`` and 64 hex digits."""
    return F.coalesce(col.rlike(r"\Ahmac:[0-9a-fA-F]{64}\z"), F.lit(False))


def strip_hash_prefix(col: Column) -> Column:
    """P8."""
    return F.regexp_replace(col, r"\A(?:hmac|sha256):", "")


def display_fingerprint(col: Column) -> Column:
    """The first twelve digits of a fingerprint, anything else unchanged."""
    return F.when(is_fingerprint(col), F.concat(F.substring(col, 1, 17), F.lit("…"))).otherwise(col)
