"""Value checks as native expressions (F6-F12, D10). Null values fail every check."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Issuer prefixes (from, to) and card lengths.
ISSUERS = [
    (4, 4, (13, 16, 19)),
    (51, 55, (16,)), (2221, 2720, (16,)),
    (2200, 2204, (16, 17, 18, 19)),
    (34, 34, (15,)), (37, 37, (15,)),
    (36, 36, (14,)), (38, 39, (14,)), (300, 305, (14,)),
    (5018, 5018, (13, 14, 15, 16, 17, 18, 19)), (5020, 5020, (13, 14, 15, 16, 17, 18, 19)), (5038, 5038, (13, 14, 15, 16, 17, 18, 19)),
    (5893, 5893, (13, 14, 15, 16, 17, 18, 19)), (6304, 6304, (13, 14, 15, 16, 17, 18, 19)), (6390, 6390, (13, 14, 15, 16, 17, 18, 19)),
    (6759, 6759, (13, 14, 15, 16, 17, 18, 19)), (6761, 6763, (13, 14, 15, 16, 17, 18, 19)), (56, 58, (13, 14, 15, 16, 17, 18, 19)),
    (6011, 6011, (16, 17, 18, 19)), (62, 62, (16, 17, 18, 19)), (65, 65, (16, 17, 18, 19)), (644, 649, (16, 17, 18, 19)), (3528, 3589, (16, 17, 18, 19)),
]


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _on_digits(col: Column, check) -> Column:
    """A check on the digits of a value, which are taken out once (as a lambda's variable, not in every term)."""
    return F.coalesce(F.get(F.transform(F.array(digits_of(col)), check), F.lit(0)), F.lit(False))


def luhn(col: Column) -> Column:
    """13 to 19 digits, not all the same, Luhn sum right; other characters are skipped."""
    return _on_digits(col, lambda d: F.length(d).between(13, 19) & (d != F.repeat(F.substring(d, 1, 1), F.length(d))) & F.call_function("luhn_check", d))


def recognised_issuer(col: Column) -> Column:
    """prefix and length of a known card scheme."""

    def check(d: Column) -> Column:
        rows = [F.substring(d, 1, len(str(low))).try_cast("int").between(low, high) & F.length(d).isin(*lengths) for low, high, lengths in ISSUERS]
        return reduce(lambda a, b: a | b, rows)

    return _on_digits(col, check)


def payment_card(col: Column) -> Column:
    """F8: Luhn; with a leading plus the issuer must be known too."""
    return F.coalesce(luhn(col) & (~F.startswith(col, F.lit("+")) | recognised_issuer(col)), F.lit(False))


def not_payment_card(col: Column) -> Column:
    """true unless the value is a valid card number; null fails like everywhere."""
    return F.coalesce(~payment_card(col) & col.isNotNull(), F.lit(False))


def iban(col: Column) -> Column:
    """15 to 34 capitals and digits once white space is gone, remainder 1 modulo 97 after rotation."""
    v = F.regexp_replace(col, r"(?U)\s", "")
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(digits, F.lit(0), lambda acc, d: ((acc * F.when(d > 9, 100).otherwise(10) + d) % 97).cast("int"))
    return F.coalesce(v.rlike(r"\A[A-Z0-9]{15,34}\z") & (rest == 1), F.lit(False))


def shannon_entropy(col: Column) -> Column:
    """Bits for each character; 0 for the empty text, null for null."""
    n = F.length(col)
    chars = F.array_distinct(F.filter(F.split(col, ""), lambda c: c != ""))
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(col, c, F.lit("")))) / n)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(col.isNull(), None).when(F.length(col) == 0, 0.0).otherwise(bits)


_ENTROPY_SPEC = re.compile(r"shannon-entropy(?:(>=?)(\d+(?:\.\d+)?))?\Z")


def validator(name: str):
    """the check of that name as a function of a column; an unknown name raises ``ValueError``."""
    simple = {"luhn": luhn, "payment-card": payment_card, "not-payment-card": not_payment_card, "checksum": iban}
    if name in simple:
        return simple[name]
    m = _ENTROPY_SPEC.match(name)
    if not m:
        raise ValueError(f"unknown validator: {name}")
    least, strict = float(m.group(2) or 3.0), m.group(1) != ">="
    return lambda col: F.coalesce(shannon_entropy(col) > least if strict else shannon_entropy(col) >= least, F.lit(False))


def all_pass(names: list[str], col: Column) -> Column:
    """all checks hold; unknown names are false."""
    out = F.lit(True)
    for name in names:
        try:
            out = out & validator(name)(col)
        except ValueError:
            return F.lit(False)
    return out
