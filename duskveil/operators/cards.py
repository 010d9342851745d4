"""Card numbers in digit runs with separators.

A run is digits joined by one of ``. / -`` or one to three spaces. Up to 19 digits it is one
candidate; a longer run is cut at separators into a chain of valid numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby
from operator import add, itemgetter
from typing import NamedTuple

from ..functions.validators import ISSUERS

_RUN = re.compile("\\+?[0-9]+(?:(?:[./-]|[ \u00a0]{1,3})[0-9]+)*")
_GAP = re.compile("[./-]|[ \u00a0]{1,3}")
_WORD = re.compile(r"\w")
#: Runs stand in such stretches only.
_STRETCH = re.compile("[0-9][0-9 \u00a0./-]{11,}[0-9]")


def _word(c: str) -> bool:
    return c.isalnum() and not (not c.isascii() and c.isnumeric() and not c.isdecimal()) or c == "_" or bool(not c.isascii() and _WORD.match(c) and not c.isnumeric())


def card_valid(value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"]
    n = len(digits)
    if not 13 <= n <= 19 or len(set(digits)) == 1:
        return False
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    if total % 10:
        return False
    if value.startswith("+"):
        text = "".join(map(str, digits))
        return any(low <= int(text[: len(str(low))]) <= high and n in lengths for low, high, lengths in ISSUERS)
    return True


def card_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of card numbers, in order."""
    out: list[tuple[int, int]] = []
    for stretch in _STRETCH.finditer(text):
        at = stretch.start() - (text[stretch.start() - 1 : stretch.start()] == "+")
        while (m := _RUN.search(text, at)) and m.start() < stretch.end():
            start, end = m.span()
            if text[start] != "+" and start and _word(text[start - 1]):
                # Digits inside a word: no run may begin before the word ends.
                at = start + 1
                while at < len(text) and text[at] in "0123456789":
                    at += 1
                continue
            at = end
            if end < len(text) and _word(text[end]):
                continue
            pieces = [(start + a, start + z) for a, z in _pieces(m.group(0))]
            n = sum(sum(c in "0123456789" for c in text[a:z]) for a, z in pieces)
            if n < 13:
                continue
            if n <= 19:
                if card_valid(text[start:end]):
                    out.append((start, end))
            else:
                out += _chain(text, pieces)
    return out


def _pieces(run: str) -> list[tuple[int, int]]:
    """Spans of the digit groups between separators."""
    out, a = [], 0
    for g in _GAP.finditer(run):
        out.append((a, g.start()))
        a = g.end()
    return [*out, (a, len(run))]


class _Plan(NamedTuple):
    """Numbers taken so far: what they are worth, the last of them, the plan before it."""

    worth: tuple[int, int, int, int]
    span: tuple[int, int] | None
    before: _Plan | None


_NOTHING = _Plan((0, 0, 0, 0), None, None)


def _chain(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers in a run of more than 19 digits, cut at its separators only.

    A number is a stretch of groups with 13 to 19 digits that holds the checks. It follows on the run's start, on the number before
    it, or, where none ends there, on the best one 13 to 19 digits away; a last group may also stand alone behind 13 digits or more.
    What stays behind the last number is nothing or has 13 digits at least. Worth, in this order: digits covered, numbers of 16
    digits, separators at multiples of four, numbers; of equals the later start and the later end.
    """
    size = list(accumulate((sum(c in "0123456789" for c in text[a:z]) for a, z in pieces), initial=0))
    whole = len(pieces)
    numbers = [
        (z, -a)
        for a in range(whole)
        for z in range(bisect_left(size, size[a] + 13), bisect_right(size, size[a] + 19))
        if card_valid(text[pieces[a][0] : pieces[z - 1][1]])
    ]
    ending: dict[int, _Plan] = {}

    def behind(a: int, z: int) -> _Plan | None:
        if a == 0 or a in ending:
            return ending.get(a, _NOTHING)
        away = [ending[k] for k in range(bisect_left(size, size[a] - 19), bisect_right(size, size[a] - 13)) if k in ending]
        if away:
            return max(away, key=lambda p: p.worth)
        return _NOTHING if z == whole == a + 1 and size[a] >= 13 else None

    for z, starts in groupby(sorted(numbers), key=itemgetter(0)):
        plans = []
        for _, minus in starts:
            a = -minus
            before = behind(a, z)
            if before is not None:
                n, aligned = size[z] - size[a], sum((size[k] - size[a]) % 4 == 0 for k in range(a + 1, z))
                worth = tuple(map(add, before.worth, (n, n == 16, aligned, 1)))
                plans.append(_Plan(worth, (pieces[a][0], pieces[z - 1][1]), before))
        if plans:
            ending[z] = max(plans, key=lambda p: p.worth)
    last = max((p.worth, z) for z, p in [(0, _NOTHING), *ending.items()] if not 0 < size[whole] - size[z] < 13)
    plan, out = ending.get(last[1], _NOTHING), []
    while plan.span is not None:
        out.append(plan.span)
        plan = plan.before
    return out[::-1]
