"""Cheap necessary conditions of a pattern, derived from its syntax tree (D3). A guard never decides a match, it only saves a search."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

#: Most literals that stand for one pattern, and most characters of an alphabet that is looked for.
MOST_LITERALS, MOST_CHARACTERS = 16, 24
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


@dataclass(frozen=True)
class Guard:
    """``literals``: every match holds one of them. ``run``: every match lies within a stretch of these characters, so long at least."""

    literals: tuple[str, ...] | None = None
    run: str | None = None


def _item(kind, value) -> tuple[set[str] | None, set[str] | None]:
    """Of one part of a pattern: all texts it can match, if they are few, and literals of which it always holds one."""
    if kind is op.LITERAL:
        return {chr(value)}, None
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return {chr(c) for _, c in value}, None
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, None
    if kind is op.SUBPATTERN and not value[1] & re.IGNORECASE:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        every = [texts for texts, _ in parts]
        held = [some if some is not None else texts for texts, some in parts]
        return (
            None if any(t is None for t in every) else set().union(*every),
            None if any(h is None or "" in h for h in held) else set().union(*held),
        )
    if kind in _REPEATS and value[0] >= 1:
        texts, held = _sequence(value[2])
        return None, held if held is not None else texts
    return None, None


def _sequence(tree) -> tuple[set[str] | None, set[str] | None]:
    """The same for parts one after the other: neighbours with few texts are multiplied out, the longest such stretch is the best."""
    stretches: list[set[str]] = [{""}]
    held: list[set[str]] = []
    exact = True
    for kind, value in tree:
        texts, some = _item(kind, value)
        if some is not None:
            held.append(some)
        if texts is None:
            exact = False
            stretches.append({""})
        elif len(stretches[-1]) * len(texts) <= MOST_LITERALS:
            stretches[-1] = {a + b for a in stretches[-1] for b in texts}
        else:
            exact = False
            stretches.append(texts)
    usable = [s for s in [*stretches, *held] if "" not in s and len(s) <= MOST_LITERALS]
    best = max(usable, key=lambda s: (min(map(len, s)), -len(s)), default=None)
    return stretches[0] if exact else None, best


def _alphabet(tree) -> set[str] | None:
    """Characters a match can consist of, None if they are many or a look around reaches beyond one character."""
    out: set[str] = set()
    for kind, value in tree:
        if kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.IN:
            for k, c in value:
                if k is op.LITERAL:
                    out.add(chr(c))
                elif k is op.RANGE and c[1] - c[0] < MOST_CHARACTERS:
                    out |= {chr(x) for x in range(c[0], c[1] + 1)}
                else:
                    return None
        elif kind is op.AT:
            if value in (op.AT_END, op.AT_END_STRING):
                return None
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            if value[1].getwidth()[1] > 1:
                return None
        else:
            inner = [value[3]] if kind is op.SUBPATTERN and not value[1] & re.IGNORECASE else value[1] if kind is op.BRANCH else [value[2]] if kind in _REPEATS else None
            parts = [_alphabet(x) for x in inner] if inner is not None else [None]
            if any(p is None for p in parts):
                return None
            out = out.union(*parts)
        if len(out) > MOST_CHARACTERS:
            return None
    return out


def _first(tree) -> set[str] | None:
    """Characters a match can begin with; None where they are many or a match may be empty."""
    out: set[str] = set()
    for kind, value in tree:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if kind is op.BRANCH:
            parts = [_first(b) for b in value[1]]
            return None if any(p is None for p in parts) else out.union(*parts)
        if kind in (op.LITERAL, op.IN):
            some = _alphabet([(kind, value)])
            return None if some is None else out | some
        inner = value[3] if kind is op.SUBPATTERN else value[2] if kind in _REPEATS else None
        some = _alphabet(inner) if inner is not None else None
        if some is None:
            return None
        if kind is op.SUBPATTERN or value[0] >= 1:
            begin = _first(inner)
            return None if begin is None else out | begin
        out |= some
    return None


def _class(characters: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(characters)) + "]"


@lru_cache(maxsize=4096)
def guard_of(pattern: str) -> Guard:
    """Guard of a rule's pattern; an empty one where its syntax is not known here or case does not count."""
    try:
        tree = parser.parse(pattern.removeprefix("(?-u)"))
    except (re.error, OverflowError, ValueError, RecursionError):
        return Guard()
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return Guard()
    texts, held = _sequence(tree)
    least, alphabet = tree.getwidth()[0], _alphabet(tree)
    run = None
    if alphabet and least >= 2:
        begin = _first(tree)
        run = _class(begin or alphabet) + _class(alphabet) + "{%d,}" % (least - 1)
    return Guard(tuple(sorted(held)) if held is not None else None, run)
