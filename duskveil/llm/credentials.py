"""Credentials in source code and configuration: Viterbi segmentation of literals near assignments.

A literal that stands where a secret is assigned is split into dictionary words by Viterbi; what no
word explains is its residual. A residual that is long for its context makes the literal a secret.
Placeholders, references, redaction marks and known hash formats are left out.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import spans_to_rows, splice

#: Vocabulary of a public tokenizer: its alphabetic entries, with their ranks, are the dictionary.
DICTIONARY_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAST_WORD, LONGEST_WORD = 4, 16
#: Literals up to this length are remembered with their residual.
REMEMBERED = 512
#: In running text a word may begin so many characters after the keyword; it is judged whole. A stretch without a blank that
#: is longer than LONG_STRETCH and holds keywords itself is judged from the first of them only: time stays linear.
SAID_WITHIN, LONG_STRETCH = 120, 512

#: Words that name a secret, by how much is expected of the value.
PASSWORD_NAMES = {"password", "passwd", "passphrase", "passwort", "pwd", "pass", "contraseña", "clave", "kennwort", "pw"}
KEY_NAMES = {"secret", "token", "key", "apikey", "credential", "credentials", "auth", "authorization", "bearer", "sid", "session", "cookie", "authtoken", "accesskey", "secretkey"}
#: Parts of a name that make a key or token something else than a secret.
HARMLESS_PARTS = {"public", "pub", "primary", "foreign", "cache", "sort", "partition", "row", "lookup", "unique", "index", "group", "order", "map", "object", "dict", "shard", "routing", "dedup", "idempotency", "csrf"}
#: What stands in for a value.
_PLACEHOLDER = re.compile(
    r"""(?ix) ^(?: [*x•.\-_?]{3,} | .*(?:\byour|your_|your-|example|placeholder|changeme|change_me|redacted|dummy|insert|replace|todo|<[^>]*>|\.\.\.) .* | none | null | nil | true | false | undefined | secret | password | token )$
    | ^\$ [\w{(] .* | ^%(?:\(\w+\)s|[A-Z_]+%)$ | ^\{\{ .* | ^\[[A-Z]+:.* | ^(?:\w+\.)*\w+[(\[] .* | ^@\w*\( | ^ENC\[ | (\w)\1{7,} """
)
_HASH_PREFIX = re.compile(r"(?i)^(?:sha-?\d{1,3}|md5|hmac|blake2[bs]?|bypass-hash|ssh-\w+)[-:_ ]|^SHA256:")
_HEX_FORMAT = re.compile(r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{7,12})$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY(?: BLOCK)?-----.*?-----END \1PRIVATE KEY(?: BLOCK)?-----", re.S)
_KEYWORD = re.compile(r"passwor[dt]|passwd|passphrase|pass(?![a-z])|pwd|secret|token|key|credentials?|authorization|auth(?![a-z])|bearer|\bsid\b|contraseña|clave|mot de passe|kennwort|logged in|login")
_NAME_BEFORE = re.compile(r"[\w.\-]{0,60}\Z")
_ASSIGN = re.compile(r"""["'`\]]{0,2}[ \t]{0,8}(?:=>|:=|==|[:=])[ \t]{0,8}""")
_XML = re.compile(r">([^<>\n]+)</")
_VALUE = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1|([^\s"'`<>,;]+(?:,(?=\S)[^\s"'`<>,;]+)*)""")
_SCHEME = re.compile(r"(?i)(bearer|basic|token|digest)[ \t]+")
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:@/\"'<>]*:([^\s@/\"'<>]+)@")
_QUOTED = re.compile(r"""[=:(\[,][ \t]*(["'`])([^"'`\s]{20,})\1""")
_SHORT_NAME = re.compile(r"(?<![\w.])[kK][ \t]*\Z")
_VENDOR = re.compile(r"\b(?:sk-(?:ant-)?[A-Za-z0-9]{20,}|[sp]k_(?:live|test)_[A-Za-z0-9]{10,}|gh[a-z]_\w{30,}|AKIA[0-9A-Z]{16}\b|xox[a-z]-[\w-]{20,}|AIza[\w-]{30,})(?![\w])")
_USER_OPTION = re.compile(r"(?:\s-u|--user)[ =]?([^\s:'\"]+):([^\s'\"]+)")
_PASS_OPTION = re.compile(r"\s-p([^\s'\"]{4,})")
_ASK_OPTION = re.compile(r"--?pass(?:word|wd)?[ =]([^\s'\"]{4,})")
_SAID = re.compile(r"[ \t]+(?:is|was|are|lautet|ist|es|est|war|für|of|del?|do|du|la|el|the|entorno|servidor|server|now|jetzt|ahora|:|=|/|\w+)?")
_WORD_AFTER = re.compile(r"[^\s\"'`<>]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")


@lru_cache(maxsize=2)
def dictionary(path: str) -> dict[str, float]:
    """Word -> cost; the cost grows with the word's rank in the vocabulary. It is read on the driver and travels with the plan."""
    words: dict[str, float] = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.partition(b" ")
            word = base64.b64decode(token).strip().lower()
            if len(word) >= 2 and word.isalpha() and word.isascii():
                words.setdefault(word.decode(), 1.0 + math.log(int(rank) + 2) / 8)
    return words


class Segmenter:
    """Viterbi segmentation of a literal into dictionary words, separators and residual characters."""

    RESIDUAL, SEPARATOR = 1.1, 0.2

    def __init__(self, words: dict[str, float]) -> None:
        self.words = words
        self.seen: dict[str, int] = {}

    def residual(self, literal: str) -> int:
        """Characters that the best path leaves to no word."""
        if len(literal) > REMEMBERED:
            return self._residual(literal)
        if literal not in self.seen:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            self.seen[literal] = self._residual(literal)
        return self.seen[literal]

    def _residual(self, literal: str) -> int:
        n = len(literal)
        lower = literal.lower() if len(literal.lower()) == n else literal
        best = [0.0] + [math.inf] * n
        left = [0] * (n + 1)
        for i in range(n):
            c = literal[i]
            cost, more = (self.SEPARATOR, 0) if c in "._-/:\\ " else (self.RESIDUAL, 1)
            if best[i] + cost < best[i + 1]:
                best[i + 1], left[i + 1] = best[i] + cost, left[i] + more
            if not c.isalpha():
                continue
            # A word keeps one manner of case: lower, Capitalised or UPPER. It ends with its run.
            j = i + 1
            upper = c.isupper() and j < n and literal[j].isupper()
            while j < n and j - i < LONGEST_WORD and literal[j].isalpha() and literal[j].isupper() == upper:
                j += 1
            alone = (i == 0 or not literal[i - 1].isalnum()) and (j == n or not literal[j].isalnum())
            for k in range(i + (2 if alone else LEAST_WORD), j + 1):
                if k - i < LEAST_WORD and not (alone and k == j):
                    continue
                word = self.words.get(lower[i:k])
                if word is not None and best[i] + word < best[k]:
                    best[k], left[k] = best[i] + word, left[i]
        return left[n]


def name_class(name: str) -> str | None:
    """``password``, ``key`` or None for the name that a value is given to; the last part decides."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    if not parts or HARMLESS_PARTS & set(parts[:-1]):
        return None
    last = parts[-1]
    if last in PASSWORD_NAMES:
        return "password"
    if last in KEY_NAMES or last.endswith(("password", "passwd")):
        return "key" if last in KEY_NAMES else "password"
    return None


def placeholder(value: str) -> bool:
    return not value or _PLACEHOLDER.search(value) is not None


class Finder:
    """Spans of secrets in one text."""

    def __init__(self, words: dict[str, float], allowed: frozenset[str] = frozenset()) -> None:
        self.segmenter, self.allowed = Segmenter(words), allowed
        self.stretch = (0, 0)

    def is_secret(self, value: str, context: str) -> bool:
        """Is the residual long for its context? Contexts: password, key, said, any."""
        if len(value) < 4 or value in self.allowed or placeholder(value) or _HASH_PREFIX.match(value):
            return False
        if context in ("said", "any") and (_HEX_FORMAT.match(value) and context == "any" or _UUID.match(value)):
            return False
        left = self.segmenter.residual(value)
        letters = any(c.isalpha() for c in value)
        digits = any(c.isdigit() for c in value)
        marks = any(not c.isalnum() for c in value)
        mixed = letters and (digits or marks or (value.lower() != value and value.upper() != value and not value.istitle()))
        if context == "password":
            return left >= 1 and letters and len(value) >= 5
        if context == "key":
            return left >= 8 and letters or left >= 2 and len(value) >= 8 and letters and digits and not any(c in ".:/ " for c in value)
        if context == "said":
            if letters and not digits and re.fullmatch(r"[A-Za-z_]{8,}", value):
                # Letters only: case that changes like in no word, and next to nothing explained.
                changes = sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(value[1:], value[2:]))
                return left >= 6 and 10 * left >= 7 * len(value) and changes >= 2
            return left >= 2 and len(value) >= 7 and mixed and not re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+)*-\d+|v?\d+(?:\.\w+)+|\d[\d.:,\-]*[a-z]{0,3}|[A-Za-z]+(?:[_\-.][A-Za-z]+)*(?:\(\))?|[\w\-]+\.[a-z]{1,4}", value)
        return left >= 16 and letters and digits and 2 * left >= len(value)

    def is_secret_phrase(self, value: str, context: str) -> bool:
        """A quoted value with blanks: words explain less than half of it, and a part mixes letters with something else.

        A sentence leaves a residual too (a figure, words of another language) but hardly both. One that names a secret
        itself is running text.
        """
        if value in self.allowed or placeholder(value) or _HASH_PREFIX.match(value) or _KEYWORD.search(value.lower()):
            return False
        parts = [p.strip(".,;:!?()") for p in value.split()]
        mixed = any(any(c.isalpha() for c in p) and any(not c.isalpha() for c in p) and self.segmenter.residual(p) >= 2 for p in parts)
        left = self.segmenter.residual(value)
        return mixed and left >= (8 if context == "key" else 4) and 2 * left >= sum(map(len, parts))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each secret, in order, without overlaps; longer ones win."""
        found: list[tuple[int, int]] = []
        self.stretch = (0, 0)

        def take(start: int, end: int, context: str, judge=self.is_secret) -> bool:
            if judge(text[start:end], context):
                found.append((start, end))
                return True
            return False

        blocks = [m.span() for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else []
        found += blocks
        if "://" in text:
            for m in _URL.finditer(text):
                take(*m.span(1), "password")
        if "-u" in text or "--user" in text:
            for m in _USER_OPTION.finditer(text):
                take(*m.span(2), "password")
        if " -p" in text:
            for m in _PASS_OPTION.finditer(text):
                if "-u" in text[max(0, m.start() - 60) : m.start()]:
                    take(*m.span(1), "password")
        for m in _VENDOR.finditer(text):
            take(*m.span(), "key")
        for m in _QUOTED.finditer(text):
            # Short for key, as in `const k = ...`.
            short = _SHORT_NAME.search(text, max(0, m.start() - 8), m.start())
            take(*m.span(2), "key" if short else "any")
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        reached = 0
        for m in _KEYWORD.finditer(lower):
            if m.start() < reached:
                continue
            reached = self._after(text, lower, m, take) or m.end()
        return _longest(found)

    def _after(self, text: str, lower: str, m: re.Match, take) -> int | None:
        """Looks at what follows a keyword; the place up to which the text is settled."""
        start, end = m.span()
        word = m.group(0)
        before = _NAME_BEFORE.search(text, max(0, start - 60), start).group(0)
        name = before + text[start:end]
        if text[end : end + 1] == ">" and (x := _XML.match(text, end)):
            kind = name_class(name)
            if kind:
                take(*x.span(1), kind)
            return x.end()
        if word == "pass" or word == "password":
            if before.endswith("-") and (x := _ASK_OPTION.match(text, start - len(before) + before.index("-"))):
                take(*x.span(1), "password")
                return x.end()
        if word == "bearer" and (x := re.compile(r"[ \t]+([^\s\"'`,;<>]+)").match(text, end)):
            take(*x.span(1), "key")
            return x.end(1)
        x = _ASSIGN.match(text, end)
        if x:
            kind = name_class(name)
            if kind is None:
                return None
            at = x.end()
            if s := _SCHEME.match(text, at):
                at = s.end()
            v = _VALUE.match(text, at)
            if not v:
                return None
            a, z = v.span(2) if v.group(1) else v.span(3)
            if s := _SCHEME.match(text, a, z):
                a = s.end()
            if v.group(1) is None:
                z = self._unquoted_end(text, a, z)
            if " " in text[a:z]:
                return z if take(a, z, kind, self.is_secret_phrase) else None
            take(a, z, kind)
            return z
        # The name stands in one line, its value in the next: name: X_KEY / value: ...
        if (x := re.compile(r"[\"']?,?\s*\n[ \t]*[\"']?value[\"']?[ \t]*[:=][ \t]*").match(text, end)) and name_class(name):
            v = _VALUE.match(text, x.end())
            if v:
                a, z = v.span(2) if v.group(1) else v.span(3)
                take(a, z, name_class(name))
                return z
        return self._said(text, end, before, word, take)

    @staticmethod
    def _unquoted_end(text: str, a: int, z: int) -> int:
        while z > a and text[z - 1] in ")]}" and not any(o in text[a:z] for o in "([{"):
            z -= 1
        return z

    def _said(self, text: str, end: int, before: str, word: str, take) -> int | None:
        """Running text: one of the next few words is the secret."""
        if end < len(text) and (text[end].isalnum() or text[end] in "_-"):
            return None
        if before and (before[-1].isalnum() or before[-1] in "_-."):
            return None
        at, line_end = end, text.find("\n", end)
        line_end = len(text) if line_end < 0 else line_end
        for _ in range(6):
            if self.stretch[0] < at < self.stretch[1]:
                return None
            x = _WORD_AFTER.search(text, at, line_end)
            if not x or x.start() >= end + SAID_WITHIN:
                return None
            a, z = x.span()
            if z - a > LONG_STRETCH:
                self.stretch = (a, z)
            ended = False
            while z > a and text[z - 1] in ",.;:?)":
                ended, z = ended or text[z - 1] in ".?", z - 1
            while z > a and text[a] in "(":
                a += 1
            if z > a and take(a, z, "said"):
                return z
            if ended:
                return None
            at = x.end()
        return None


def _longest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            continue
        out.append((a, z))
    return out


def find_credentials(messages: DataFrame, id_column: str, text_column: str, allowed: tuple[str, ...] = (), path: str = DICTIONARY_PATH) -> DataFrame:
    """``id_column, found_text`` of every credential, once for each row and text.

    Whole texts, no shuffle. Null, empty and blank texts hold nothing; rows with null ids keep the
    null; repeated rows give repeated findings; an empty table gives no rows.
    """
    kind = dict(messages.dtypes)[id_column]
    words = dictionary(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(words, frozenset(allowed))
        for batch in batches:
            yield spans_to_rows(batch, finder.spans, id_column)

    return messages.select(id_column, text_column).mapInArrow(work, f"{id_column} {kind}, found_text string")


def redact_credentials(messages: DataFrame, text_column: str, allowed: tuple[str, ...] = (), path: str = DICTIONARY_PATH, mark: str = "[REDACTED:secret]") -> DataFrame:
    """The table with every credential in ``text_column`` replaced by ``mark``; all else unchanged."""
    at = messages.columns.index(text_column)
    words = dictionary(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(words, frozenset(allowed))
        for batch in batches:
            done = [t if t is None else splice(t, [(a, z, mark) for a, z in finder.spans(t)]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return messages.mapInArrow(work, messages.schema)
