"""Abusive, hateful or sexual content: noisy-channel restoration by Viterbi, then scoring of the restored text.

Writers hide words by leetspeak, look-alike letters, masks, spacing and repetition. A hidden word is the output of a noisy channel: each
written character is an arc, or a few, of a lattice of letters, separators may be nothing or the end of a word, a run of one character
may be one letter or two. The Viterbi path through the lattice under a character language model of public vocabularies is the restored
text. It is scored by a logistic model over word classes and words; general knowledge of the language is its prior, labels move it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import abuse_lexicon as L
from .vocabulary import DICTIONARY_PATH, MULTILINGUAL_PATH, spaced_words
from .words import plain

#: Bound of the labelled sample the model is fitted on.
MAX_LABELS = 20_000
THRESHOLD = 0.5
#: Tokens that a task remembers, and texts that are scored at a time.
CACHE, AT_ONCE = 500_000, 256

#: What a written character may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "€": "e", "+": "t",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâçèéêëîïôùûüñáíóúœ"
MASK, SEPARATORS = "*", " .-_*/|,+~·•"
_MARKS = "@$*!|€"
_RUN = re.compile(r"(.)\1*", re.S)
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_HEX = re.compile(r"[0-9a-f]+\Z")
#: Tokens and the ends of passages; the second is for texts without marks, faster.
_TOKEN = re.compile(r"[@$!|]?[^\W_]+(?:[@$*!|€]+[^\W_]+)*[*$]*|[.!?](?=\s)|\n")
_PLAIN_TOKEN = re.compile(r"[^\W_]+|[.!?](?=\s)|\n")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+|[.!?](?=\s)|\n")
#: Three or more single characters with separators between them, whichever these are.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$€])(?:[ .\-_*/|,+~·•]{1,3}(?:[^\W_]|[@$€])){2,}(?![^\W_])")
#: Every spaced word holds this; it begins with a character class, to which the search skips.
_SPACED_PART = re.compile(r"[ .\-_*/|,+~·•](?:[^\W_]|[@$€])[ .\-_*/|,+~·•]{1,3}(?:[^\W_]|[@$€])(?![^\W_])")
ENDS = (".", "!", "?", "\n")


def _forms(entry: str) -> list[str]:
    return [entry[:-1] + e for e in L.ENDINGS] if entry.endswith("*") else [entry]


def _classes() -> dict[str, dict[str, set[str]]]:
    """Word -> class -> languages."""
    out: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, by_language in L.LEXICON.items():
        for language, entries in by_language.items():
            for entry in entries.split():
                for form in _forms(entry):
                    out[form][name].add(language)
    return {w: dict(c) for w, c in out.items()}


CLASSES = _classes()
#: Words that are worth hiding: a channel hides these more often than others.
HIDDEN_CLASSES = ("INSULT", "DEHUMAN", "SEXUAL", "SENSUAL", "ADJECTIVE", "VIOLENCE")
WORTH_HIDING = {w for w, c in CLASSES.items() if len(w) > 2 and any(k in c for k in HIDDEN_CLASSES)}
_FUNCTION = {k: set(v.split()) for k, v in L.FUNCTION_WORDS.items()}
_TALK = set(L.TALK)
_IDIOMS = re.compile(r"(?<!\S)(?:" + "|".join(sorted({i for some in L.IDIOMS.values() for i in some}, key=len, reverse=True)) + r")(?!\S)")
#: The longest word of each idiom makes a look worth while.
_TRIGGERS = {max(i.split(), key=len) for some in L.IDIOMS.values() for i in some}


_FOLD = {**{c: x[0] for c, x in LEET.items()}, **{c: unicodedata.normalize("NFD", c)[0] for c in LETTERS}, "l": "i"}


def fold(text: str) -> str:
    """Letters that a written sign may stand for made one, runs made one: a reading folds to what its written form folds to."""
    return _RUN.sub(r"\1", "".join(_FOLD.get(c) or unicodedata.normalize("NFD", c)[0] for c in text))


class Channel:
    """Character language model over known words and the exact Viterbi decoder over character lattices."""

    ORDER = 4
    #: Costs, in nats: a written sign that is read as a letter, a mask, a separator read as nothing, a run read shorter, a word's end.
    NOISE, MASKED, JOINED, SHORTER, END = 0.3, 1.0, 0.2, 0.3, 1.0
    #: What a path gains by ending in a known word, and in one worth hiding.
    KNOWN, WORTH = 4.0, 7.0

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known | WORTH_HIDING
        self.prefixes = {w[:i] for w in self.known for i in range(len(w) + 1)}
        self.folded, self.folded_worth = set(map(fold, self.known)), set(map(fold, WORTH_HIDING))
        self.fragments = {w[i:j] for w in self.folded_worth for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        padded = ["^" * (self.ORDER - 1) + w + "$" for w in self.known]
        #: Counts of letters with the context before them, of contexts, and of different letters behind a context.
        self.grams: Counter = Counter()
        for n in range(self.ORDER):
            self.grams.update(w[i - n : i + 1] for w in padded for i in range(self.ORDER - 1, len(w)))
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, times in self.grams.items():
            self.total[gram[:-1]] += times
            self.kinds[gram[:-1]] += 1
        self.memo: dict[tuple[str, str], float] = {}

    def probability(self, context: str, c: str) -> float:
        """Witten-Bell: what a context has not seen is left to the shorter context."""
        if not context:
            return (self.grams[c] + 0.5) / (self.total[""] + 0.5 * (len(LETTERS) + 1))
        lower = self.probability(context[1:], c)
        kinds = self.kinds.get(context)
        return (self.grams.get(context + c, 0) + kinds * lower) / (self.total[context] + kinds) if kinds else lower

    def step(self, context: str, c: str) -> float:
        key = (context, c)
        if key not in self.memo:
            if len(self.memo) > CACHE:
                self.memo.clear()
            self.memo[key] = -math.log(self.probability(context, c))
        return self.memo[key]

    def readings(self, c: str) -> list[tuple[str, float]]:
        """Letters that a written character may stand for, with their noise."""
        if c in LEET:
            return [(x, self.NOISE) for x in LEET[c]]
        out = [(c, 0.0)]
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base in LETTERS:
            out.append((base, 2 * self.NOISE))
        return out

    def decode(self, written: str, spaced: bool = False) -> list[str]:
        """Words of the cheapest path. A state is a prefix of known words, or the last letters of an unknown word; nothing is cut off.

        ``spaced``: separators may be nothing or end a word.
        """
        # State: (prefix or "~" and the last letters) -> (cost, words before, letters of this word).
        states: dict[str, tuple[float, tuple, str]] = {"": (0.0, (), "")}

        def close(state: str, cost: float, text: str) -> float:
            context = (("^" * 3 + text)[-3:]) if not state.startswith("~") else state[1:]
            gain = 0.0 if state.startswith("~") else self.WORTH if text in WORTH_HIDING else self.KNOWN if text in self.known else 0.0
            return cost + self.step(context, "$") + self.END - gain

        def put(into: dict, state: str, value: tuple) -> None:
            if state not in into or value[0] < into[state][0]:
                into[state] = value

        def letter(from_: dict, readings: list[tuple[str, float]]) -> dict:
            out: dict[str, tuple[float, tuple, str]] = {}
            for state, (cost, words, text) in from_.items():
                known = not state.startswith("~")
                context = ("^" * 3 + text)[-3:] if known else state[1:]
                for x, noise in readings:
                    new = text + x
                    following = new if known and new in self.prefixes else "~" + (context + x)[-3:]
                    put(out, following, (cost + noise + self.step(context, x), words, new))
            return out

        for run in _RUN.finditer(written):
            c, n = run.group(1), len(run.group(0))
            following: dict[str, tuple[float, tuple, str]] = {}
            if spaced and c in SEPARATORS:
                for state, (cost, words, text) in states.items():
                    put(following, state, (cost + self.JOINED, words, text))
                    if text:
                        put(following, "", (close(state, cost, text), (*words, text), ""))
            if c == MASK:
                some = states
                for _ in range(n):
                    some = letter(some, [(x, self.MASKED) for x in LETTERS])
                for state, value in some.items():
                    put(following, state, value)
            elif c not in SEPARATORS or not spaced:
                for x, noise in self.readings(c):
                    some = states
                    for times in range(1, max(n, 2) + 1 if n < 3 else 3):
                        if times > n:
                            break
                        some = letter(some, [(x, noise)])
                        for state, (cost, words, text) in some.items():
                            put(following, state, (cost + self.SHORTER * (n - times if n < 3 else 0), words, text))
            states = following or states
        ends = [(close(state, cost, text) if text else cost, (*words, text) if text else words) for state, (cost, words, text) in states.items()]
        return list(min(ends)[1]) if ends else [written]


@lru_cache(maxsize=2)
def _channel(words: str) -> Channel:
    """A task's channel, made once for each worker."""
    return Channel(frozenset(words.split()))


#: Means of the prior of the feature weights: general knowledge of what makes language abusive. Labels move them.
PRIOR = {
    "bias": -4.5, "insult": 1.2, "insult_2": 3.0, "insult_you": 4.6, "insult_adjective": 3.0, "adjective_2": 1.1, "adjective_you": 4.0, "insult_they": 1.0, "adjective_they": 0.5, "group_dehuman": 5.2, "group_insult": 4.6, "group_exclude": 4.6, "group_violence": 2.5, "group_adjective": 3.0,
    "dehuman_2": 1.5, "dehuman_you": 3.2, "exclude_2": 0.6, "violence_you": 4.6, "violence_your_body": 5.0, "fate_you": 2.4, "harm_you": 4.4, "violence_fate": 0.6, "idiom": 5.0, "sexual": 3.2, "sexual_2": 3.0, "sensual_2": 2.7, "sensual_3": 2.2, "sensual_person": 1.2, "sexual_person": 1.5,
    "hidden": 3.2, "self": -4.0, "talk": -2.5,
}
_BIT = {name: 1 << i for i, name in enumerate(L.LEXICON)}
#: No class feature holds without a word of the first classes, an idiom's word or a hidden one, or one of the others and one more word of the lexicon.
_CORE = sum(_BIT[n] for n in ("INSULT", "SEXUAL"))
_WEAK = sum(_BIT[n] for n in ("ADJECTIVE", "DEHUMAN", "EXCLUDE", "VIOLENCE", "FATE", "HARM", "SENSUAL"))
_LOOK, _APART = 1 << 30, 1 << 31
_REACH = 5


def _language(words: list[str]) -> set[str]:
    votes = {k: sum(w in some for w in words) for k, some in _FUNCTION.items()}
    most = max(votes.values())
    return {k for k, v in votes.items() if v == most}


def _own(word: str, languages: set[str], spoken: set[str]) -> bool:
    """Does a word of the lexicon count in a passage of these languages?"""
    return not (len(word) <= 4 or word in L.COLLIDING) or bool(languages & spoken)


def class_features(words: list[str], hidden: list[bool]) -> set[str]:
    """Names of the features that hold for a passage of restored words."""
    spoken = _language(words)
    at: dict[str, list[int]] = defaultdict(list)
    out: set[str] = set()
    for i, w in enumerate(words):
        for name, languages in CLASSES.get(w, {}).items():
            if _own(w, languages, spoken):
                at[name].append(i)
                if hidden[i] and name in HIDDEN_CLASSES:
                    out.add("hidden")
    once = {name: len({words[i] for i in places}) for name, places in at.items()}

    def near(a: str, b: str, before: int, after: int) -> bool:
        """Some word of class a has one of class b up to ``before`` words before it or ``after`` words behind it."""
        return any(-before <= j - i <= after and i != j for i in at.get(a, ()) for j in at.get(b, ()))

    english = spoken == {"en"}
    if "INSULT" in at:
        out.add("insult")
        if once["INSULT"] > 1:
            out.add("insult_2")
        if near("INSULT", "YOU", _REACH, _REACH):
            out.add("insult_you")
        if near("INSULT", "ADJECTIVE", 1, 1):
            out.add("insult_adjective")
        if near("INSULT", "THEY", _REACH, 1):
            out.add("insult_they")
    if "ADJECTIVE" in at:
        if once["ADJECTIVE"] > 1:
            out.add("adjective_2")
        if near("ADJECTIVE", "YOU", 3, 1):
            out.add("adjective_you")
        if near("ADJECTIVE", "THEY", 3, 0):
            out.add("adjective_they")
    if "GROUP" in at:
        out |= {f"group_{n.lower()}" for n in ("DEHUMAN", "INSULT", "EXCLUDE", "VIOLENCE", "ADJECTIVE") if n in at}
    if "DEHUMAN" in at:
        if once["DEHUMAN"] > 1:
            out.add("dehuman_2")
        if near("DEHUMAN", "YOU", 3, 0):
            out.add("dehuman_you")
    if once.get("EXCLUDE", 0) > 1:
        out.add("exclude_2")
    if "VIOLENCE" in at:
        # English has the person behind the verb, the others before it too.
        if near("VIOLENCE", "YOU", 0 if english else 3, 2):
            out.add("violence_you")
        if near("VIOLENCE", "BODY", 4, 6) and ("YOUR" in at or not english and "YOU" in at):
            out.add("violence_your_body")
        if "FATE" in at or "HARM" in at:
            out.add("violence_fate")
    if "FATE" in at:
        if "YOU" in at:
            out.add("fate_you")
    if "HARM" in at and ("YOU" in at or "YOUR" in at):
        out.add("harm_you")
    person = "YOU" in at or "THEY" in at or "SELF" in at
    if "SEXUAL" in at:
        out.add("sexual")
        if once["SEXUAL"] > 1 or "SENSUAL" in at:
            out.add("sexual_2")
        if person:
            out.add("sexual_person")
    if "SENSUAL" in at:
        if once["SENSUAL"] > 1:
            out.add("sensual_2")
        if once["SENSUAL"] > 2:
            out.add("sensual_3")
        if person and (once["SENSUAL"] > 1 or "SEXUAL" in at):
            out.add("sensual_person")
    if not _TRIGGERS.isdisjoint(words) and _IDIOMS.search(" ".join(words)):
        out.add("idiom")
    if out:
        if near("INSULT", "SELF", _REACH, _REACH) and "YOU" not in at or near("ADJECTIVE", "SELF", _REACH, _REACH) and "YOU" not in at and "GROUP" not in at:
            out.add("self")
        if not _TALK.isdisjoint(words):
            out.add("talk")
    return out


class Tokens(dict):
    """Written token -> its number; remembers the restored word, its weight and what it calls for, up to CACHE tokens."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words: list[str] = []
        self.odd: list[bool] = []
        self.weight: list[float] = []
        self.bits: list[int] = []
        #: Folded forms of what may be a piece of a word written apart.
        self.folded: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self.words)
        shown = token.endswith("\u0001")
        word = token if token in ENDS else token[:-1] if shown else self.model.restore(token)
        self.words.append(word)
        self.odd.append(word != token)
        self.weight.append(self.model.unigrams.get(word, 0.0))
        bits = sum(_BIT[name] for name in CLASSES.get(word, ()))
        if shown or word in _TRIGGERS or word != token and word in WORTH_HIDING:
            bits |= _LOOK
        # What no vocabulary knows may be part of a word that is written apart.
        form = fold(word) if token not in ENDS and len(word) <= 12 else ""
        self.folded.append(form if form in self.model.channel.fragments else "")
        if self.folded[-1] and word not in self.model.channel.known and not word.isdigit() and self.model.restoring:
            bits |= _APART
        self.bits.append(bits)
        return at


class Model:
    """Restoration and a logistic score of passages; what travels to a task is words and weights."""

    def __init__(self, words: str, unigrams: dict[str, float], pairs: dict[tuple[str, str], float], classes: dict[str, float], restoring: bool = True) -> None:
        self.vocabulary, self.unigrams, self.pairs, self.classes, self.restoring = words, unigrams, pairs, classes, restoring
        self._ready()

    def _ready(self) -> None:
        self.channel = _channel(self.vocabulary)
        self.tokens = Tokens(self)
        self.stretches: dict[str, list[str]] = {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("vocabulary", "unigrams", "pairs", "classes", "restoring")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def restore(self, token: str) -> str:
        """The word that a token stands for; the token itself if it is a word or the path ends in no known one.

        Plain words, numbers, hexadecimal codes and tokens that are mostly digits or masks stay.
        """
        known = self.channel.known
        plain_letters = token.isascii() and token.isalpha()
        if not self.restoring or token in known or len(token) < 3 or plain_letters and not _LONG_RUN.search(token):
            return token
        letters, digits = sum(c.isalpha() for c in token), sum(c.isdigit() for c in token)
        if digits and _HEX.match(token) or digits > letters + 1 or letters < token.count(MASK) - 2 or not letters:
            return token
        # A known reading folds like the token: without one no path needs to be looked for.
        if MASK not in token and fold(token) not in self.channel.folded:
            return token
        word = "".join(self.channel.decode(token))
        return word if word in known and len(word) > 2 else token

    def respelt(self, m: re.Match) -> str:
        """A stretch of single characters as the words that it spells; kept if none of them is worth hiding."""
        written = m.group(0)
        if sum(c.isalpha() for c in written) < 2:
            return written
        if written not in self.stretches:
            if len(self.stretches) > CACHE:
                self.stretches.clear()
            words = self.channel.decode(written, True)
            self.stretches[written] = words if any(w in WORTH_HIDING for w in words) else []
        words = self.stretches[written]
        # Doubled marks tell the scorer that a word was hidden.
        return " ".join(w + "\u0001" if w in WORTH_HIDING else w for w in words) if words else written

    def apart(self, flat: list[str], ids: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """Words written apart: start, number of pieces and the word, where up to four neighbours, one of them unknown, make up one worth hiding."""
        folded, worth, bits = self.tokens.folded, self.channel.folded_worth, self.tokens.bits
        reached, ids = 0, ids.tolist()
        for at in [k for k, i in enumerate(ids) if bits[i] & _APART]:
            for a in range(max(reached, at - 3), at + 1):
                whole = ""
                for z in range(a, min(a + 4, len(flat))):
                    piece = folded[ids[z]]
                    if not piece:
                        break
                    whole = whole + piece[1:] if whole and whole[-1] == piece[0] else whole + piece
                    if z > a and z >= at and len(whole) >= 4 and whole in worth:
                        written = "".join(flat[a : z + 1])
                        word = written if written in WORTH_HIDING else self.restore(written)
                        if len(written) >= 5 and word in WORTH_HIDING:
                            reached = z + 1
                            yield a, z + 1 - a, word
                            break
                if reached > at:
                    break

    def text_tokens(self, text: str) -> list[str]:
        text = plain(text)
        if self.restoring and _SPACED_PART.search(text):
            text = _SPACED.sub(self.respelt, text)
            if "\u0001" in text:
                return re.findall(r"[@$!|]?[^\W_]+(?:[@$*!|€]+[^\W_]+)*[*$]*\u0001?|[.!?](?=\s)|\n", text)
        if any(c in text for c in _MARKS):
            return _TOKEN.findall(text)
        return (_ASCII_TOKEN if text.isascii() else _PLAIN_TOKEN).findall(text)

    def features(self, written: list[str]) -> tuple[set[str], list[str]]:
        """Class features and restored words of a passage."""
        hidden = [w.endswith("\u0001") for w in written]
        bare = [w.rstrip("\u0001") for w in written]
        words = [self.tokens.words[self.tokens[w]] for w in bare]
        odd = [h or a != b for a, b, h in zip(bare, words, hidden, strict=True)]
        if self.restoring:
            ids = np.array([self.tokens[w] for w in bare], np.int64)
            for a, n, word in reversed(list(self.apart(bare, ids))):
                words[a : a + n], odd[a : a + n] = [word], [True]
        return class_features(words, odd), words

    def margin(self, written: list[str]) -> float:
        features, words = self.features(written)
        return (
            self.classes["bias"] + sum(self.unigrams.get(w, 0.0) for w in words) + sum(self.pairs.get(p, 0.0) for p in zip(words, words[1:], strict=False)) + sum(self.classes[f] for f in features)
        )

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, int]]:
        """For each text the probability of its worst passage, and how many passages reach the threshold."""
        edge = math.log(THRESHOLD / (1 - THRESHOLD))
        for a in range(0, len(texts), AT_ONCE):
            if len(self.tokens) > CACHE:
                self.tokens.reset()
            lists = [self.text_tokens(t) if t else [] for t in texts[a : a + AT_ONCE]]
            flat = [t for some in lists for t in some]
            ids = np.fromiter(map(self.tokens.__getitem__, flat), np.int64, len(flat))
            weight, bits = np.array(self.tokens.weight + [0.0]), np.array(self.tokens.bits + [0], np.int64)
            lengths = np.array([len(x) for x in lists])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ended = np.fromiter((t in ENDS for t in self.tokens.words), bool, len(self.tokens.words))[ids] if len(ids) else np.zeros(0, bool)
            begins = np.union1d(starts[:-1][lengths > 0], np.flatnonzero(ended) + 1)
            begins = begins[begins < len(ids)].astype(np.int64)
            worst, n = np.full(len(lists), -50.0), np.zeros(len(lists), np.int64)
            if len(begins):
                margin = self.classes["bias"] + np.add.reduceat(weight[ids], begins)
                called = np.bitwise_or.reduceat(bits[ids], begins)
                several = np.add.reduceat((bits[ids] & (_LOOK - 1) != 0).astype(np.int64), begins) > 1
                look = (called & (_CORE | _LOOK) != 0) | (called & _WEAK != 0) & several
                for at, _, _ in self.apart(flat, ids):
                    look[np.searchsorted(begins, at, side="right") - 1] = True
                # A passage between two ends has no word at all.
                stops = np.append(begins[1:], len(ids))
                for p in np.flatnonzero(look).tolist():
                    margin[p] = self.margin([t for t in flat[begins[p] : stops[p]] if t not in ENDS])
                text = np.searchsorted(starts, begins, side="right") - 1
                np.maximum.at(worst, text, margin)
                np.add.at(n, text, margin >= edge)
            for w, k in zip(worst.tolist(), n.tolist(), strict=True):
                yield (1 / (1 + math.exp(-w)) if w > -50 else 0.0), k

    def score(self, text: str | None) -> tuple[float, int]:
        return next(self.scores([text]))


def _fit(x: np.ndarray, y: np.ndarray, mean: np.ndarray, l2: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton steps with line search, solved in the space of the samples (few samples, many features)."""
    w = mean.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(l2 * (v - mean) ** 2))

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + l2 * (w - mean)
        s = np.maximum(p * (1 - p), 1e-6)
        scaled = x / l2
        move = gradient / l2 - scaled.T @ np.linalg.solve(np.diag(1 / s) + scaled @ x.T, scaled @ gradient)
        now, slope, t = loss(w), float(gradient @ move), 1.0
        while t > 1e-6 and loss(w - t * move) > now - 1e-4 * t * slope:
            t /= 2
        w = w - t * move
        if np.abs(t * move).max() < 1e-5:
            break
    return w


def vocabulary_of(rows: list[tuple[str, str]], paths: tuple[str, ...] = (DICTIONARY_PATH, MULTILINGUAL_PATH)) -> str:
    """Words of the public vocabularies and of the labelled texts, as one string."""
    seen = {w for t, _ in rows for w in re.findall(r"[^\W\d_]{3,}", plain(t)) if not _LONG_RUN.search(w)}
    words = {w for p in paths for w in spaced_words(p)} | seen
    return " ".join(sorted(w for w in words if set(w) <= set(LETTERS)))


def train(rows: list[tuple[str, str]], l2_words: float = 4.0, l2_classes: float = 0.3, rounds: int = 3, paths: tuple[str, ...] = (DICTIONARY_PATH, MULTILINGUAL_PATH)) -> Model:
    """Logistic model over words, pairs with a word of a class, and class features, of labelled texts ``(text, label)``.

    A positive text has a passage that is positive, which one is not known: each round takes the one that scores highest under the
    weights of the round before, the first under the prior; the others and all passages of negative texts are negative.
    """
    vocabulary = vocabulary_of(rows, paths)
    model = Model(vocabulary, {}, {}, dict(PRIOR))
    names: dict = {k: i for i, k in enumerate(PRIOR)}
    bags, of_text, count = [], [], Counter()
    for k, (text, _) in enumerate(rows):
        passage: list[str] = []
        for token in [*model.text_tokens(text or ""), "\n"]:
            if token not in ENDS:
                passage.append(token)
            elif passage:
                features, words = model.features(passage)
                bag = {"bias"} | features | {("u", w) for w in words if w.isalpha()} | {("p", *p) for p in zip(words, words[1:], strict=False) if p[0] in CLASSES or p[1] in CLASSES}
                bags.append(bag)
                of_text.append(k)
                count.update(bag)
                passage = []
    for f, n in sorted(count.items(), key=str):
        if f not in names and n >= 3:
            names[f] = len(names)
    x = np.zeros((len(bags), len(names)))
    for i, own in enumerate(bags):
        x[i, [names[f] for f in own if f in names]] = 1
    label = np.array([(v or "").strip().lower() not in ("none", "") for _, v in rows], bool)
    mean, l2 = np.zeros(len(names)), np.full(len(names), l2_words)
    mean[: len(PRIOR)], l2[: len(PRIOR)] = list(PRIOR.values()), l2_classes
    w, owner = mean, np.array(of_text, np.int64)
    for _ in range(rounds if len(bags) else 0):
        z, y = x @ w, np.zeros(len(bags))
        for k in np.unique(owner).tolist():
            own = np.flatnonzero(owner == k)
            y[own[np.argmax(z[own])]] = label[k]
        w = _fit(x, y, mean, l2)
    unigrams = {f[1]: float(w[i]) for f, i in names.items() if f[0] == "u" and isinstance(f, tuple) and abs(w[i]) > 1e-3}
    pairs = {f[1:]: float(w[i]) for f, i in names.items() if f[0] == "p" and isinstance(f, tuple) and abs(w[i]) > 1e-3}
    return Model(vocabulary, unigrams, pairs, {k: float(w[names[k]]) for k in PRIOR})


def fit(labels: DataFrame) -> Model:
    """Model of a labelled table ``text, label``; at most MAX_LABELS rows in the order of their text."""
    rows = labels.where("text is not null and label is not null").select("text", "label").orderBy(F.xxhash64("text"), "text").limit(MAX_LABELS).collect()
    return train([(r["text"], r["label"]) for r in rows])


def score_documents(documents: DataFrame, model: Model, id_column: str, keep: list[str] | None = None) -> DataFrame:
    """``id_column, *keep, score, n_passages, affected`` of every document; whole texts, no shuffle.

    ``score`` is the probability of the worst passage, ``n_passages`` counts passages at or above
    THRESHOLD, ``affected`` says there is one. Null, empty and blank texts score 0. Rows are kept as
    they are, repeated ones too; an empty table gives no rows.
    """
    kept = [id_column, *(keep or [])]
    kinds = dict(documents.dtypes)
    rows = documents.select(*kept, F.col("text").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(model.scores(batch.column(len(kept)).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array([s for s, _ in done], pa.float64()), pa.array([n for _, n in done], pa.int32())],
                names=[*kept, "score", "n_passages"],
            )

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double, n_passages int"
    return rows.mapInArrow(work, fields).withColumn("affected", F.col("n_passages") > 0)


def rates(scored: DataFrame, source: str) -> DataFrame:
    """Documents, affected documents and their share for every source."""
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("affected").alias("n_affected"), (F.count_if("affected") / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score")
    )
