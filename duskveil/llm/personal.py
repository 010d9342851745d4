"""Personal information in free text by bootstrapped contextual extraction.

Candidates of each kind are found by their shape, each with its lexical context (the words around
it) and its instances (what recurs of it: a name's parts, a mail domain, a number's format, a
street). Seeds are instances known to be right. On the bipartite graph of contexts and instances
Spark scores iteratively: a context is as good as its instances, an instance gains from every good
context. Good contexts so find instances that no seed knew.

Seeds come from the name list, from check digits and from labels only: a full name of the list, a mail
address with such a name in it, a number with valid check digits, and numbers and addresses behind a
word that says what they are. All other candidates stand or fall by the graph.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage, checkpointed
from .credentials import DICTIONARY_PATH
from .spans import splice

ROUNDS = 3
#: Parts that a hot context or instance is spread over in joins.
SALTS = 16
#: Least trust of a context and belief in an instance for a candidate of each kind; a seed needs less. A name is two instances.
MAIL_TRUST, MAIL_BELIEF = 0.2, 0.3
PHONE_TRUST, PHONE_FORM = 0.25, (0.5, 0.05)
NUMBER_TRUST, NUMBER_BELIEF, NUMBER_SEED_TRUST = 0.3, 0.2, 0.1
ADDRESS_TRUST, ADDRESS_TYPE = 0.6, 0.4

_AT = r"(?:\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?|&#64;|%40|＠)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}]\s?|\sdot\s)"
_MAIL_LOCAL = re.compile(r"[\w%+][\w.%+\-]*\Z")
_MAIL_DOMAIN = re.compile(r"@[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)*\.[^\W\d_]{2,}")
_MAIL_HIDDEN = re.compile(rf"(?i)[\w%+\-]+(?:(?:{_DOT})[\w%+\-]+)*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+")
_MAIL_SPELT = re.compile(r"(?i)(?<![\w.])[\w%+\-]+(?:(?:\.| dot )[\w%+\-]+)*(?: at | @ )[\w\-]+(?:(?: dot | \. )[\w\-]+)+(?![\w\-]| at | @ )")
_GAP = r" ()/.\-\u00a0\u2007\u2009\u202f"
_PHONE = re.compile(
    rf"(?<![\w.+/\-])(?:(?:\+|00)[1-9]\d{{0,2}}[{_GAP}]{{0,2}}\(?\d[\d{_GAP}]{{5,16}}\d|\(?0\d{{1,5}}\)?[{_GAP}]{{1,2}}\d[\d{_GAP}]{{3,12}}\d|(?:1[{_GAP}])?(?:\(\d{{3}}\)[{_GAP}]?|\d{{3}}[{_GAP}])\d{{3}}[{_GAP}]\d{{4}})(?![\w\-]|[.:/]\d)"
)
_ID = re.compile(
    r"(?<![\w+/.\-])(?:[A-Z]{1,3}\d{1,2}[A-Z0-9]{3,12}|\d{7,9}[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}-\d{2}-\d{4}|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[A-Z]{2} ?\d\d(?: ?\d\d){2} ?[A-D]|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d\d)?|\d{9}|\d{2} ?\d{3} ?\d{3} ?\d{3})(?![\w+/=\-]|\.\d)"
)
_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_SMALL = r"(?:de la|de las|de los|del|de|du|des|d['’]|la|le|les|l['’]|aux|au|à la|à)"
_ADDRESS = [
    re.compile(rf"(?<![\w.\-:])\d{{1,4}} ?[a-hA-H]?,? (?:[{_UP}][\w'’\-]+ ){{1,4}}(?:Street|Avenue|Lane|Road|Boulevard|Drive|Court|Close|Terrace|Crescent|Way|Row|Gardens|Grove|Walk|Place|Square|Hill|Mews|Parkway|St\.|Ave\.|Rd\.|Ln\.|Blvd\.|Dr\.|Ct\.|Pl\.|Sq\.|(?:St|Ave|Rd|Ln|Blvd|Dr|Ct|Pl|Sq)(?![\w.])|(?:St|Ave|Rd|Ln|Blvd|Dr|Ct|Pl|Sq)\b)(?!\w)"),
    re.compile(rf"(?<![\w.\-:])\d{{1,4}}(?: ?(?:bis|ter|[a-hA-H])\b)?,? (?:rue|impasse|avenue|allée|place|boulevard|chemin|quai|cours|passage|square|route|ruelle|sentier)(?: {_SMALL}|(?<=['’]))*[ ]?[{_UP}][\w'’\-]+(?:(?: {_SMALL})* [{_UP}][\w'’\-]+)*"),
    re.compile(rf"(?<!\w)(?:[{_UP}][\w\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|steig|graben|chaussee|pfad|markt)|(?:[{_UP}][\w\-]+ )?(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee)|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Hinter der|Unter den) [{_UP}][\w\-]+(?: [{_UP}][\w\-]+)?) \d{{1,4}}(?: ?[a-h](?!\w))?(?!\w)"),
    re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.|Av\.|C/|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía|Carrera|Vía)(?: (?:de|del|la|las|los|el|y))* ?[{_UP}][\w\-]+(?: (?:de|del|la|las|los|el|y|[{_UP}][\w\-]+))*,? (?:n[.º°]* ?)?\d{{1,4}}(?: ?[a-hA-H](?!\w))?(?!\w)"),
]
#: Any capitalised words with a number: only a good context makes these an address.
_ADDRESS_ANY = [re.compile(rf"(?<![\w.\-:])\d{{1,4}} (?:[{_UP}][{_LOW}'’\-]+)(?: [{_UP}][{_LOW}'’\-]+){{0,3}}(?! ?[:=(])"), re.compile(rf"(?<![\w.\-])[{_UP}][{_LOW}'’\-]{{3,}}(?: (?:de|del|der|la|{_SMALL}))*(?: [{_UP}][{_LOW}'’\-]+){{0,3}} \d{{1,4}}(?![\w.:\-])")]
#: Cheap looks for the places where a candidate may begin; they start with a character class, which the search skips to.
_DIGIT_START = re.compile(r"[0-9](?<![\w.\-:].)[0-9]{0,3}(?![0-9])")
_PHONE_START = re.compile(r"[+(0-9](?<![\w.+/\-].)")
_ID_START = re.compile(r"[A-Z0-9](?<![\w+/.\-].)(?=[A-Z]{0,2}[ \-]?\d)")
_NAME_START = re.compile(rf"[{_UP}](?<![\w@.\-/].)[^\W\d_]+(?:['’\-][^\W\d_]+)*,? (?=[{_UP}a-z])")
_STREET_END = re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|steig|graben|chaussee|pfad|markt)\Z")
#: What tells the type of a typed street: the ending or word that the patterns ask for, else its first word.
_STREET_TYPE = re.compile(r"(?:straße|strasse|str|gasse|weg|platz|allee|ufer|ring|damm|steig|graben|chaussee|pfad|markt|street|avenue|lane|road|boulevard|drive|court|close|terrace|crescent|way|row|gardens|grove|walk|place|square|hill|mews|parkway|st|ave|rd|ln|blvd|dr|ct|pl|sq)(?=\W*\Z)|\A[^\W\d_]+|\A.")
_PARTICLE = r"(?:van|von|vom|zu|zum|zur|de|del|della|di|da|do|dos|das|du|der|den|la|le|los|las|ten|ter|bin|ibn|al|el|af|av|mac|mc|y|e|st\.)"
_PART = rf"[{_UP}][{_LOW}]+(?:['’\-][{_UP}]?[{_LOW}]+)*(?:[{_UP}][{_LOW}]+)?"
_NAME = re.compile(rf"(?<![\w@.\-/]){_PART}(?: (?:[{_UP}]\.|{_PARTICLE}|{_PART}))+(?![\w@/])")
#: Parts of the longest name.
MOST_PARTS = 7
_NAME_TURNED = re.compile(rf"(?<![\w@.\-/])((?:{_PARTICLE} ){{0,3}}{_PART}), ({_PART}(?: [{_UP}]\.)?)(?![\w@/])")
_CAPS = rf"[{_UP}]{{2,}}(?:['’\-][{_UP}]{{2,}})*"
_NAME_CAPS = re.compile(rf"(?<![\w@.\-/]){_CAPS}(?: (?:[{_UP}]\.|{_CAPS}))+(?![\w@/])")
_NAME_CAPS_TURNED = re.compile(rf"(?<![\w@.\-/])({_CAPS}(?: {_CAPS}){{0,3}}), ({_CAPS}(?: [{_UP}]\.)?)(?![\w@/])")
_CONTEXT = re.compile(r"[^\W_]+|[^\w\s]")
_PARTICLES_BEFORE = re.compile(rf"(?<!\w)((?:(?:{_PARTICLE}) )+)\Z")
_PARTICLE_WORD = re.compile(rf"(?i){_PARTICLE}\Z")

#: Local parts of machine addresses, and forms of service accounts.
_MACHINE = re.compile(r"(?i)^(?:git|svn|hg|no-?reply|do-?not-?reply|mailer-daemon|postmaster|root|nobody|www-data|(?:svc|service|srv|bot|ci|build|deploy|jenkins|cron|daemon|system|robot)(?:[-_.+].*)?|.*[-_.](?:bot|svc|service|robot))$|\[bot\]")
_MACHINE_DOMAIN = re.compile(r"(?i)(?:^|\.)(?:gserviceaccount\.com|noreply\.\w+\.\w+|localhost|local|internal|svc|cluster\.local)$")
#: Words of address and role before a name; they are no part of it.
_TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau dipl ing señor señora sr sra don doña monsieur madame mademoiselle mme mlle maître customer client patient dear author hello hi hallo hola bonjour liebe lieber sehr please contact ask cc from to by attn kunde kundin cliente paciente patientin".split())
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _iban(value: str) -> bool:
    v = re.sub(r"\s", "", value)
    return 15 <= len(v) <= 34 and v[:2].isalpha() and v[2:4].isdigit() and v.isalnum() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def known_number(value: str) -> bool:
    """Identity numbers that carry their own proof: check letters and digits, or a format of their own."""
    v = re.sub(r"[ .\-]", "", value.upper())
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", v):
        digits = v[:-1].translate(str.maketrans("XYZ", "012"))
        return _DNI[int(digits) % 23] == v[-1]
    return bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", value) or re.fullmatch(r"(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]", v) or _iban(value))


#: Labels of identity numbers; what follows one is a seed.
_LABEL = re.compile(
    r"(?i)(?:passport|passeport|pasaporte|reisepass|ausweis|identity card|id card|carte d.identité|\bcni|\bdni|\bnie|\bnif|\bssn|social security|national insurance|\bnino|sozialversicherung|steuer-?id|tax id|\biban|insee|\bnir|sécurité sociale|seguridad social|driving licen[cs]e|führerschein)"
    r"\w*[\s.:#=°º\"'\-]*(?:(?:no|nr|n[°º]|num(?:ber|mer|éro|ero)?)\b)?[\s.:#=°º\"'\-]*\Z"
)


#: Labels of phone numbers and addresses; what follows one is a seed.
_PHONE_LABEL = re.compile(r"(?i)(?:tel|phone|telephone|mobile|cell|cellphone|call|fax|hotline|telefon|telefonnummer|handy|mobil|móvil|teléfono|llamar|llama|portable|téléphone|appeler|appelez|rufnummer|number|nummer|número|numéro)\w{0,2}\.?[\s\"'=:(\[]{1,4}(?:is |ist |es |est |me at |on |at |unter |al |au )?\Z")
_ADDRESS_LABEL = re.compile(r"(?i)(?:address|addr|adresse|anschrift|dirección|domicilio|domicile|wohnhaft|wohnt|wohne|lives? at|living at|moved to|vive en|vivo en|habite|street|straße|calle|rue|ship to|deliver to|home)[\s\"'=:,(\[]{1,4}(?:is |ist |es |est |in |in der |au |à la |en )?\Z")


@lru_cache(maxsize=2)
def ordinary_words(path: str) -> frozenset[str]:
    """Words that the public vocabulary knows better in lower case than capitalised."""
    low: dict[str, int] = {}
    high: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.partition(b" ")
            word = base64.b64decode(token)
            if word[:1] == b" " and len(word) > 2 and word[1:].isalpha() and word.isascii():
                text = word[1:].decode()
                if text.islower():
                    low.setdefault(text, int(rank))
                elif text[1:].islower():
                    high.setdefault(text.lower(), int(rank))
    return frozenset(w for w, r in low.items() if r < high.get(w, 1 << 30))


def _shape(value: str) -> str:
    return re.sub(r"\d+", lambda m: f"{len(m.group(0))}", re.sub(r"[A-Z]+", lambda m: "A" * min(len(m.group(0)), 3), value)) if len(value) < 60 else "long"


class Candidates:
    """Candidates of one text: ``(kind, start, end, seed, keys, contexts, variant)``.

    ``seed`` is 1 for a known instance, -1 for a known non-case, 0 otherwise.
    """

    def __init__(self, given: frozenset[str], family: frozenset[str], allowed: frozenset[str], words: frozenset[str]) -> None:
        self.given, self.family, self.allowed = given, family, allowed
        self.ordinary = words - given - family

    def contexts(self, text: str, start: int, end: int) -> list[str]:
        """The two tokens before within the line, with the one after and without; numbers as 0, ^ and $ are the line's ends."""
        a = max(text.rfind("\n", max(0, start - 48), start) + 1, start - 48, 0)
        at_start = a == 0 or text[a - 1] == "\n"
        left = _CONTEXT.findall(text[a:start])
        if not at_start and left and text[a].isalnum() and text[a - 1].isalnum():
            left = left[1:]
        z = text.find("\n", end, end + 24)
        right = _CONTEXT.findall(text[end : z if z >= 0 else end + 24])
        left = (["^"] if at_start and len(left) < 2 else []) + left[-2:]
        more = right[0] if right else "$"
        before = " ".join("0" if t.isdigit() else t.lower() for t in left)
        return [before + " _ " + ("0" if more.isdigit() else more.lower()), before + " _"]

    def named(self, local: str) -> bool:
        """Does the local part of a mail address hold a listed given and a listed family name?"""
        parts = set(re.split(r"[\W\d_]+|dot|punkt|punto", local.lower()))
        return not self.given.isdisjoint(parts) and not self.family.isdisjoint(parts)

    def of(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        taken: list[tuple[int, int]] = []
        self.streets: list[tuple[int, int]] = []

        def clear(a: int, z: int) -> bool:
            return all(z <= x or a >= y for x, y in taken)

        def add(kind: str, a: int, z: int, seed: int, keys: list[str], variant: int = 0, claim: bool = True) -> None:
            contexts = self.contexts(text, a, z)
            # Words with no form of their own need the narrower context.
            out.append((kind, a, z, -1 if text[a:z] in self.allowed else seed, keys, contexts[:1] if kind in ("name", "address") else contexts, variant))
            if claim:
                taken.append((a, z))

        self._mail(text, add, clear)
        digits = re.search(r"\d", text) is not None
        if digits:
            starts = [m.span() for m in _DIGIT_START.finditer(text)]
            for pattern, generic in ((_ADDRESS, False), (_ADDRESS_ANY, True)):
                if generic:
                    self._numbers(text, add, clear)
                    self._names(text, add, clear)
                for a, z in starts:
                    for m in self._addresses(text, a, z, pattern):
                        if clear(*m.span()):
                            if not generic:
                                self.streets.append(m.span())
                            name = re.sub(r"\d+", "", m.group(0)).lower().strip(" ,.")
                            keys = ["street:" + name] if generic else ["street:" + name, "type:" + _STREET_TYPE.search(name).group(0)]
                            add("address", *m.span(), int(not generic and _ADDRESS_LABEL.search(text, max(0, m.start() - 40), m.start()) is not None), keys)
        else:
            self._names(text, add, clear)
        return out

    @staticmethod
    def _addresses(text: str, a: int, z: int, patterns: list[re.Pattern]) -> Iterator[re.Match]:
        """Addresses that begin or end with the number at a..z. Patterns: the first ones begin with it, the rest end with it."""
        if z < len(text) and text[z] in " ,abcdefghABCDEFGHbt":
            for pattern in patterns[: len(patterns) // 2]:
                if m := pattern.match(text, a):
                    yield m
        if a > 2 and text[a - 1] in " º°.":
            word = text[text.rfind(" ", 0, a - 1) + 1 : a - 1]
            if word[:1].isupper() or word[-1:] in ".,º°" or _STREET_END.search(word) or "/" in word:
                for pattern in patterns[len(patterns) // 2 :]:
                    for m in pattern.finditer(text, max(text.rfind("\n", 0, a) + 1, a - 70), min(len(text), z + 4)):
                        if m.start() < a < m.end():
                            yield m

    @staticmethod
    def _numbers(text: str, add, clear) -> None:
        reached = 0
        for start in _PHONE_START.finditer(text):
            if start.start() < reached or not (m := _PHONE.match(text, start.start())):
                continue
            a, z = m.span()
            reached = z
            n = sum(c.isdigit() for c in m.group(0))
            if not 9 <= n <= 15 or not clear(a, z) or re.match(r"\d{4}-\d\d-\d\d", m.group(0)):
                continue
            add("phone", a, z, int(_PHONE_LABEL.search(text, max(0, a - 40), a) is not None), ["form:" + re.sub(r"\s", " ", re.sub(r"\d", "0", m.group(0)))])
        reached = 0
        for start in _ID_START.finditer(text):
            if start.start() < reached or not (m := _ID.match(text, start.start())):
                continue
            reached = m.end()
            if clear(*m.span()):
                labelled = _LABEL.search(text, max(0, m.start() - 40), m.start()) is not None
                add("id_number", *m.span(), int(labelled or known_number(m.group(0))), ["form:" + _shape(m.group(0))])

    def _mail(self, text: str, add, clear) -> None:
        if "@" in text:
            reached = 0
            for d in _MAIL_DOMAIN.finditer(text):
                m = _MAIL_LOCAL.search(text, max(reached, d.start() - 128), d.start())
                if not m:
                    continue
                a, z = m.start(), d.end()
                reached = z
                if text[a] in "+%" and a and text[a - 1].isalnum():
                    continue
                word = text[max(text.rfind(" ", 0, a), text.rfind("\n", 0, a), text.rfind('"', 0, a), text.rfind("'", 0, a)) + 1 : a]
                credentials = "://" in word or text[a - 1 : a] == "/"
                repository = bool(re.match(r":[\w~./\-]*[A-Za-z_/]", text[z : z + 12]))
                local, domain = text[a:z].rsplit("@", 1)
                machine = bool(_MACHINE.search(local) or _MACHINE_DOMAIN.search(domain))
                add("email", a, z, -1 if credentials or repository or machine else int(self.named(local)), ["domain:" + domain.lower()])
        lower = text.lower()
        if any(x in lower for x in ("[at", "(at", "{at", "<at", "[@", "(@", "&#64;", "%40", "＠", "arroba", "[ at", "( at")):
            for m in _MAIL_HIDDEN.finditer(text):
                if clear(*m.span()):
                    self._hidden_mail(m, add)
        if " dot " in lower and " at " in lower or " @ " in text:
            for m in _MAIL_SPELT.finditer(text):
                if clear(*m.span()):
                    self._hidden_mail(m, add)

    def _hidden_mail(self, m: re.Match, add) -> None:
        plain = re.sub(rf"(?i){_AT}| at | @ ", "@", m.group(0), count=1)
        local, _, domain = plain.rpartition("@")
        domain = re.sub(rf"(?i){_DOT}", ".", domain).replace(" ", "").lower()
        add("email", *m.span(), -1 if _MACHINE.search(local) else int(self.named(local)), ["domain:" + domain])

    def _names(self, text: str, add, clear) -> None:
        reached = [0, 0, 0, 0]
        for start in _NAME_START.finditer(text):
            for k, (pattern, turned) in enumerate(((_NAME_TURNED, True), (_NAME, False), (_NAME_CAPS_TURNED, True), (_NAME_CAPS, False))):
                if start.start() < reached[k] or not (m := pattern.match(text, start.start())):
                    continue
                reached[k] = m.end()
                if turned:
                    # Particles before a family name belong to it.
                    lead = _PARTICLES_BEFORE.search(text, max(0, m.start() - 16), m.start())
                    self._name(text, lead.start(1) if lead else m.start(), m.end(), m.group(2).split(" ")[0], m.group(1).split(" ")[-1], add, clear, True)
                    continue
                # A capitalised run may hold words before or after the name, or several names: each stretch is a variant.
                parts = [(p.start() + m.start(), p.end() + m.start(), p.group(0)) for p in re.finditer(r"\S+", m.group(0))]
                low = [p[2].lower() for p in parts]
                # Where a listed family name ends one full name and a listed given name that is no family name begins another.
                ends = [k for k in range(2, len(parts) - 1) if low[k - 1] in self.family and low[k] in self.given and low[k] not in self.family]
                for i in range(len(parts) - 1):
                    for j in range(min(len(parts), i + MOST_PARTS), i + 1, -1):
                        first, last = parts[i], parts[j - 1]
                        if first[2].endswith(".") or last[2].endswith(".") or _PARTICLE_WORD.match(last[2]) or _PARTICLE_WORD.match(first[2]) and first[2].islower():
                            continue
                        if low[i] in self.given and low[j - 1] in self.family and any(i + 2 <= k <= j - 2 for k in ends):
                            continue
                        self._name(text, first[0], last[1], first[2], last[2], add, clear, False)

    def _name(self, text: str, a: int, z: int, given: str, family: str, add, clear, turned: bool) -> None:
        given, family = given.lower(), family.lower()
        if given in _TITLES or len(given) < 2 or len(family) < 3 or given in self.ordinary or family in self.ordinary or not clear(a, z):
            return
        # A town after an address is no name.
        if any(z_ <= a and a - z_ <= 3 and not text[z_:a].strip(" ,;\n\r\t") for _, z_ in self.streets):
            return
        tail = family.split("-")[-1]
        known_given, known_family = given in self.given, family in self.family or tail in self.family or family.split("-")[0] in self.family
        if turned and not (known_given or known_family):
            # Two capitalised words with a comma are mostly a list.
            add("name", a, z, 0, ["given:" + given, "family:" + tail], 1, False)
            return
        add("name", a, z, int(known_given and known_family), ["given:" + given, "family:" + tail], 0, False)


_ROW = "kind string, a int, z int, seed int, keys array<string>, contexts array<string>, found_text string"


def occurrences(messages: DataFrame, id_column: str, text_column: str, given: frozenset[str], family: frozenset[str], allowed: frozenset[str], path: str = DICTIONARY_PATH) -> DataFrame:
    """All candidates of all texts: ``id_column, text_key`` (hash of the text) and the columns of a candidate."""
    kind = dict(messages.dtypes)[id_column]
    rows = messages.select(id_column, F.xxhash64(text_column).alias("text_key"), text_column)
    words = ordinary_words(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Candidates(given, family, allowed, words)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    for kind, a, z, seed, keys, contexts, _ in finder.of(text):
                        at.append(i)
                        found.append((kind, a, z, seed, keys, contexts, text[a:z]))
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            take = pa.array(np.array(at, np.int64))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))],
                names=[id_column, "text_key", "kind", "a", "z", "seed", "keys", "contexts", "found_text"],
            )

    return rows.mapInArrow(work, f"{id_column} {kind}, text_key bigint, {_ROW}")


def _spread(scores: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return scores.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of contexts ``kind, context, trust`` and of instances ``kind, key, belief``.

    Each round a context's trust becomes the mean belief of its distinct instances (shrunk by the
    weight of two unknown ones), then an instance's belief the noisy-or of the contexts it stands in,
    not less than its seed. Edges are distinct (kind, context, key); joins are salted on both sides, so
    a context or an instance that a third of all candidates share is spread, and all sums combine map-side.
    Without rounds no context is trusted and only seeds are believed.
    """
    edges = Stage(
        found.select("kind", F.explode("contexts").alias("context"), "keys", "seed").select("kind", "context", F.explode("keys").alias("key"), "seed")
        .groupBy("kind", "context", "key")
        .agg(F.avg(F.greatest("seed", F.lit(0))).alias("seed"), F.max(F.when(F.col("seed") < 0, 1).otherwise(0)).alias("barred")),
        "personal-edges",
    ).df
    seeds = edges.groupBy("kind", "key").agg(F.max("seed").alias("seed"), F.max("barred").alias("barred"))
    belief = checkpointed(seeds.select("kind", "key", F.when(F.col("barred") == 1, 0.0).otherwise(F.col("seed") * 0.95).alias("belief"), F.col("seed").alias("known"), "barred"))
    trust = edges.sparkSession.createDataFrame([], "kind string, context string, trust double")
    for _ in range(rounds):
        trust = checkpointed(
            edges.withColumn("salt", _salt("context")).join(_spread(belief.select("kind", "key", "belief")), ["kind", "key", "salt"])
            .groupBy("kind", "context")
            .agg((F.sum(F.greatest("belief", "seed")) / (F.count(F.lit(1)) + 2.0)).alias("trust"))
        )
        gained = edges.withColumn("salt", _salt("key")).join(_spread(trust), ["kind", "context", "salt"]).groupBy("kind", "key").agg((1 - F.exp(F.sum(F.log(1 - 0.8 * F.least("trust", F.lit(0.98)))))).alias("gained"))
        belief = checkpointed(
            belief.join(gained, ["kind", "key"], "left").select("kind", "key", F.greatest(F.col("known") * 0.95, F.coalesce("gained", F.lit(0.0))).alias("belief"), "known", "barred")
        )
    return trust, belief.select("kind", "key", "belief")


def extract(found: DataFrame, id_column: str, rounds: int = ROUNDS) -> DataFrame:
    """Candidates that the bootstrapped scores confirm: ``id_column, text_key, kind, a, z, found_text``.

    A candidate's trust is that of its better context. All its contexts and instances are looked up in one
    salted join. Of overlapping variants of one name the best scored, then the longest, is kept.
    """
    trust, belief = bootstrap(found, rounds)
    scores = _spread(trust.select("kind", F.concat(F.lit("c:"), "context").alias("name"), F.col("trust").alias("score")).unionByName(belief.select("kind", F.concat(F.lit("k:"), "key").alias("name"), F.col("belief").alias("score"))))
    first, last = F.get("keys", F.lit(0)), F.element_at("keys", -1)
    looks = F.concat(
        F.transform("contexts", lambda c: F.struct(F.lit(0).alias("slot"), F.concat(F.lit("c:"), c).alias("name"))),
        F.array(F.struct(F.lit(1).alias("slot"), F.concat(F.lit("k:"), first).alias("name")), F.struct(F.lit(2).alias("slot"), F.concat(F.lit("k:"), last).alias("name"))),
    )
    row = [id_column, "text_key", "kind", "a", "z", "seed", "typed", "found_text"]
    rows = found.where("seed >= 0").withColumn("typed", F.size("keys") > 1).select(*row, F.explode(looks).alias("l")).select(*row, "l.slot", "l.name")
    best = lambda slot, name: F.coalesce(F.max(F.when(F.col("slot") == slot, F.col("score"))), F.lit(0.0)).alias(name)
    scored = (
        rows.withColumn("salt", _salt(id_column, "text_key", "a"))
        .join(scores, ["kind", "name", "salt"], "left")
        .groupBy(*row)
        .agg(best(0, "trust"), best(1, "b1"), best(2, "b2"))
    )
    both, one = F.least("b1", "b2"), F.greatest("b1", "b2")
    name = (F.col("seed") == 1) | (both >= 0.6) | ((F.col("trust") >= 0.4) & (one >= 0.6) & (both >= 0.25)) | ((F.col("trust") >= 0.6) & (both >= 0.4))
    mail = (F.col("seed") == 1) | (one >= MAIL_BELIEF) & (F.col("trust") > 0) | (F.col("trust") >= MAIL_TRUST)
    phone = (F.col("seed") == 1) | (F.col("trust") >= PHONE_TRUST) | (one >= PHONE_FORM[0]) & (F.col("trust") >= PHONE_FORM[1])
    number = (F.col("trust") >= NUMBER_TRUST) & (one >= NUMBER_BELIEF) | (F.col("seed") == 1) & (F.col("trust") >= NUMBER_SEED_TRUST)
    address = (F.col("seed") == 1) | (F.col("trust") >= ADDRESS_TRUST) | F.col("typed") & (F.col("b2") >= ADDRESS_TYPE) & (F.col("trust") > 0)
    good = F.when(F.col("kind") == "name", name).when(F.col("kind") == "email", mail).when(F.col("kind") == "phone", phone).when(F.col("kind") == "id_number", number).otherwise(address)
    kept = scored.where(good).withColumn("score", F.col("trust") + both + F.col("seed"))
    # Spans of one text, few and bounded by its length: sorted by quality, each that overlaps none kept so far stays.
    spans = (
        kept.groupBy(id_column, "text_key")
        .agg(F.collect_set(F.struct((-F.col("seed")).alias("s"), (-F.round("score", 6)).alias("q"), (F.col("a") - F.col("z")).alias("n"), "a", "z", "kind", "found_text")).alias("spans"))
        .withColumn("spans", F.array_sort("spans"))
    )
    empty = F.filter(F.col("spans"), lambda s: F.lit(False))
    chosen = F.aggregate("spans", empty, lambda acc, s: F.when(F.exists(acc, lambda t: (t["a"] < s["z"]) & (s["a"] < t["z"])), acc).otherwise(F.array_append(acc, s)))
    return spans.select(id_column, "text_key", F.explode(chosen).alias("s")).select(id_column, "text_key", "s.kind", "s.a", "s.z", "s.found_text")


def find_personal(messages: DataFrame, id_column: str, text_column: str, names: DataFrame, allowed: tuple[str, ...] = (), path: str = DICTIONARY_PATH, rounds: int = ROUNDS) -> DataFrame:
    """Personal information of every text: ``id_column, text_key, kind, a, z, found_text``.

    ``names``: the seed names ``person_name, kind`` (``given`` or ``family``), a fixed list that is
    collected. Kinds are ``email, phone, id_number, address, name``. ``a`` and ``z`` are character
    offsets. Nulls, empty and blank texts hold nothing; rows with a null id keep it; equal rows give
    one set of findings; empty tables give no rows; other columns are not read.
    """
    rows = names.where("person_name is not null").select(F.lower("kind").alias("kind"), F.lower(F.trim("person_name")).alias("n")).distinct().collect()
    given = frozenset(r["n"] for r in rows if r["kind"] == "given")
    family = frozenset(r["n"] for r in rows if r["kind"] == "family")
    found = Stage(occurrences(messages, id_column, text_column, given, family, frozenset(allowed), path), "personal-candidates").df
    return extract(found, id_column, rounds)


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact_personal(messages: DataFrame, id_column: str, text_column: str, found: DataFrame) -> DataFrame:
    """The table with every finding replaced by a typed placeholder, the rest of each text unchanged."""
    spans = found.groupBy(F.col(id_column).alias("__id"), F.col("text_key").alias("__text_key")).agg(F.array_sort(F.collect_list(F.struct("a", "z", "kind"))).alias("__spans"))
    base = messages.withColumn("__key", F.xxhash64(text_column))
    joined = base.join(spans, base[id_column].eqNullSafe(spans["__id"]) & (F.col("__key") == F.col("__text_key")), "left").select(*messages.columns, "__spans")
    at = messages.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [
                t if t is None or not s else splice(t, [(x["a"], x["z"], PLACEHOLDERS[x["kind"]]) for x in s])
                for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(work, messages.schema)
