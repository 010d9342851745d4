"""Words of a text without regard to case, punctuation, layout, markup and escapes."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD, _ASCII_WORD = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->")
_ESCAPED_CODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPED_SPACE = re.compile(r"\\+[nrtfv]")
_PERCENT = re.compile(r"%([0-7][0-9a-fA-F])")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n\s*(?=[^\W\d_])")
#: Characters that have no width: soft hyphen, zero-width spaces and joiners, byte order mark.
_NO_WIDTH = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


def plain(text: str) -> str:
    """Text with markup and escapes resolved, compatibility forms unified, lower case."""
    if "\\" in text:
        text = _ESCAPED_CODE.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = _ESCAPED_SPACE.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: chr(int(m.group(1), 16)), text)
    if "-" in text and "\n" in text:
        text = _HYPHENATED.sub("", text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _NO_WIDTH.sub("", text)
    return text.lower()


def words(text: str) -> list[str]:
    text = plain(text)
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)
