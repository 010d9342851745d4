"""Words of public tokenizer vocabularies. They are read on the driver and travel with the plan, so executors need no files."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Vocabulary files of public tokenizers: English and code, and many languages.
DICTIONARY_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTILINGUAL_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def spaced_words(path: str) -> dict[str, int]:
    """Words that the vocabulary holds with the blank before them, in lower case, and their ranks."""
    out: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.partition(b" ")
            raw = base64.b64decode(token)
            if raw[:1] == b" " and len(raw) > 2:
                try:
                    word = raw[1:].decode().lower()
                except UnicodeDecodeError:
                    continue
                if word.isalpha():
                    out.setdefault(word, int(rank))
    return out
