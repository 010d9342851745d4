"""Bodies to texts: JSON, multipart, plain."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PARTS, MAX_BOUNDARY = 4096, 256
#: Application types that hold text.
TEXT_TYPES = ("json", "xml", "x-www-form-urlencoded", "javascript", "yaml", "x-yaml")
_DECODED = "struct<kind:string,text:string,regions:array<struct<start:int,end:int,kind:string>>,binary_parts:int,failed:boolean>"


def _no_constant(name: str):
    raise ValueError(name)


def parse_json(data: bytes | str):
    """Strict JSON; a ``ValueError`` where it is none."""
    return json.loads(data.decode("utf-8") if isinstance(data, (bytes, bytearray)) else data, parse_constant=_no_constant)


def json_leaves(value) -> list[str]:
    """All string values in the order of a walk, keys sorted."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            stack.extend(x[k] for k in sorted(x, reverse=True))
    return out


def json_flat(value) -> str:
    """String values joined by one space; empty ones fall out, numbers and keys are not text."""
    return " ".join(x for x in json_leaves(value) if x)


def json_escape(text: str) -> str:
    """The inside of a JSON string."""
    return json.dumps(text, ensure_ascii=False)[1:-1]


def boundary_of(content_type: Column) -> Column:
    """Boundary of a multipart content type, at most 256 bytes; null if there is none."""
    found = F.regexp_extract(content_type, r"(?i)\A\s*multipart/[^;]*;(?:.*;)?\s*boundary=(?:\"([^\"]*)\"|([^;\s\"]+))", 1)
    bare = F.regexp_extract(content_type, r"(?i)\A\s*multipart/[^;]*;(?:.*;)?\s*boundary=(?:\"([^\"]*)\"|([^;\s\"]+))", 2)
    value = F.trim(F.concat(found, bare))
    return F.when((value != "") & (F.octet_length(value) <= MAX_BOUNDARY), value)


def textual_part(content_type: str | None) -> bool:
    """No type, ``text/*`` and some application types are text."""
    if content_type is None or not content_type.strip():
        return True
    kind = content_type.split(";")[0].strip().lower()
    return kind.startswith("text/") or kind.startswith("application/") and kind[12:] in TEXT_TYPES


def _delimiters(body: bytes, mark: bytes) -> Iterator[tuple[int, int, bool]]:
    """Start, end and closing of each valid delimiter line: at a line's start, then padding and a line end or ``--``."""
    at = body.find(mark)
    while at >= 0:
        z = at + len(mark)
        if at == 0 or body[at - 1 : at] == b"\n":
            closing = body[z : z + 2] == b"--"
            rest = body[z + 2 * closing :].lstrip(b" \t")
            if rest[:1] == b"\n" or rest[:2] == b"\r\n" or closing and (not rest or rest[:1] == b"\r"):
                yield at, z, closing
        at = body.find(mark, at + 1)


def _line_end(body: bytes, at: int) -> int:
    return at + 2 if body[at : at + 2] == b"\r\n" else at + 1 if body[at : at + 1] == b"\n" else at


def _before_line_end(body: bytes, at: int) -> int:
    return at - 2 if body[:at].endswith(b"\r\n") else at - 1 if body[:at].endswith(b"\n") else at


def multipart_regions(body: bytes, boundary: str) -> tuple[list[tuple[int, int, str]], int] | None:
    """Text regions of a multipart body and how many binary parts were passed over.

    None if the structure does not hold or there are more than MAX_PARTS parts. A body that ends
    early has its last payload reach to the end.
    """
    marks = list(_delimiters(body, b"--" + boundary.encode()))
    if not marks:
        return None
    regions: list[tuple[int, int, str]] = []
    binary = parts = 0
    head = _before_line_end(body, marks[0][0])
    if head > 0:
        regions.append((0, head, "preamble"))
    for i, (_, end, closing) in enumerate(marks):
        at = end
        while body[at : at + 1] in (b" ", b"\t"):
            at += 1
        if closing:
            after = _line_end(body, at + 2 if body[at : at + 2] == b"--" else at)
            if after < len(body):
                regions.append((after, len(body), "epilogue"))
            break
        start = _line_end(body, at)
        stop = _before_line_end(body, marks[i + 1][0]) if i + 1 < len(marks) else len(body)
        stop = max(stop, start)
        parts += 1
        if parts > MAX_PARTS:
            return None
        part = body[start:stop]
        gaps = [(p, n) for p, n in ((part.find(b"\r\n\r\n"), 4), (part.find(b"\n\n"), 2)) if p >= 0]
        payload, kind = start, None
        if gaps:
            p, n = min(gaps)
            if p:
                regions.append((start, start + p, "part_headers"))
            payload = start + p + n
            for line in part[:p].split(b"\n"):
                if line[:13].lower() == b"content-type:" and len(line.rstrip(b"\r")) > 13:
                    kind = line[13:].rstrip(b"\r").decode("latin-1")
                    break
        if stop > payload:
            if textual_part(kind):
                regions.append((payload, stop, "payload"))
            else:
                binary += 1
    return (regions, binary) if parts else None


def decode_body(body: bytes, content_type: str | None, boundary: str | None) -> dict:
    """JSON if it parses whatever the type says, else multipart if it holds, else text; ``failed`` marks a JSON type without JSON."""
    try:
        return {"kind": "json", "text": json_flat(parse_json(body)), "regions": [], "binary_parts": 0, "failed": False}
    except (ValueError, RecursionError):
        pass
    failed = "json" in (content_type or "").lower()
    if boundary:
        found = multipart_regions(body, boundary)
        if found:
            regions, binary = found
            text = "\n".join(body[a:z].decode("utf-8", "replace") for a, z, _ in regions)
            return {"kind": "multipart", "text": text, "regions": [{"start": a, "end": z, "kind": k} for a, z, k in regions], "binary_parts": binary, "failed": failed}
    return {"kind": "text", "text": body.decode("utf-8", "replace"), "regions": [], "binary_parts": 0, "failed": failed}


def decode(df: DataFrame, body: str, content_type: str) -> DataFrame:
    """Adds ``decoded`` (kind, text, regions, binary_parts, failed). A null body stays null."""

    @F.pandas_udf(_DECODED)
    def work(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, types, boundaries in parts:
            none = {"kind": None, "text": None, "regions": None, "binary_parts": None, "failed": None}
            yield pd.DataFrame([none if b is None else decode_body(bytes(b), t, x) for b, t, x in zip(bodies, types, boundaries, strict=True)])

    return df.withColumn("decoded", work(F.col(body).cast("binary"), F.col(content_type), boundary_of(F.col(content_type))))


def leaves(df: DataFrame, ids: list[str], body: str) -> DataFrame:
    """One row ``ids, leaf_idx, leaf`` for each string value of a JSON body; other bodies give none."""

    @F.pandas_udf("array<string>")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in parts:
            out = []
            for b in bodies:
                try:
                    out.append([] if b is None else json_leaves(parse_json(b)))
                except (ValueError, RecursionError):
                    out.append([])
            yield pd.Series(out)

    return df.select(*ids, F.posexplode(work(F.col(body))).alias("leaf_idx", "leaf"))


def adapted_text(body: Column) -> Column:
    """Text of the known request forms: every ``messages[].content`` that is a string, then ``prompt`` if it is one, joined by a blank; null where there is none.

    Types are looked at in the parsed body: a content that only looks like a list is a string, parts and numbers are none.
    """
    tree = F.try_parse_json(body)

    def string_of(value: Column, path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))

    messages = F.coalesce(F.try_variant_get(tree, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(F.concat(F.transform(messages, lambda m: string_of(m, "$.content")), F.array(string_of(tree, "$.prompt"))), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, " "))
