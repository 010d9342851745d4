"""Helpers for operators that find spans in texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def spans_to_rows(batch: pa.RecordBatch, spans: Callable[[str], list[tuple[int, int]]], id_column: str) -> pa.RecordBatch:
    """Rows (id, found text) of a batch (id, text); each text once a row."""
    rows, found = [], []
    for i, text in enumerate(batch.column(1).to_pylist()):
        if not text:
            continue
        for part in dict.fromkeys(text[a:z] for a, z in spans(text)):
            rows.append(i)
            found.append(part)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows, np.int64))), pa.array(found, pa.string())], names=[id_column, "found_text"])


def splice(text: str, parts: list[tuple[int, int, str]]) -> str:
    """Text with spans (in order, disjoint) replaced."""
    out, at = [], 0
    for a, z, new in parts:
        out += [text[at:a], new]
        at = z
    out.append(text[at:])
    return "".join(out)
