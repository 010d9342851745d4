"""Evaluation texts leaking into training text: latent semantic retrieval with an exact word check.

Method. Items and documents are cut into overlapping passages of words; a passage is its TF-IDF
vector over word pairs that occur in the items. A distributed randomised SVD gives a latent space;
passages of documents are compared with passages of items by cosine there, and nothing else makes a
candidate. Candidates go through a longest-common-subsequence filter and then the exact check for at
least ``min_words`` consecutive words of the item of which at most one in ten is replaced.

Every text is cut into words once; what the later steps read are the codes of the documents that can
hold a leak at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from .words import words

PASSAGE, DOC_STEP, ITEM_STEP = 28, 4, 4
#: Least cosine of a candidate. A leak of 28 words shares at least 24 words in a row with the nearest
#: passages; with two of them replaced 19 of 27 word pairs still agree, a cosine of about 0.7. In the latent
#: space it strays by about one over the root of RANK, so three times that is left.
LEAST_COSINE = 0.5
#: Item word pairs that the best passage of a leak of 28 words or more keeps at least: the worst is 40
#: words with four replaced, a passage inside of them that has all four loses eight of its 27 pairs.
LEAST_PAIRS = 19
#: Rows of a batch that are made into arrays at a time: bounds a worker's memory.
ROWS_AT_ONCE = 512
RANK, OVERSAMPLE = 192, 16
#: The latent space is fitted on the items and at most so many documents, chosen by the hash of their id: nine tenths of it are
#: expected, so that it is exceeded with a chance below one in a million. Every document is searched.
FIT_DOCUMENTS = 4000
ITEM_BLOCK = 2000


class Items:
    """Item texts as word ids, their word pairs as features, their passages. Bounded by ITEM_BLOCK items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        texts = [(i, words(t)) for i, t in rows if t]
        self.vocabulary: dict[str, int] = {}
        for _, ws in texts:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.ids = [i for i, _ in texts]
        self.coded = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in texts]
        self.base = len(self.vocabulary) + 1
        pairs = [c[:-1] * self.base + c[1:] for c in self.coded if len(c) > 1]
        self.features = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def feature_of(self, coded: np.ndarray) -> np.ndarray:
        """Feature of each pair of neighbours, -1 where it is none; unknown words are coded -1."""
        if len(coded) < 2 or not len(self.features):
            return np.full(max(0, len(coded) - 1), -1)
        code = coded[:-1] * self.base + coded[1:]
        code[(coded[:-1] < 0) | (coded[1:] < 0)] = -1
        at = np.minimum(np.searchsorted(self.features, code), len(self.features) - 1)
        return np.where(self.features[at] == code, at, -1)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts one after the other, and where each text starts (one more at the end)."""
        get, flat, starts = self.vocabulary.get, [], [0]
        for text in texts:
            if text:
                flat += [get(w, -1) for w in words(text)]
            starts.append(len(flat))
        return np.array(flat, np.int64), np.array(starts, np.int64)


def _passages(starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and end word of each passage; a short text is one passage."""
    n = np.diff(starts)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - PASSAGE) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = starts[:-1][text] + k * step
    return text, first, np.minimum(first + PASSAGE, starts[1:][text])


def least_pairs(min_words: int) -> int:
    """Item word pairs in the best passage of any leak. It depends on lengths only, not on the documents' number
    or on how many hold a pair: each replaced word takes two pairs."""
    return max(1, min(LEAST_PAIRS, *(n - 1 - 2 * (n // 10) for n in range(min_words, 2 * min_words + 1))))


def bounded_weights(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency between 1 (in every document) and 2 (in none), however many documents there are."""
    return 1 + np.log((1 + n_docs) / (1.0 + counts)) / max(np.log(1 + n_docs), 1e-9)


def _vectors(feature: np.ndarray, first: np.ndarray, end: np.ndarray, weight: np.ndarray, most: float, least: int):
    """Rows (passage, feature, value) of passages with at least ``least`` pairs of the items."""
    hit = feature >= 0
    square = np.where(hit, weight[np.maximum(feature, 0)] ** 2, 0.0)
    inside = np.concatenate([[0.0], np.cumsum(square)])
    hits = np.concatenate([[0], np.cumsum(hit)])
    last = np.maximum(end - 1, first)
    own, n_hits = inside[last] - inside[first], hits[last] - hits[first]
    total = own + (last - first - n_hits) * most**2
    keep = np.flatnonzero(n_hits >= least)
    where = np.flatnonzero(hit)
    lo, n = hits[first[keep]], n_hits[keep]
    row = np.repeat(np.arange(len(keep)), n)
    at = where[np.repeat(lo, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
    return keep, row, feature[at], weight[feature[at]], np.sqrt(np.maximum(total[keep], 1e-9))


def _project(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times ``basis``. Every row has an entry; rows come in order."""
    if not n:
        return np.zeros((0, basis.shape[1]), np.float32)
    out = np.empty((n, basis.shape[1]), np.float32)
    begins = np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), [len(row)]])
    for a in range(0, n, 512):
        z = min(n, a + 512)
        some = slice(begins[a], begins[z])
        out[a:z] = np.add.reduceat(basis[column[some]] * value[some, None], begins[a:z] - begins[a], axis=0)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def _clusters(passages: list[int], first: np.ndarray, end: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Stretches of words around the passages; stretches that overlap are one."""
    out: list[tuple[int, int]] = []
    for p in passages:
        a, z = int(first[p]) - reach, int(end[p]) + reach
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        if x >= 0:
            at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = at.get(y, 0) & row
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def holds(doc: np.ndarray, item: np.ndarray, min_words: int) -> bool:
    """Exact check: some ``min_words`` or more consecutive words of the item stand in the document
    with at most one in ten replaced.

    A window of twice the least length can be halved without losing the property, so lengths below
    that suffice.
    """
    n, m = len(doc), len(item)
    if n < min_words or m < min_words:
        return False
    same = doc[:, None] == item[None, :]
    at_doc, at_item = np.nonzero(same)
    votes = np.bincount(at_item - at_doc + n, minlength=1)
    for shift in (np.flatnonzero(votes * 10 >= min_words * 9 - 9) - n).tolist():
        line = np.diagonal(same, shift)
        wrong = np.concatenate([[0], np.cumsum(~line)])
        for size in range(min_words, min(2 * min_words, len(line) + 1)):
            if ((wrong[size:] - wrong[:-size]) * 10 <= size).any():
                return True
    return False


def _coded(documents: DataFrame, id_column: str, items: Items, least: int) -> Stage:
    """The one pass over the texts: ``__id, codes, feature, n``.

    Rows with ``codes`` are documents with a passage that has ``least`` pairs of the items, as every document with a leak
    has; the others count in how many documents of a task each feature occurs, over all documents, and, as feature -1, the documents.
    """
    kind = dict(documents.dtypes)[id_column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(max(1, len(items.features)), np.int64), 0
        id_type = None
        for batch in _slices(batches):
            id_type = batch.schema.field(0).type
            coded, starts = items.encode(batch.column(1).to_pylist())
            feature = items.feature_of(coded)
            at = np.flatnonzero(feature >= 0)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + 1 < starts[doc + 1]
            both = np.unique(doc[inside] * len(total) + feature[at[inside]])
            total += np.bincount(both % len(total), minlength=len(total))
            n += batch.num_rows
            text, first, end = _passages(starts, DOC_STEP)
            hits = np.concatenate([[0], np.cumsum(feature >= 0)])
            some = np.unique(text[hits[np.maximum(end - 1, first)] - hits[first] >= least])
            codes = [coded[starts[i] : starts[i + 1]].astype(np.int32).tobytes() for i in some.tolist()]
            none = pa.nulls(len(codes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(codes, pa.binary()), none, none], names=["__id", "codes", "feature", "n"])
        if n:
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(held) + 1, id_type), pa.nulls(len(held) + 1, pa.binary()), pa.array(np.append(held, -1)), pa.array(np.append(total[held], n))], names=["__id", "codes", "feature", "n"]
            )

    return Stage(documents.select(id_column, "text").mapInArrow(work, f"__id {kind}, codes binary, feature bigint, n bigint"), "leak-codes")


def _feature_counts(coded: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents."""
    rows = coded.where("feature is not null").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros(len(items.features), np.int64), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            counts[r["feature"]] = r["n"]
    return counts, n


def _codes(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all documents one after the other, and where each starts (one more at the end)."""
    parts = [np.frombuffer(c, np.int32) for c in batch.column(column).to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64), starts


def _latent_basis(sample: DataFrame, items: Items, weight: np.ndarray, most: float, least: int) -> np.ndarray:
    """Randomised SVD of the TF-IDF passages: a basis (features x rank) of the latent space.

    One step of the power method: every task multiplies its passages' rows A into A^T (A G) for a
    random G and the parts are added by feature block; the driver orthogonalises a matrix whose size
    depends on the items only.
    """
    k = min(RANK + OVERSAMPLE, len(items.features))
    start = np.random.default_rng(7).standard_normal((len(items.features), k)).astype(np.float32)
    block = 2048

    def part(keep, row, column, value, length) -> np.ndarray:
        value = (value / length[row]).astype(np.float32)
        made = _project(row, column, value, len(keep), start)
        out = np.zeros_like(start)
        order = np.argsort(column, kind="stable")
        # A part at a time bounds the memory; equal features of a part are summed before they are added.
        for a in range(0, len(order), 1 << 14):
            some = order[a : a + (1 << 14)]
            begins = np.flatnonzero(np.diff(column[some], prepend=-1))
            out[column[some][begins]] += np.add.reduceat(made[row[some]] * value[some, None], begins, axis=0)
        return out

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(start)
        for batch in _slices(batches):
            coded, starts = _codes(batch, 0)
            _, first, end = _passages(starts, DOC_STEP)
            total += part(*_vectors(items.feature_of(coded), first, end, weight, most, least))
        numbers = range(0, len(total), block)
        yield pa.RecordBatch.from_arrays([pa.array([a // block for a in numbers], pa.int32()), pa.array([total[a : a + block].tobytes() for a in numbers], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        total = np.sum([np.frombuffer(p, np.float32) for p in parts], axis=0, dtype=np.float32)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, part binary"
    rows = sample.select("codes").mapInArrow(multiply, kind).groupBy("block").applyInArrow(add, kind).collect()
    product = np.zeros_like(start)
    for r in rows:
        some = np.frombuffer(r["part"], np.float32).reshape(-1, k)
        product[r["block"] * block : r["block"] * block + len(some)] += some
    coded, starts, _ = _item_words(items)
    _, first, end = _passages(starts, ITEM_STEP)
    product += part(*_vectors(items.feature_of(coded), first, end, weight, most, 1))
    basis, _ = np.linalg.qr(product)
    return np.ascontiguousarray(basis[:, :RANK], dtype=np.float32)


def _item_words(items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(c) for c in items.coded])]).astype(np.int64)
    coded = np.concatenate(items.coded) if items.coded else np.zeros(0, np.int64)
    return coded, starts, np.arange(len(items.coded))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _search(documents: DataFrame, id_column: str, kind: str, items: Items, weight: np.ndarray, most: float, basis: np.ndarray, min_words: int, exact: bool) -> DataFrame:
    coded, starts, _ = _item_words(items)
    text, first, end = _passages(starts, ITEM_STEP)
    keep, row, column, value, _ = _vectors(items.feature_of(coded), first, end, weight, most, 1)
    latent, item_of = _unit(_project(row, column, value.astype(np.float32), len(keep), basis)), text[keep]
    ids, least = np.array(items.ids, object), least_pairs(min_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            coded, starts = _codes(batch, 1)
            text, first, end = _passages(starts, DOC_STEP)
            keep, row, column, value, _ = _vectors(items.feature_of(coded), first, end, weight, most, least)
            made = _unit(_project(row, column, value.astype(np.float32), len(keep), basis))
            found: dict[tuple[int, int], list[int]] = {}
            for a in range(0, len(keep), 1024):
                near, which = np.nonzero(made[a : a + 1024] @ latent.T >= LEAST_COSINE)
                for p, i in zip(keep[near + a].tolist(), item_of[which].tolist(), strict=True):
                    found.setdefault((int(text[p]), i), []).append(p)
            out_doc, out_item = [], []
            for (doc, i), passages in found.items():
                item = items.coded[i]
                if not exact:
                    out_doc.append(doc)
                    out_item.append(i)
                    continue
                for p, q in _clusters(sorted(set(passages)), first, end, 2 * min_words):
                    region = coded[max(starts[doc], p) : min(starts[doc + 1], q)]
                    if _common(item, region) * 10 >= min_words * 9 - 9 and holds(region, item, min_words):
                        out_doc.append(doc)
                        out_item.append(i)
                        break
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out_doc, pa.int64())), pa.array([ids[i] for i in out_item], pa.int64())], names=[id_column, "item_id"]
            )

    return documents.select("__id", "codes").mapInArrow(search, f"{id_column} {kind}, item_id bigint")


def leaked_items(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", min_words: int = 28, exact: bool = True) -> DataFrame:
    """Pairs ``(id_column, item_id)`` of documents and the evaluation items they hold.

    The items are the query set; they are taken in blocks of ITEM_BLOCK by id, each block against all
    documents. Whole texts are searched; counts are over all documents. No shuffle carries text.
    ``exact=False`` gives the candidates of the latent search (to measure its recall).

    Nulls: null or blank texts and items without ``min_words`` words match nothing, rows with null
    ids are kept with their null id. Repeated rows give repeated pairs, once per row. Empty tables
    give no rows.
    """
    spark = documents.sparkSession
    n_items, out = items.count(), None
    for a in range(0, max(1, n_items), ITEM_BLOCK):
        some = items.select("item_id", "text").orderBy("item_id").offset(a).limit(ITEM_BLOCK).collect()
        block = Items([(r["item_id"], r["text"]) for r in some])
        if not len(block.features):
            continue
        coded = _coded(documents, id_column, block, least_pairs(min_words)).df
        counts, n_docs = _feature_counts(coded, block)
        weight, most = bounded_weights(counts, n_docs), 2.0
        texts = coded.where("codes is not null")
        n_texts = max(1, texts.count())
        share = F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < F.lit(int(min(1.0, 0.9 * FIT_DOCUMENTS / n_texts) * (1 << 40)))
        basis = _latent_basis(texts.where(share), block, weight, most, least_pairs(min_words))
        found = _search(texts, id_column, dict(documents.dtypes)[id_column], block, weight, most, basis, min_words, exact)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{id_column} {dict(documents.dtypes)[id_column]}, item_id bigint")
    return out
