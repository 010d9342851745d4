"""Mixing of sources to target weights: pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stage

#: Where the vocabulary of the public tokenizer lies; the setting ``duskveil.tokenizer.path`` overrides it.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer splits text before merging.
TOKENIZER_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
FAN_IN = 64
_EPS = 1e-9


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's bytes, made once for each worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_column: str, source: Column, path: str = TOKENIZER_PATH) -> DataFrame:
    """``id_column, source, n_tokens`` of every document, whole texts; a null text has 0 tokens.

    The vocabulary is read on the driver and travels with the plan (1 MB, whatever the documents).
    """
    rows = documents.select(F.col(id_column), source.alias("source"), F.col("text"))
    kind = dict(rows.dtypes)[id_column]

    with open(path, "rb") as f:
        vocabulary = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[id_column, "source", "n_tokens"])

    return rows.mapInArrow(count, f"{id_column} {kind}, source string, n_tokens bigint")


def pivotal(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sequential pivotal rounding of probabilities; all come out 0 or 1 but at most one.

    Two open units compete: mass moves from one to the other with the probabilities that keep both
    expectations, until one of them is integral; the other meets the next unit. ``u`` holds a uniform
    number for each unit.
    """
    p = p.tolist()
    open_at = -1
    for i, x in enumerate(p):
        if x <= _EPS or x >= 1 - _EPS:
            p[i] = float(round(x))
            continue
        if open_at < 0:
            open_at = i
            continue
        j, y = open_at, p[open_at]
        s = x + y
        if s < 1:
            keep_i = u[i] * s < x
            p[i], p[j] = (s, 0.0) if keep_i else (0.0, s)
            open_at = i if keep_i else j
        else:
            full_i = u[i] * (2 - s) < 1 - y
            p[i], p[j] = (1.0, s - 1) if full_i else (s - 1, 1.0)
            open_at = j if full_i else i
        if p[open_at] <= _EPS or p[open_at] >= 1 - _EPS:
            p[open_at] = float(round(p[open_at]))
            open_at = -1
    return np.array(p)


def mix(tokens: DataFrame, targets: DataFrame, id_column: str, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Copies of every document and the shares reached.

    ``tokens``: ``id_column, source, n_tokens``; ``targets``: ``source, target_share, max_repeats``
    (cleaned, one row a source; a list of sources, collected). T is the tokens of all documents of
    target sources, each once. A source needs ``target_share * T`` tokens, that is
    ``x = min(need / tokens, max_repeats)`` copies of each document: floor(x) for all and one more
    with probability x - floor(x).

    The probabilities are rounded by the pivotal method. Documents are range-partitioned by (source,
    size), so neighbours that exchange mass are of like size and the token sum is kept as well as the
    number; a large source spreads over many tasks. Each task leaves at most one open document a
    source; these few residuals are rounded on in a tree of groups of FAN_IN, the last one by chance.

    Returns ``(copies, report)``: ``id_column, source, n_tokens, copies`` for all documents of target
    sources, and per source ``source, target_share, max_repeats, n_docs, source_tokens,
    capacity_tokens, target_tokens, mixed_tokens, actual_share, reachable``.

    Nulls: documents without source are in no source; null sizes count 0; null shares count 0, null
    repeats 1. A source without documents keeps its report row. With no tokens at all nothing is
    copied. Random numbers hang on the document's id and the seed, so repeated runs agree.
    """
    spark = tokens.sparkSession
    wanted = {
        r["source"]: (float(r["target_share"] or 0.0), int(r["max_repeats"] if r["max_repeats"] is not None else 1))
        for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()
    }
    kept = Stage(tokens.where(F.col("source").isin(list(wanted))).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("bigint")), "mix-tokens").df
    sizes = {r["source"]: (r["n"], r["t"]) for r in kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    total = sum(t for _, t in sizes.values())
    copies_of = {s: min(share * total / sizes[s][1], repeats) if sizes.get(s, (0, 0))[1] else 0.0 for s, (share, repeats) in wanted.items()}
    rate = F.create_map(*[x for s, c in copies_of.items() for x in (F.lit(s), F.lit(float(c)))])[F.col("source")] if wanted else F.lit(0.0)
    units = kept.select(
        id_column, "source", "n_tokens", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"),
        (F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("u"),
    )
    kind = dict(units.dtypes)[id_column]
    fields = f"{id_column} {kind}, source string, n_tokens bigint, base int, p double, u double, node bigint"

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, carried = TaskContext.get().partitionId(), None
        for batch in batches:
            frame = batch.assign(node=node)
            if carried is not None:
                frame = pd.concat([carried, frame], ignore_index=True)
                carried = None
            p, source = frame["p"].to_numpy(float), frame["source"].to_numpy(object)
            for s in dict.fromkeys(source):
                some = np.flatnonzero(source == s)
                p[some] = pivotal(p[some], frame["u"].to_numpy()[some])
            frame["p"] = p
            # The one document of the last source that is still open competes in the next batch.
            is_open = (p > 0) & (p < 1) & (source == source[-1]) if len(frame) else np.zeros(0, bool)
            if is_open.any():
                carried = frame[is_open]
                frame = frame[~is_open]
            yield frame
        if carried is not None:
            yield carried

    # Rounding is settled once, in a table: later reads agree whatever task is run again.
    settled = Stage(units.repartitionByRange("source", "n_tokens", F.xxhash64(F.col(id_column))).sortWithinPartitions("source", "n_tokens", id_column).mapInPandas(leaf, fields), "mix-leaves").df
    done = settled.where("p = 0 or p = 1")
    residual = settled.where("p > 0 and p < 1")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", id_column], kind="stable").reset_index(drop=True)
        frame["p"] = pivotal(frame["p"].to_numpy(float), frame["u"].to_numpy())
        return frame

    nodes = (residual.agg(F.max("node").alias("m")).first()["m"] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        met = residual.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("bigint")).groupBy("source", "node").applyInPandas(meet, fields)
        stage = Stage(met.withColumn("u", F.pmod(F.xxhash64(F.col(id_column), F.lit(seed), F.lit(nodes)), F.lit(1 << 52)) / float(1 << 52)), "mix-tree").df
        done = done.unionByName(stage.where("p = 0 or p = 1"))
        residual = stage.where("p > 0 and p < 1")
    last = residual.withColumn("p", F.when(F.col("u") < F.col("p"), 1.0).otherwise(0.0))
    copies = done.unionByName(last).select(id_column, "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies"))
    mixed = {r["source"]: r["t"] for r in copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    whole = sum(mixed.values())
    rows = []
    for s, (share, repeats) in sorted(wanted.items()):
        n, t = sizes.get(s, (0, 0))
        rows.append((s, share, repeats, n, t, t * repeats, share * total, mixed.get(s, 0), mixed.get(s, 0) / whole if whole else 0.0, t * repeats >= share * total))
    report = spark.createDataFrame(
        rows,
        "source string, target_share double, max_repeats int, n_docs bigint, source_tokens bigint, capacity_tokens bigint, target_tokens double, mixed_tokens bigint, actual_share double, reachable boolean",
    )
    return copies, report
