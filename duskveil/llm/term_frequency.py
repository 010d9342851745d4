"""Frequency of every distinct term: range-partitioned sort and run-length scanning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; the first is True."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows sorted by (field_name, term, record): a row for each run of a term.

    Only the last row's key is carried between batches; a run over several batches gives several
    rows, which the caller adds up.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fields, terms, records, times = (batch.column(i) for i in range(4))
        new_term = _changes(fields) | _changes(terms)
        new_record = new_term | _changes(records)
        first = (fields[0].as_py(), terms[0].as_py(), records[0].as_py())
        if last is not None and last == first:
            new_record[0] = False  # the record was counted at the end of the batch before
        last = (fields[-1].as_py(), terms[-1].as_py(), records[-1].as_py())
        starts = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [
                fields.take(pa.array(starts)),
                terms.take(pa.array(starts)),
                pa.array(np.add.reduceat(times.to_numpy(zero_copy_only=False).astype(np.int64), starts)),
                pa.array(np.add.reduceat(new_record.astype(np.int64), starts)),
            ],
            names=["field_name", "term", "n_occurrences", "n_records"],
        )


def term_frequency(pairs: DataFrame, n_records: int, rare_below: int = 3, common_share: tuple[int, int] = (1, 10)) -> DataFrame:
    """Occurrences and distinct records of every term, with a mark for the useless ones.

    ``pairs`` has ``field_name, term, record, times``: a term, the record that holds it, how often.
    Result ``field_name, term, n_occurrences, n_records, mark``; ``mark`` is ``rare`` below
    ``rare_below`` records, ``common`` above the given share of ``n_records``, else null.

    The pairs are range-partitioned by (term, record) and sorted (an external sort: it spills), then
    each task scans runs. Record is part of the range key, so a term in a third of all records is
    spread over many tasks; equal (term, record) pairs always meet in one task, so the partial
    counts of distinct records just add up in a last small aggregate.

    Nulls: pairs without term or record fall out. Repeated pairs add up. Empty input gives no rows.
    """
    some = pairs.where("term is not null and record is not null").select("field_name", "term", "record", F.col("times").cast("bigint").alias("times"))
    runs = (
        some.repartitionByRange("field_name", "term", "record")
        .sortWithinPartitions("field_name", "term", "record")
        .mapInArrow(_scan, "field_name string, term string, n_occurrences bigint, n_records bigint")
    )
    up, down = common_share
    return (
        runs.groupBy("field_name", "term")
        .agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
        .withColumn(
            "mark",
            F.when(F.col("n_records") < rare_below, F.lit("rare")).when(F.col("n_records") * down > F.lit(n_records).cast("bigint") * up, F.lit("common")),
        )
    )
