"""Precision and recall against labelled spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_start(text: Column, value: Column, k: Column) -> Column:
    """Byte offset of the k-th occurrence (from 1) of a literal value; null if there are fewer."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    start = F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda acc, p: acc + F.octet_length(p)) + (k - 1) * F.octet_length(value)
    return F.when((F.length(value) > 0) & (F.size(pieces) > k), start)


def expected_spans(texts: DataFrame, expected: DataFrame, case: str, text: str) -> DataFrame:
    """Expected values as spans: the k-th expectation of one (case, flag, value) is its k-th occurrence."""
    order = Window.partitionBy(case, "flag", "value").orderBy("idx")
    numbered = expected.withColumn("k", F.row_number().over(order))
    joined = numbered.join(texts, case)
    start = occurrence_start(F.col(text), F.col("value"), F.col("k"))
    return joined.select(case, "flag", start.alias("start"), (start + F.octet_length("value")).alias("end"))


def matches(expected: DataFrame, found: DataFrame, case: str) -> DataFrame:
    """Each expected span meets at most one finding of its flag and span: ``flag, tp, fp, fn`` rows to add up."""
    keys = [case, "flag", "start", "end"]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = counted(expected, "e").join(counted(found, "f"), keys, "full_outer").fillna(0, ["e", "f"])
    tp = F.least("e", "f")
    return both.select("flag", tp.alias("tp"), (F.col("f") - tp).alias("fp"), (F.col("e") - tp).alias("fn"))


def precision_recall(matched: DataFrame, by: str) -> DataFrame:
    """Sums and rates by flag or category; a rate without denominator is null."""
    return (
        matched.groupBy(by)
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    )
