"""Items that appear together: pair counts, lift and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def distinct_items(items: Column, clean) -> Column:
    """Cleaned, distinct, sorted items of a basket; nulls and empties fall out."""
    cleaned = F.filter(F.transform(items, clean), lambda x: x.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(cleaned)), F.array().cast("array<string>"))


def cooccurrence(baskets: DataFrame, items: str, min_count: int = 1) -> DataFrame:
    """Counts of every unordered pair of items over baskets, against independence.

    ``baskets`` holds one row for each basket with an array of distinct, sorted items. Result:
    ``item_a < item_b, n_ab, n_a, n_b, n_baskets, lift, pmi`` (lift = n_ab * N / (n_a * n_b),
    pmi = ln lift), pairs with ``n_ab >= min_count``.

    Baskets emit ordered pairs lazily (two generators, no array of pairs); equal baskets are counted
    together before that, and pair counts are combined map-side. The marginals ride along as the
    pairs (a, a) and N as the pair (null, null), so one aggregate yields all three and the text of
    the baskets is read once.

    Nulls: a null array is an empty basket; it counts for N only. Items alone in their basket have
    marginals but no pair. An empty table gives no rows.
    """
    equal = baskets.groupBy(F.coalesce(F.col(items), F.array().cast("array<string>")).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    first = equal.select(F.posexplode_outer("b").alias("i", "item_a"), "b", "w")
    # From each item on: itself (the marginal), then the later ones. The total counts once a basket.
    pairs = first.select("item_a", F.explode(F.expr("slice(b, i + 1, size(b))")).alias("item_b"), "w")
    totals = equal.select(F.lit(None).cast("string").alias("item_a"), F.lit(None).cast("string").alias("item_b"), "w")
    counted = checkpointed(pairs.unionByName(totals).groupBy("item_a", "item_b").agg(F.sum("w").alias("n")))
    total = counted.where("item_a is null").first()
    n = total["n"] if total else 0
    single = counted.where("item_a = item_b")
    return (
        counted.where((F.col("item_a") < F.col("item_b")) & (F.col("n") >= min_count))
        .withColumnRenamed("n", "n_ab")
        .join(single.select("item_a", F.col("n").alias("n_a")), "item_a")
        .join(single.select("item_b", F.col("n").alias("n_b")), "item_b")
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n_baskets"))
        .withColumn("lift", F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b")))
        .withColumn("pmi", F.log("lift"))
    )
