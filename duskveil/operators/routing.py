"""Requests to upstreams and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import provider_of_path, url_host


def route(requests: DataFrame, path: str, upstreams: DataFrame) -> DataFrame:
    """Adds ``upstream``: that of the longest prefix of the path (ties by name), else the built-in provider if there is an upstream of that name, else ``default`` if there is such an upstream, else ``unknown``.

    The upstreams are a configuration, a small list: the lengths of their prefixes and their names are
    collected. Each distinct path is cut at these lengths and looked up by an equi-join, not compared
    with all prefixes. A null path has no prefix and no built-in provider.
    """
    rows = upstreams.select("name", F.length("path_prefix").alias("n")).distinct().collect()
    lengths, names = sorted({r["n"] for r in rows if r["n"]}), sorted({r["name"] for r in rows if r["name"] is not None})
    known = upstreams.where(F.length("path_prefix") > 0).groupBy("path_prefix").agg(F.min("name").alias("name"))
    paths = requests.select(F.col(path).alias("__p")).where("__p is not null").distinct()
    tries = paths.select("__p", F.explode(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.col("n") <= F.length("__p"))
    best = (
        tries.withColumn("path_prefix", F.col("__p").substr(F.lit(1), F.col("n")))
        .join(known, "path_prefix")
        .groupBy("__p")
        .agg(F.max_by("name", F.col("n")).alias("__best"))
    )
    builtin = provider_of_path(F.col(path))
    rest = F.when(builtin.isin(names), builtin).otherwise(F.lit("default" if "default" in names else "unknown"))
    return requests.join(best, requests[path] == best["__p"], "left").withColumn("upstream", F.coalesce("__best", rest)).drop("__p", "__best")


def route_host(requests: DataFrame, host: str, upstreams: DataFrame) -> DataFrame:
    """Adds ``upstream`` for a connection's host: an upstream of that name, else the first by name with that URL host, else the host itself."""
    names = upstreams.select(F.col("name").alias("__n"), F.lower("name").alias("__k")).groupBy("__k").agg(F.min("__n").alias("__by_name"))
    hosts = upstreams.select(url_host(F.col("url")).alias("__h"), "name").where("__h is not null").groupBy("__h").agg(F.min("name").alias("__by_host"))
    key = F.lower(F.col(host))
    return (
        requests.withColumn("__q", key)
        .join(names, F.col("__q") == F.col("__k"), "left")
        .join(hosts, F.col("__q") == F.col("__h"), "left")
        .withColumn("upstream", F.coalesce("__by_name", "__by_host", host))
        .drop("__q", "__k", "__h", "__by_name", "__by_host")
    )


def with_mode(requests: DataFrame, upstreams: DataFrame, default: str = "enforce") -> DataFrame:
    """Adds ``mode`` of the request's ``upstream``, else the global one."""
    modes = upstreams.where("mode is not null").groupBy(F.col("name").alias("upstream")).agg(F.min(F.lower("mode")).alias("__m"))
    return requests.join(modes, "upstream", "left").withColumn("mode", F.coalesce("__m", F.lit(default))).drop("__m")
