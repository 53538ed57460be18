"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import drop_path, staged, staging_dir


def _print_of(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set, to tell whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)


def stars(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs, u != v: one row (u, v) for each node u that is not the smallest of its component, v.

    Each round joins edges with one minimum per node, so a hub costs its number of edges.
    Rounds are staged in the shared folder; their number grows with the logarithm of the
    longest chain.
    """
    spark = edges.sparkSession
    path = staging_dir(spark)
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    before = _print_of(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, staging_dir(spark)
        now = staged(small, path)
        drop_path(spark, old)
        after = _print_of(now)
        if after == before:
            break
        before = after
    return now
