"""Digests of ordered lists of any length.

A list is cut into runs of FAN items by place, each run's items are joined and hashed, and the
digests of runs are a list again, until one is left. Places come from ranges (segmented_scan),
so the value does not depend on how rows lie in partitions, and a task holds FAN items at a
time, whatever the length of the list. A list of at most FAN items has the plain digest of its
items joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.operators.scans import segmented_scan
from huestrata.sources.staging import staged

FAN = 1024


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], item: str, separator: str = "\n", fan: int = FAN) -> DataFrame:
    """keys, n, digest of the items of each key in order. Null items are left out; a key without any other has no row, and without keys an empty table has none."""
    ks = [f"_d{i}" for i in range(len(keys))]
    rows = df.where(F.col(item).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.col(item).cast("string").alias("_item"), F.lit(1).alias("_one"))
    placed = segmented_scan(rows, ks, [*(f"_o{i}" for i in range(len(order))), "_item"], {}, "_place", {"_n": "_one"})
    now = placed.select(*ks, F.col("_n").alias("n"), F.col("_n").alias("_left"), (F.col("_place") - 1).alias("_at"), "_item")
    done = None
    while True:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]), separator)
        runs = now.groupBy(*ks, "n", F.ceil(F.col("_left") / fan).alias("_left"), F.floor(F.col("_at") / fan).alias("_at")).agg(F.sha2(run, 256).alias("_item"))
        runs = staged(runs)
        whole = runs.where("_left = 1").select(*(F.col(n).alias(k) for k, n in zip(keys, ks, strict=True)), "n", F.col("_item").alias("digest"))
        done = whole if done is None else done.unionByName(whole)
        now, separator = runs.where("_left > 1"), ""
        if now.isEmpty():
            return done


def digest_sql(source: str, keys: list[str], order: str, item: str, separator: str = "chr(10)", fan: int = FAN) -> str:
    """The same in SQL, for lists of up to fan * fan items: keys, n, digest."""
    k = ", ".join(keys)
    part, comma, group = (f"PARTITION BY {k} ", f"{k}, ", f" GROUP BY {k}") if keys else ("", "", "")
    first = f"SELECT {comma}{item} AS item, row_number() OVER ({part}ORDER BY {order}, {item}) - 1 AS place FROM {source} WHERE {item} IS NOT NULL"
    runs = f"SELECT {comma}place // {fan} AS run, count(*) AS n, sha256(string_agg(item, {separator} ORDER BY place)) AS digest FROM ({first}) GROUP BY {comma}run"
    return f"SELECT {comma}sum(n)::BIGINT AS n, CASE WHEN count(*) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY run)) END AS digest FROM ({runs}){group}"
