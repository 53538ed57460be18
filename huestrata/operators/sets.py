"""Set operations, dedup and first-wins merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.operators.digests import ordered_digest


def first_wins(df: DataFrame, keys: list[str], order: list[str], gather: dict[str, str] = {}) -> DataFrame:
    """The first row of each key; gather: new column -> column whose distinct values of all rows it lists, sorted."""
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    if not gather:
        return first
    lists = df.groupBy(*keys).agg(*(F.sort_array(F.collect_set(c)).alias(n) for n, c in gather.items()))
    return first.join(lists, keys)


def digest_of_set(df: DataFrame, column: str) -> DataFrame:
    """One row: the digest of the sorted distinct values, joined by line breaks (see ordered_digest for long lists)."""
    return ordered_digest(df.select(column).distinct(), [], [column], column).select("digest")


def opposites(df: DataFrame, key: str, rule: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Keys that hold both rules of a pair of opposites: key, first, second."""
    table = df.sparkSession.createDataFrame(pairs, "first string, second string")
    have = df.select(key, F.col(rule).alias("first")).distinct()
    other = df.select(key, F.col(rule).alias("second")).distinct()
    return have.join(F.broadcast(table), "first").join(other, [key, "second"]).select(key, "first", "second")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, one row per broken check: the columns of df and `broken`."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return df.withColumn("broken", F.explode(names))


def reasons(checks: dict[str, Column]) -> Column:
    """Array of the names of the checks that fail; empty means ready."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def first_unmet(checks: list[tuple[Column, str]], ready: str) -> Column:
    """The state of the first condition that does not hold, else ready."""
    out = None
    for ok, state in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, state) if out is None else out.when(bad, state)
    return out.otherwise(ready)


# --- contracts ----------------------------------------------------------------------------------


def complete_graph_violations(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and what is broken of graphs that should be complete: nodes (keys, id), edges (keys, a, b)."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids"))
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("a", "b").alias("pairs"))
    both = n.join(e, keys, "left").fillna(0, ["edges", "pairs"])
    whole = F.col("edges") == F.floor(F.col("nodes") * (F.col("nodes") - 1) / 2)
    return violations(both, {"duplicate_node": F.col("nodes") == F.col("ids"), "duplicate_pair": F.col("edges") == F.col("pairs"), "incomplete": whole}).select(*keys, "broken")


def distribution_mismatch(claimed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Values whose claimed count is not that of the rows: key, claimed, counted."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("counted"))
    both = claimed.join(counted, key, "full_outer").fillna(0, ["claimed", "counted"])
    return both.where("claimed <> counted").select(key, "claimed", "counted")


def checklist(checks: dict[str, DataFrame]) -> DataFrame:
    """Numbered checks, each a DataFrame of one boolean `pass`, with how many pass and fail."""
    rows = None
    for no, (item, df) in enumerate(checks.items(), 1):
        row = df.select(F.lit(no).alias("no"), F.lit(item).alias("item"), "pass")
        rows = row if rows is None else rows.unionByName(row)
    every = Window.partitionBy()  # as many rows as checks
    return rows.select("no", "item", "pass", F.count_if("pass").over(every).alias("passed"), F.count_if(~F.col("pass")).over(every).alias("failed"))


# What a pool of references must keep to.
POOL = {"least": 50, "most": 100, "families": 3, "share": 0.5, "failure": 0.2}


def pool_audit(refs: DataFrame, key: str) -> DataFrame:
    """Per pool its size, sources, families, largest source's share, failed share, and the checks it breaks.

    refs: key, source, family, failed, missed (no copy in the cache either).
    """
    top = refs.groupBy(key, "source").agg(F.count(F.lit(1)).alias("k")).groupBy(key).agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("sources"))
    n = F.count(F.lit(1))
    all_of = refs.groupBy(key).agg(n.alias("n"), F.countDistinct("family").alias("families"), F.avg(F.col("failed").cast("int")).alias("failure_ratio"), F.count_if(F.col("missed") & F.col("failed")).alias("unresolved"))
    both = all_of.join(top, key).withColumn("top_share", F.col("top") / F.col("n"))
    broken = reasons({
        "reference_count": F.col("n") >= POOL["least"], "reference_count_max": F.col("n") <= POOL["most"], "query_family_diversity": F.col("families") >= POOL["families"],
        "source_concentration": F.col("top_share") <= POOL["share"], "url_failure_ratio": F.col("failure_ratio") <= POOL["failure"], "cache_unresolved": F.col("unresolved") == 0,
    })
    return both.select(key, "n", "sources", "families", "top_share", "failure_ratio", broken.alias("broken"))


def commitment(sealed: DataFrame, got: DataFrame, keys: list[str], frozen_at: int) -> DataFrame:
    """Per batch (keys) what of got breaks the commitment: case_id, pair_key and place were sealed; got also has `at`."""
    digest = lambda df, name: ordered_digest(df, keys, ["pair_key"], "pair_key").select(*keys, F.col("digest").alias(name))
    s = digest(sealed, "_s")
    g = got.groupBy(*keys).agg(((F.count(F.lit(1)) == F.countDistinct("case_id")) & (F.count(F.lit(1)) == F.countDistinct("pair_key"))).alias("_once"), F.min("at").alias("_at"))
    side = got.select(*keys, "place", F.col("case_id").alias("_case"), F.col("pair_key").alias("_pair"))
    same = lambda a, b: F.bool_and(F.coalesce(F.col(a) == F.col(b), F.lit(False)))
    rows = sealed.join(side, [*keys, "place"], "full_outer").groupBy(*keys).agg(same("case_id", "_case").alias("_ids"), same("pair_key", "_pair").alias("_pairs"))
    both = rows.join(s, keys, "left").join(g, keys, "left").join(digest(got, "_g"), keys, "left")
    broken = reasons({"digest": F.col("_s") == F.col("_g"), "repeated": F.col("_once"), "case_order": F.col("_ids"), "pair_order": F.col("_pairs"), "predates_freeze": F.col("_at") >= frozen_at})
    return both.select(*keys, broken.alias("broken"))


def manifest_print(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, files, print: the digest of the fingerprints of a manifest's rows (file, bytes, sha, missing) in order of name."""
    row = F.sha2(F.concat_ws("|", "file", F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.coalesce("sha", F.lit("")), F.col("missing").cast("string")), 256)
    rows = files.select(*keys, "file", row.alias("_r"))
    return ordered_digest(rows, keys, ["file"], "_r", "").select(*keys, F.col("n").alias("files"), F.col("digest").alias("print"))


def pinned(before: DataFrame, after: DataFrame, key: str, row: Column) -> DataFrame:
    """key, state: whether datasets have the rows they were pinned with, by count and a sum of row fingerprints that any order gives."""
    pin = lambda df, name: df.groupBy(key).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("print")).alias(name))
    both = pin(before, "_b").join(pin(after, "_a"), key, "left")
    return both.select(key, F.when(F.col("_b").eqNullSafe(F.col("_a")), "PINNED").otherwise("HOLD_DATASET_LINEAGE_DRIFT").alias("state"))
