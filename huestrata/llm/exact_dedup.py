"""Exact duplicate removal with DataFrame functions only.

Rows are grouped by a 128-bit content hash together with the bytes themselves, so that two
texts with one hash fall into different groups. Partial aggregation leaves one row of a
group per map task, whatever the size of the group. Members find their group through the
pair (128-bit hash, SHA-256), so that texts are shuffled once and only after pre-aggregation.
They join on the pair as one value: groups are then dealt anew for the join, and Spark can
split the members of a hot group over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import text_of, unused


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Column | None = None, keep_largest: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. The largest id stays (the
    smallest with keep_largest=False); rows that repeat id and text all are "the row that
    stays". Null ids never win against another; in a group without any id keep_id is null
    and its rows are kept. Empty input gives an empty result; other columns are ignored.
    Texts that differ but share the 128-bit hash are told apart by their bytes; if they
    shared SHA-256 too, the query would stop with an error rather than merge them.
    """
    text = text_of(text_col)
    hash128 = F.unhex(F.md5(text)) if hash128 is None else hash128
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), hash128.alias("_h"))
    best = F.max("_id") if keep_largest else F.min("_id")
    groups = rows.groupBy("_h", "_t").agg(best.alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = groups.select("_h", F.unhex(F.sha2("_t", 256)).alias("_sha"), "_keep", "_n")
    groups = groups.groupBy("_h", "_sha").agg(F.max("_keep").alias("_keep"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    one_text = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("boolean")).otherwise(True)
    groups = groups.where(one_text).select(F.concat("_h", "_sha").alias("_key"), "_keep", "_n")
    members = rows.select("_id", F.unhex(F.sha2("_t", 256)).alias("_sha"), "_h").select("_id", "_sha", F.concat("_h", "_sha").alias("_key"))
    joined = members.join(groups, "_key")
    return joined.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat both id and text of one that stays stay too."""
    sha, kept_id, kept_sha = (unused(docs, x) for x in ("_sha", "_kept_id", "_kept_sha"))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(kept_id), F.unhex("text_sha256").alias(kept_sha)).distinct()
    rows = docs.withColumn(sha, F.unhex(F.sha2(text_of(text_col), 256)))
    return rows.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi").drop(sha)
