"""A Merkle manifest of a dataset, in DataFrame functions only.

Every row is a leaf, every group (a source) a tree of leaves in id order, and the groups'
roots are the leaves of the tree above them. A tree is built in rounds: aligned blocks of
FAN * FAN nodes keep a level as one string of hex digests, fixed-width substrings of it hash
to the level of parents, and the roots of the blocks are the nodes of the next round. What
flanks a node's substring within its run are its siblings. Blocks are of bounded size, so
that a group of any size, all rows even, is spread over tasks; the number of rounds grows
with the logarithm of the largest group. Siblings above a block are worked out once a block
and meet its rows only where these are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.llm.common import staged

#: Nodes of a run, hex letters of a digest.
FAN, HEX = 16, 64
#: Nodes of a block: two levels of runs.
BLOCK = FAN * FAN


def field(column: str | Column) -> Column:
    """A value as it enters a leaf: '-' if null, else its length in bytes of UTF-8, ':' and itself as text."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*columns: str | Column) -> Column:
    """SHA-256, in lower-case hex, of the columns' fields one after another."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(leaf: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and its proof, an array of (left, right) siblings from the bottom up, lead to."""
    return F.aggregate(proof, F.col(leaf) if isinstance(leaf, str) else leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof_text(proof: str | Column) -> Column:
    """All siblings of a proof as one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


# --- places -------------------------------------------------------------------------------


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows (a staged table) with `pos`, the place from 0 within the group by `order`, and `total`, the group's rows.

    Rows are dealt by ranges of (group, order), so that a large group is spread over tasks;
    what a range holds of each group is counted, and the counts before it make its offset.
    Nulls come first. Rows that are equal in all of these may lie in several ranges.
    """
    ranges = rows.withColumn("_s", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_s").sortWithinPartitions(*group, *order, "_s")
    placed = staged(ranges.drop("_s").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    runs = placed.groupBy(*group, part.alias("_p")).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    same = part == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(runs, same).select(*rows.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("pos"), "total")


# --- trees --------------------------------------------------------------------------------


def _node(level: Column, at: Column) -> Column:
    return F.substring(level, at * HEX + 1, F.lit(HEX))


def _parents(level: Column) -> Column:
    """The level above a level: its runs of FAN digests (the last may be shorter), each hashed."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "")


def _siblings(level: Column, at: Column) -> Column:
    """What flanks node `at` within its run of a level."""
    start = at - F.pmod(at, F.lit(FAN))
    left = F.substring(level, start * HEX + 1, (at - start) * HEX)
    right = F.substring(level, (at + 1) * HEX + 1, (start + FAN - 1 - at) * HEX)
    return F.struct(left.alias("left"), right.alias("right"))


def _path(at: Column, of: str = "") -> Column:
    """Siblings of node `at` of a block, whose columns begin with `of`, within the block, from the bottom up."""
    low, high = _siblings(F.col(f"{of}level0"), at), _siblings(F.col(f"{of}level1"), F.floor(at / FAN).cast("int"))
    return F.when(F.col(f"{of}depth") == 2, F.array(low, high)).when(F.col(f"{of}depth") == 1, F.array(low)).otherwise(_no_path())


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (tree, pos, total, digest, row), each with its nodes in order, its levels and its root."""
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("items"))
    blocks = blocks.withColumn("level0", F.array_join(F.transform("items", lambda x: x["digest"]), ""))
    blocks = blocks.withColumn("depth", F.when(F.col("total") > FAN, 2).when(F.col("total") > 1, 1).otherwise(0))
    blocks = blocks.withColumn("level1", F.when(F.col("depth") > 0, _parents(F.col("level0"))))
    return blocks.withColumn("root", F.when(F.col("depth") == 2, F.sha2("level1", 256)).when(F.col("depth") == 1, F.col("level1")).otherwise(F.col("level0")))


def _climb(nodes: DataFrame) -> DataFrame:
    """Builds the trees of nodes (tree, pos, total, digest, row): their lowest blocks, with `above`, the siblings from a block's root up, and `top`, the tree's root."""
    rounds = [staged(_blocks(nodes))]
    while not (higher := rounds[-1].where(F.col("total") > BLOCK)).isEmpty():
        of_blocks = higher.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("root").alias("digest"), F.lit(None).cast("int").alias("row"))
        rounds.append(staged(_blocks(of_blocks)))
    above = rounds.pop().withColumn("above", _no_path()).withColumn("top", F.col("root"))
    while rounds:
        parent = above.select(*(F.col(x).alias(f"_{x}") for x in ("tree", "block", "level0", "level1", "depth", "above", "top")))
        has_parent = F.col("total") > BLOCK
        joined = rounds.pop().join(parent, has_parent & F.col("tree").eqNullSafe(F.col("_tree")) & (F.floor(F.col("block") / BLOCK) == F.col("_block")), "left")
        path = F.concat(_path(F.pmod("block", F.lit(BLOCK)).cast("int"), "_"), F.col("_above"))
        joined = joined.withColumn("above", F.when(has_parent, path).otherwise(_no_path())).withColumn("top", F.when(has_parent, F.col("_top")).otherwise(F.col("root")))
        above = joined.drop(*(c for c in joined.columns if c.startswith("_")))
    return above


def merkle_manifest(rows: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, group, leaf, subroot, root, proof (array of siblings, left and right, bottom up) and the columns of `carry`.

    `leaf` gives a row's digest as 64 hex letters (see leaf_digest). In a group leaves ascend
    by id, nulls first; rows that share an id are ordered by digest, so rows that repeat
    everything are leaves of their own, one beside the other. While a tree has several nodes,
    every FAN consecutive ones (the last run: what is left, even one) become the digest of
    their digests; a lone leaf is itself the group's root. Groups' roots in order of the group,
    nulls first and strings by their bytes of UTF-8, make the tree of `root`. An empty table
    has no rows and no root. Other columns are ignored, whatever their names.
    """
    carry = carry or {}
    start = rows.select(F.col(group_col).alias("tree"), F.col(id_col).alias("_id"), leaf.alias("digest"), F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in carry.items())).alias("_carry"))
    nodes = numbered(staged(start), ["tree"], ["_id", "digest"]).select("tree", "pos", "total", "digest", F.struct("_id", "_carry").alias("row"))
    groups = staged(_climb(nodes))
    roots = staged(groups.where("block = 0").select("tree", F.col("top").alias("digest")))
    over = numbered(roots, [], ["tree"]).select(F.lit(0).alias("tree"), "pos", "total", "digest", F.struct("tree").alias("row"))
    over = _climb(over).select(F.posexplode("items").alias("_at", "_item"), "level0", "level1", "depth", "above", "top")
    over = over.select(F.col("_item.row.tree").alias("_group"), F.concat(_path(F.col("_at")), F.col("above")).alias("_over"), F.col("top").alias("_root"))
    whole = groups.join(over, F.col("tree").eqNullSafe(F.col("_group")))
    out = whole.select("tree", F.posexplode("items").alias("_at", "_item"), "level0", "level1", "depth", F.concat("above", "_over").alias("_up"), "top", "_root")
    return out.select(
        F.col("_item.row._id").alias(id_col), F.col("tree").alias(group_col), F.col("_item.digest").alias("leaf"), F.col("top").alias("subroot"), F.col("_root").alias("root"),
        F.concat(_path(F.col("_at")), F.col("_up")).alias("proof"), *(F.col("_item.row._carry")[k].alias(k) for k in carry),
    )


def manifest_check(docs: DataFrame, fields: list[str | Column], changed: list[str | Column] | None = None, tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf of `fields` is in the manifest. Where `tampered` holds, what is checked is the
    leaf of `changed`, as if the row had been altered since; elsewhere the leaf itself.
    """
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(*(changed or fields))) if tampered is not None else F.lit(None).cast("string")
    made = merkle_manifest(docs, leaf_digest(*fields), id_col, group_col, {"_other": other})
    made = made.withColumn("folded_root", fold(F.coalesce("_other", "leaf"), "proof"))
    return made.select(id_col, "leaf", "subroot", "root", F.sha2(proof_text("proof"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
