"""Near-duplicate classes by bottom-k sketches from one hash function.

1. Every text becomes its set of hashed word shingles; equal sets form one class.
2. The k smallest hashes of a class are its sketch. Inverted lists of sketch values tell
   which classes can have a partner: two sets of Jaccard similarity t share at least c of
   their k values except with probability `miss`, so the c - 1 most frequent values of each
   sketch are left out, and what fills the corpus makes no candidates.
3. For these, full sets are fetched. Shingles that no other of them has bound every overlap
   from above, exactly; a class that the bound rules out is done.
4. Inverted lists of the few smallest values of the rest are not expanded into pairs. In a
   round, each list's members are compared with one pivot of another component, and what
   links merges. When a round no longer helps much, the pairs left in different components
   are all compared, each in one list only, so that no link is lost.
5. A pair first passes the estimate from the sketch of the union, then the exact similarity
   of the full sets decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from huestrata.llm.common import drop_path, per_text, shingle_hashes, slices, staged, staging_dir, text_of, unused, word_hashes
from huestrata.llm.components import stars


@dataclass
class Params:
    """similarity = num / den; k: sketch that searches; deep: sketch that estimates; help: share of the open pairs
    that a round must settle for another round to follow, of at most `rounds`."""

    width: int = 5
    k: int = 48
    num: int = 3
    den: int = 4
    miss: float = 1e-9
    deep: int = 256
    help: float = 0.25
    rounds: int = 8

    @property
    def keys(self) -> int:
        """The smallest number of least hashes of which a link shares none with probability at most miss."""
        return math.ceil(math.log(self.miss) / math.log(1 - self.num / self.den))

    def least_shared(self, size: int) -> int:
        """The largest c for which a link's sketches share fewer than c of `size` values with probability at most miss."""
        t, tail, c = self.num / self.den, 0.0, 0
        while c <= size:
            tail += math.comb(size, c) * t**c * (1 - t) ** (size - c)
            if tail > self.miss:
                break
            c += 1
        return c


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes as non-negative longs."""
    return np.unique((shingle_hashes(words, width) >> np.uint64(1)).astype(np.int64))


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (a hash of the text), n (set size), key (128-bit digest of the set), sketch (its k smallest hashes)."""

    def run(texts: list[str]) -> list:
        n, key, sketch = [], [], []
        for words in word_hashes(texts):
            s = shingle_set(words, params.width)
            n.append(len(s))
            key.append(_digest(s))
            sketch.append(s[: params.k].copy())
        return [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))]

    rows = docs.select(_row_key(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    return per_text(rows, "_row", "_text", "n long, key binary, sketch array<bigint>", run).select("_row.doc_id", "_row.h", "n", "key", "sketch")


def _row_key(id_col: str, text_col: str):
    """What tells rows apart, but for those that repeat both: ids alone may be missing or shared by many rows."""
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"))


def _full_sets(docs: DataFrame, wanted: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """cid, n, values: the full sets of the wanted classes (cid, key, rep), from the text of one row each.

    Of rows that repeat id and text a task looks at the first only.
    """
    rows = docs.select(_row_key(id_col, text_col).alias("_row"), text_of(text_col).alias("_t"))
    rows = rows.select(F.col("_row.doc_id").alias("_id"), F.col("_row.h").alias("_h"), "_t")
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_h") == F.col("rep.h"))).select("cid", "key", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in slices(batches):
            first: dict[tuple[int, str], int] = {}
            for i, (cid, text) in enumerate(zip(part.column("cid").to_pylist(), part.column("_t").to_pylist(), strict=True)):
                if cid not in done:
                    first.setdefault((cid, text), i)
            part = part.take(pa.array(first.values(), pa.int64()))
            at, values = [], []
            for i, (key, words) in enumerate(zip(part.column("key").to_pylist(), word_hashes(text for _, text in first), strict=True)):
                s = shingle_set(words, params.width)
                if _digest(s) == key:  # else another text has the same id and hash
                    at.append(i)
                    values.append(s)
            cid = part.column("cid").take(pa.array(at, pa.int64()))
            done.update(cid.to_pylist())
            yield pa.RecordBatch.from_arrays([cid, pa.array([len(s) for s in values], pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["cid", "n", "values"])

    return rows.mapInArrow(run, "cid long, n long, values array<bigint>")


def _estimate(sa: str, na: str, sb: str, nb: str, params: Params):
    """Whether the sketch of the union of two sets, from theirs, leaves room for a link. A set no larger than its
    sketch is the sketch, so for two of these the answer is exact."""
    union = F.slice(F.sort_array(F.array_union(sa, sb)), 1, params.deep)
    both = F.array_intersect(sa, sb)
    need = F.element_at(F.array(*[F.lit(params.least_shared(m)) for m in range(1, params.deep + 1)]), F.size(union))
    exact = params.den * F.size(both) >= params.num * (F.col(na) + F.col(nb) - F.size(both))
    return F.when((F.col(na) <= params.deep) & (F.col(nb) <= params.deep), exact).otherwise(F.size(F.array_intersect(union, both)) >= need)


def _estimated(pairs: DataFrame, open_sets: DataFrame, params: Params) -> DataFrame:
    side = lambda x: open_sets.select(F.col("cid").alias(x), F.col("sk").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_estimate("sa", "na", "sb", "nb", params)).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    full = pairs.join(sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("values").alias("va")), "a")
    full = full.join(sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb")), "b")
    common = F.size(F.array_intersect("va", "vb")).cast("long")
    return full.where(params.den * common >= params.num * (F.col("na") + F.col("nb") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a text of fewer
    words than a shingle is one shingle, a text without words (or null) has an empty set
    and is linked with nothing. component_id is the smallest id that links reach; kept is
    id = component_id, so rows that repeat an id and its text are all kept or all not.
    Ids may be of any type with an order. A component without any id has a null component_id
    and its rows are kept. Empty input gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    wide, path = staging_dir(spark), staging_dir(spark)
    rows = staged(sketches(docs, params, id_col, text_col), wide)
    found = rows.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(found.withColumn("cid", F.monotonically_increasing_id()), path)
    rows, ids = staged(rows.select("doc_id", "n", "key")), staged(classes.select("key", "cid", "rep"))
    rep_id = F.col("rep.doc_id").alias("rep")
    drop_path(spark, wide)  # sketches are with the classes now
    merged = _merge(docs, classes, ids, params, id_col, text_col, path)
    if merged is not None:
        of_root = ids.select(F.col("cid").alias("v"), F.col("rep.doc_id").alias("root_rep"))
        low = merged.join(ids.select(F.col("cid").alias("u"), rep_id), "u").join(of_root, "v").groupBy("v").agg(F.least(F.min("rep"), F.min("root_rep")).alias("low"))
        named = merged.select(F.col("u").alias("cid"), "v").unionByName(low.select(F.col("v").alias("cid"), "v")).join(low, "v").select("cid", "low")
        ids = ids.join(named, "cid", "left").select("key", F.least("rep.doc_id", "low").alias("component"))
    else:
        ids = ids.select("key", F.col("rep.doc_id").alias("component"))
    out = rows.select("doc_id", "n", "key").join(ids, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _apart(rows: DataFrame) -> DataFrame:
    """rows with a join key that is not the one they are grouped by: they are dealt anew for the join, and Spark can split hot values."""
    return rows.withColumn("_v", F.bitwise_not("value")).drop("value")


def _merge(docs: DataFrame, classes: DataFrame, ids: DataFrame, params: Params, id_col: str, text_col: str, sketched: str) -> DataFrame | None:
    """Stars (u, v) over class ids after all links, or None if there is no candidate.

    What a step has staged and no later one reads is deleted; `sketched` is where classes lie.
    """
    spark = docs.sparkSession
    values = classes.select("cid", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    lists = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = values.withColumn("_v", F.bitwise_not("value")).join(_apart(lists), "_v").drop("_v")
    order = Window.partitionBy("cid").orderBy(F.desc("df"), "value")
    drop = F.element_at(F.array(*[F.lit(max(1, params.least_shared(m))) for m in range(1, params.k + 1)]), F.col("m")) - 1
    kept = known.withColumn("at", F.row_number().over(order)).where(F.col("at") > drop).select("value", "cid", "n")
    alive = kept.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("value")
    wanted = _apart(kept.select("value", "cid")).join(_apart(alive), "_v").select("cid").distinct().join(ids, "cid")
    sets = staged(_full_sets(docs, wanted, params, id_col, text_col))
    drop_path(spark, sketched)

    lone = sets.select("cid", F.explode("values").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("cid")).where("c = 1")
    lone = lone.groupBy("cid").agg(F.count(F.lit(1)).alias("lone"))
    open_sets = sets.join(lone, "cid", "left").withColumn("s", F.col("n") - F.coalesce("lone", F.lit(0)))
    open_sets = open_sets.where(params.den * F.col("s") >= params.num * F.col("n"))
    open_sets = staged(open_sets.select("cid", "n", "s", F.slice("values", 1, params.deep).alias("sk")))

    values = open_sets.select("cid", "n", "s", F.explode(F.slice("sk", 1, params.keys)).alias("value"))
    alive = values.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("value")
    kept = staged(values.withColumn("_v", F.bitwise_not("value")).join(_apart(alive), "_v").drop("_v"))

    # an overlap is at most the smaller number of shingles that anyone shares
    t, d = params.num, params.num + params.den
    near = (params.den * F.least("n", "pn") >= params.num * F.greatest("n", "pn")) & (d * F.least("s", "ps") >= t * (F.col("n") + F.col("pn")))
    pair = [F.least("cid", "pc").alias("a"), F.greatest("cid", "pc").alias("b")]
    merged, before, old = None, None, None
    for turn in range(params.rounds + 1):
        if merged is None:
            lists = kept.withColumn("comp", F.col("cid"))
        else:
            comps = merged.select(F.col("u").alias("cid"), F.col("v").alias("root"))
            if old:
                drop_path(spark, old)
            old = staging_dir(spark)
            lists = staged(kept.join(comps, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root"), old)
        sizes = lists.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"))
        sizes = sizes.groupBy("value").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("k"))
        sizes = staged(sizes.where("k > 1").select("value", "all", "sq", F.col("most.comp").alias("major")))
        left = sizes.agg(F.sum((F.col("all") * F.col("all") - F.col("sq")) / 2)).first()[0] or 0
        if not left:
            break
        last = turn == params.rounds or (turn > 1 and left > (1 - params.help) * before)
        before = left
        if last:  # members outside a list's largest component against all, each pair in the list of its least common value
            open_lists = lists.join(sizes.select("value", "major"), "value").join(open_sets.select("cid", "sk"), "cid")
            minor = open_lists.where("comp <> major").select(*(F.col(x).alias(y) for x, y in (("value", "pvalue"), ("cid", "pc"), ("n", "pn"), ("s", "ps"), ("comp", "pcomp"), ("sk", "psk"))))
            rule = (F.col("comp") == F.col("major")) | (F.col("cid") < F.col("pc"))
            least = F.array_min(F.array_intersect(F.slice("sk", 1, params.keys), F.slice("psk", 1, params.keys)))
            both = (F.col("value") == F.col("pvalue")) & (F.col("comp") != F.col("pcomp")) & rule & near & (least == F.col("value")) & _estimate("sk", "n", "psk", "pn", params)
            pairs = open_lists.join(minor, both).select(*pair)
        else:
            priority = F.col("cid") if turn == 0 else F.xxhash64("value", "cid", F.lit(turn))
            pivots = lists.groupBy("value").agg(F.min(F.struct(priority.alias("p"), "cid", "n", "s", "comp")).alias("m")).join(sizes.select("value"), "value")
            pivots = pivots.select("value", F.col("m.cid").alias("pc"), F.col("m.n").alias("pn"), F.col("m.s").alias("ps"), F.col("m.comp").alias("pcomp"))
            pairs = _estimated(_apart(lists).join(_apart(pivots), "_v").where((F.col("comp") != F.col("pcomp")) & near).select(*pair).distinct(), open_sets, params)
        at = staging_dir(spark)
        links = staged(_links(pairs, sets, params), at)
        merged = stars(links if merged is None else links.unionByName(merged))
        drop_path(spark, at)
        if last:
            break
    return merged


def keep_one_of_each(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which near_duplicates() says kept; where rows share an id, all stay if one does."""
    kept_id = unused(docs, "_kept_id")
    kept = near_duplicates(docs, params, id_col, text_col).where("kept").select(F.col(id_col).alias(kept_id)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
