"""Hard negatives by Fagin's threshold algorithm.

Rows go through tasks in blocks of bounded size. A block keeps, per dimension, a list of its
rows sorted by that component. For an anchor every list is read from the end that its
component's sign favours, all lists to the same depth; what turns up is scored as a whole
(random access), and the components at the present depth give a threshold that no row not
yet seen exceeds. A window, the score range of one positive, is done as soon as the threshold
falls strictly below its kth score or its lower bound. Windows keep what earlier blocks of
the task gave them, so that later blocks stop sooner. The best of each task meet in one
ranking per window.

Anchors are a part of all rows and grow with them, so they are taken in numbered batches of
bounded size: a batch is sent to the tasks, and every batch reads all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huestrata.llm.common import staged
from huestrata.llm.merkle import numbered

#: An id that is missing comes after all others.
_LAST = np.iinfo(np.int64).max


@dataclass
class Params:
    """positives and negatives: how many of each; a negative's score lies between low / 100 and 100 / 100 of the positive's.
    block_rows, batch_rows: bounds of a block of rows and of a batch of anchors; both shrink for long vectors (most_bytes)."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    scale: int = 256
    block_rows: int = 8192
    batch_rows: int = 4096
    most_bytes: int = 64 << 20

    def rows_of(self, bound: int, width: int) -> int:
        return max(1, min(bound, self.most_bytes // (16 * max(1, width))))


# --- one block ----------------------------------------------------------------------------


class Lists:
    """Integer vectors with a sorted list per dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        depths, d = [], 4
        while d < len(x):
            depths.append(d)
            d *= 2
        #: depths at which the threshold is looked at; at the last all is seen
        self.depths = [*depths, len(x)]

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor and depth the most that a row not seen by then can score."""
        d = np.array(self.depths)
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.values[:, len(self.x) - d] + down @ self.values[:, d - 1]

    def search(self, anchor: np.ndarray, thresholds: np.ndarray, offer) -> None:
        """Sorted access in rounds; offer(rows, scores) takes what is new and returns the score below which nothing matters."""
        n = len(self.x)
        rising, falling = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        before = 0
        for depth, most in zip(self.depths, thresholds, strict=True):
            if depth == n:
                new = np.flatnonzero(~seen)
            else:
                mark = np.zeros(n, bool)
                mark[self.order[rising, n - depth : n - before]] = True
                mark[self.order[falling, before:depth]] = True
                new = np.flatnonzero(mark & ~seen)
            seen[new] = True
            if most < offer(new, self.x[new] @ anchor):
                return
            before = depth


def _exact(x: np.ndarray) -> np.ndarray:
    """Floats while every inner product stays an integer below 2^53, else 64-bit integers."""
    most = float(np.abs(x).max(initial=0))
    return x.astype(np.float64) if most * most * max(1, x.shape[1]) < 2.0**53 else x


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Tops:
    """The best (score, id) found so far in each of some windows, each with scores from `low` to `high`."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = [np.empty(0, np.int64) for _ in low]
        self.ids = [np.empty(0, np.int64) for _ in low]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> float:
        floor = np.inf
        for w, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            if low > high:
                continue
            fit = np.flatnonzero((scores >= low) & (scores <= high))
            if len(fit):
                s, i = np.concatenate((self.scores[w], scores[fit].astype(np.int64))), np.concatenate((self.ids[w], ids[fit]))
                top = _best(s, i, self.k)
                self.scores[w], self.ids[w] = s[top], i[top]
            kth = self.scores[w][-1] if len(self.scores[w]) == self.k else low
            floor = min(floor, kth)
        return floor


# --- blocks in tasks ----------------------------------------------------------------------


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; a shorter vector ends in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of the rows of a task, at most `rows` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        vec = t.column("vec").combine_chunks()
        return t.column("id").fill_null(_LAST).to_numpy(), t.column("code").to_numpy(), _vectors(vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec, width)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(rows - size, batch.num_rows - at))
            held.append(part)
            size, at = size + part.num_rows, at + part.num_rows
            if size == rows:
                yield block()
                held, size = [], 0
    if size:
        yield block()


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor long, window int, id long, score long"


def _rows_out(tops: dict[int, Tops]) -> Iterator[pa.RecordBatch]:
    anchor, window, ids, scores = [], [], [], []
    for a, top in tops.items():
        for w in range(len(top.low)):
            n = len(top.ids[w])
            anchor += [a] * n
            window += [w] * n
            ids.append(top.ids[w])
            scores.append(top.scores[w])
    if anchor:
        found = np.concatenate(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(window, pa.int32()), pa.array(found, pa.int64(), mask=found == _LAST), pa.array(np.concatenate(scores), pa.int64())], names=["anchor", "window", "id", "score"]
        )


def _search(rows: DataFrame, batch: dict, width: int, params: Params, same_label: bool) -> DataFrame:
    """anchor, window, id, score: of each task the best of every window of the batch's anchors, among rows of the
    anchor's own label (but for rows of its id) or of other labels."""
    sent = rows.sparkSession.sparkContext.broadcast(batch)  # at most batch_rows anchors
    size, k = params.rows_of(params.block_rows, width), params.positives if same_label else params.negatives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        tops = {a: Tops(low, high, k) for a, (low, high) in enumerate(anchors["windows"])}
        for ids, codes, x in _blocks(batches, size, width):
            both = _exact(np.concatenate((x, anchors["vec"])))
            x, vec = both[: len(x)], both[len(x) :]
            if same_label:
                sides = [(anchors["code"] == c, codes == c) for c in np.intersect1d(anchors["code"], codes)]
            else:
                sides = [(np.ones(len(vec), bool), np.ones(len(x), bool))]
            for mine, chosen in sides:
                lists, own = Lists(x[chosen]), ids[chosen]
                barred = codes[chosen] if not same_label else own
                for a, bound in zip(np.flatnonzero(mine), lists.thresholds(vec[mine]), strict=True):
                    bar = anchors["id" if same_label else "code"][a]

                    def offer(new, scores, top=tops[a], own=own, barred=barred, bar=bar):
                        fit = barred[new] != bar
                        return top.offer(scores[fit], own[new[fit]])

                    if len(tops[a].low):
                        lists.search(vec[a], bound, offer)
        yield from _rows_out({int(anchors["key"][a]): t for a, t in tops.items()})

    return rows.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window over all tasks, with their rank from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- whole tables -------------------------------------------------------------------------


def integer_vectors(vectors: DataFrame, vec_col: str, label: str, id_col: str, scale: int = 256) -> DataFrame:
    """id, label, vec: rows with a label and a vector of finite components only, each floor(scale * x)."""
    x = F.col(vec_col)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.expr(label).alias("label"), F.when(whole, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))).alias("vec"))
    return rows.where("label IS NOT NULL AND vec IS NOT NULL")


def hard_negatives(vectors: DataFrame, anchors: str = "id % 100 = 0", label: str = "label", params: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `label` is an SQL expression over the table's columns, `anchors` one over `id`. A row's score is its integer inner product with the anchor, higher first, ties by
    smaller id. Positives are the anchor's first rows of the same label with another id;
    negatives the first rows of other labels whose score is from low to 100 hundredths of the
    positive's, so none where a positive's score is below zero.

    Rows with a null label or vector, or with a null or non-finite component, take no part.
    Rows without an id can be found, after all others of their score, but are no anchors.
    Rows that repeat an id are rows of their own; as anchors each has its own result. Shorter
    vectors count as filled up with zeros; scores must fit 64 bits. Empty tables give no rows;
    other columns are ignored, whatever their names.
    """
    rows = integer_vectors(vectors, vec_col, label, id_col, params.scale)
    whole = rows.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    code = F.col("label").cast("long") if whole else F.xxhash64(F.col("label").cast("string"))
    rows = staged(rows.select("id", code.alias("code"), "vec"))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not count:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    # as many files as there are blocks, up to four a core: larger ones are split as they are read
    parts = min(-(-count // params.rows_of(params.block_rows, width)), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    blocks = staged(rows.repartition(parts))
    marked = staged(rows.where(F.expr(anchors) & F.col("id").isNotNull()))
    chosen = staged(numbered(marked, [], ["id", "code"]).select("id", "code", "vec", F.col("pos").alias("key")))
    many, size, out = chosen.count(), params.rows_of(params.batch_rows, width), None
    for start in range(0, many, size):
        found = _of_batch(blocks, chosen.where(F.col("key").between(start, start + size - 1)), width, params)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], _RESULT)


def _of_batch(blocks: DataFrame, chosen: DataFrame, width: int, params: Params) -> DataFrame:
    """The result of one batch of anchors; positives and negatives are staged, so that neither search runs twice."""
    got = chosen.orderBy("key").toArrow()  # at most batch_rows anchors
    vec = got.column("vec").combine_chunks()
    batch = {"key": got.column("key").to_numpy(), "id": got.column("id").to_numpy(), "code": got.column("code").to_numpy(), "vec": _vectors(vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec, width)}
    every = (np.array([-np.inf]), np.array([np.inf]))
    positives = staged(_ranked(_search(blocks, batch | {"windows": [every] * len(batch["key"])}, width, params, True), params.positives))
    windows: dict[int, dict[int, int]] = {}
    for r in positives.select("anchor", "rank", "score").collect():  # at most `positives` of each anchor of the batch
        windows.setdefault(r["anchor"], {})[r["rank"] - 1] = r["score"]
    bounds = []
    for key in batch["key"].tolist():
        s = np.array([v for _, v in sorted(windows.get(key, {}).items())], np.int64)
        bounds.append((-((-params.low * s) // 100), s))  # the least integer that is low hundredths of the positive's score or more
    found = _ranked(_search(blocks, batch | {"windows": bounds}, width, params, False), params.negatives)
    of_positive = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = staged(found.join(of_positive, ["anchor", "window"]).join(chosen.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"))
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
