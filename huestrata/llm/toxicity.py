"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic texts are the positives P; all other texts are unlabelled, U. A linear
numpy classifier on word presence minimises  pi R_P(+) + max(0, R_U(-) - pi R_P(-)),
the class-prior-corrected risk kept from going below zero (Kiryo et al. 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import APART, held_out, per_text, sample_ids, slices, staged, text_of, text_udf, word_hashes

BUCKETS = 1 << 22


@dataclass
class NnPuParams:
    """Bounds and settings of the fit. Rows beyond the bounds are only scored, never learned from."""

    most_positive: int = 6000
    most_unlabelled: int = 12000
    most_features: int = 4000
    least_df: int = 3
    epochs: int = 300
    rate: float = 0.1
    ridge: float = 2e-4
    seed: int = 7


def text_features(texts) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of each text's words (runs of letters and digits, A-Z in lower case)."""
    for words in word_hashes(texts, APART):
        yield np.unique((words >> np.uint64(42)).astype(np.int32))


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, features)
        at[at == len(self.buckets)] = 0
        hit = at[self.buckets[at] == features] if len(self.buckets) else at[:0]
        z = self.bias + float(self.weights[hit].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Rows:
    """Sparse rows of 0/1 features in coordinate form."""

    def __init__(self, rows: list[np.ndarray], buckets: np.ndarray):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate([*rows, np.empty(0, np.int32)])
        at = np.searchsorted(buckets, flat)
        at[at == len(buckets)] = 0
        known = buckets[at] == flat if len(buckets) else np.zeros(len(flat), bool)
        self.n, self.row, self.col = len(rows), row[known], at[known]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], width)


def gap(rate_p, rate_u, n_p, root):
    """How far a feature's rate among positives is from that among unlabelled, in standard errors."""
    return (rate_p - rate_u) / root(rate_u * (1 - rate_u) / n_p + 1 / (n_p * n_p))


def choose_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], params: NnPuParams) -> np.ndarray:
    """The most_features buckets with the largest gap, in ascending order; ties by bucket."""
    buckets, df = np.unique(np.concatenate([*positive, np.empty(0, np.int32)]), return_counts=True)
    everywhere, df_u = np.unique(np.concatenate([*unlabelled, np.empty(0, np.int32)]), return_counts=True)
    at = np.minimum(np.searchsorted(everywhere, buckets), max(0, len(everywhere) - 1))
    rate_u = np.where(everywhere[at] == buckets, df_u[at], 0) / len(unlabelled) if len(everywhere) else np.zeros(len(buckets))
    far = np.abs(gap(df / len(positive), rate_u, len(positive), np.sqrt))
    keep = np.flatnonzero((df >= params.least_df) & (far > 3))
    return np.sort(buckets[keep[np.argsort(-far[keep], kind="stable")][: params.most_features]])


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, params: NnPuParams = NnPuParams(), buckets: np.ndarray | None = None) -> Model:
    """The nnPU risk minimiser over rows of distinct features, of which `buckets` count if they are given.

    Without positives, the prior is the score of every text.
    """
    prior = float(np.clip(prior, 1e-4, 0.9))
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.empty(0, np.int32), np.empty(0), bias)
    buckets = choose_features(positive, unlabelled, params) if buckets is None else buckets
    p, u, d = _Rows(positive, buckets), _Rows(unlabelled, buckets), len(buckets)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = bias
    for step in range(1, params.epochs + 1):
        zp, zu = p.dot(w[:d]) + w[d], u.dot(w[:d]) + w[d]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        # logistic loss: l(z) = log(1 + exp(-z)); its slope for z is s - 1, for -z it is s
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu = prior * (sp - 1) / p.n, -prior * sp / p.n, su / u.n
        if negative_risk >= 0:
            gp, gz = gp_plus + gp_minus, gu
        else:  # the unlabelled part overfits: step back along its gradient only
            gp, gz = -gp_minus, -gu
        grad = np.append(p.back(gp, d) + u.back(gz, d), gp.sum() + gz.sum())
        grad[:d] += params.ridge * w[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(buckets, w[:d], float(w[d]))


def train_toxicity(docs: DataFrame, labels: DataFrame, params: NnPuParams = NnPuParams(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on rows that are not held out: at most most_positive toxic and most_unlabelled other texts.

    The class prior is the share of toxic rows among all labelled rows that may be learned
    from. The ids of the bounded sample are broadcast; document frequencies and the choice
    of at most most_features buckets are Spark's. The driver gets these and, for each text of
    the sample, which of them it holds.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out("_id") & F.col("toxic").isNotNull())
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.05
    toxic = sample_ids(known.where("toxic = 1").select("_id"), params.most_positive)
    others = docs.select(F.col(id_col).alias("_id")).where(~held_out("_id") & F.col("_id").isNotNull())
    # the unlabelled are drawn from all texts, confirmed ones included: the prior is that of this whole
    sides = toxic.withColumn("_p", F.lit(True)).withColumn("_u", F.lit(False)).unionByName(sample_ids(others, params.most_unlabelled).withColumn("_p", F.lit(False)).withColumn("_u", F.lit(True)))
    wanted = sides.groupBy("_id").agg(F.bool_or("_p").alias("_p"), F.bool_or("_u").alias("_u"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(wanted), "_id").select("_p", "_u", "_t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            f = pa.array(list(text_features(part.column("_t").to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("_p"), part.column("_u"), f], names=["p", "u", "f"])

    sample = staged(rows.mapInArrow(features, "p boolean, u boolean, f array<int>"))
    n_p, n_u = (int(x or 0) for x in sample.agg(F.count_if("p"), F.count_if("u")).first())
    if not n_p or not n_u:
        return fit_nnpu([], [], prior, params)
    counts = sample.select("p", "u", F.explode("f").alias("bucket")).groupBy("bucket").agg(F.count_if("p").alias("df"), F.count_if("u").alias("df_u"))
    far = F.abs(gap(F.col("df") / n_p, F.col("df_u") / n_u, n_p, F.sqrt))
    best = counts.withColumn("far", far).where((F.col("df") >= params.least_df) & (F.col("far") > 3)).orderBy(F.desc("far"), "bucket").limit(params.most_features)
    buckets = np.sort(np.array([r["bucket"] for r in best.collect()], np.int32))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "f"):
            f = [np.intersect1d(np.array(x, np.int32), buckets).tobytes() for x in part.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("p"), part.column("u"), pa.array(f, pa.binary())], names=["p", "u", "f"])

    got = sorted(tuple(r) for r in sample.mapInArrow(chosen, "p boolean, u boolean, f binary").collect())
    positive, unlabelled = ([np.frombuffer(f, np.int32) for *side, f in got if side[k]] for k in (0, 1))
    return fit_nnpu(positive, unlabelled, prior, params, buckets)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from 0.5). Null and empty texts have the score of no words;
    ids of any type, null and repeated ones pass through; each row is scored alone, from its whole text only."""

    def scores(texts: list[str]) -> list:
        score = np.array([model.score(x) for x in text_features(texts)])
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype("int32"))]

    out = per_text(docs, id_col, text_col, "score double, predicted int", scores)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose whole text scores below 0.5."""
    score = text_udf("double", lambda texts: [model.score(x) for x in text_features(texts)], pa.float64())
    return docs.where(score(text_of(text_col)) < 0.5)
