"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few figures of its form; quantile edges turn these into bins. Cyclic
boosting visits one feature at a time, fits a shallow tree over its bins to the logistic
gradient and adds the tree to the feature's lookup table. The pairs that explain most of
what is left get two-dimensional tables in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import held_out, per_text, sample_ids, shingle_hashes, slices, text_of, word_hashes

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "high", "point", "quote", "bang", "bar", "mark", "bracket", "slash_at", "other",
    "distinct_words", "top_word", "repeat_next", "distinct_pairs", "log_lines", "distinct_lines", "line_bytes", "upper_start", "letters_in_words",
]
#: Byte classes: upper, lower, digit, white space, high, then kinds of punctuation.
_KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\v\f\r", "", ".,;:?", "'\"`", "!", "|", "#$%&*^~", "()[]{}<>", "/\\@=+-_"]
_CLASS = np.full(256, len(_KINDS), np.uint8)
_CLASS[128:] = 4
for _k, _letters in enumerate(_KINDS):
    _CLASS[[ord(c) for c in _letters]] = _k


def text_figures(texts) -> np.ndarray:
    """One row of FEATURES for each text; an empty text is a row of zeros."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (text, words) in enumerate(zip(texts, word_hashes(texts), strict=True)):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(raw):
            continue
        c = np.bincount(_CLASS[raw], minlength=len(_KINDS) + 1) / len(raw)
        n = len(words)
        lines = text.split("\n")
        row = [np.log1p(len(raw)), np.log1p(n), (1 - c[3]) * len(raw) / max(1, n), c[0], c[2], c[3], c[4], *c[5:]]
        if n:
            distinct, times = np.unique(words, return_counts=True)
            pairs = shingle_hashes(words, 2)
            row += [len(distinct) / n, times.max() / n, np.mean(words[1:] == words[:-1]) if n > 1 else 0.0, len(np.unique(pairs)) / len(pairs)]
        else:
            row += [0.0] * 4
        space = _CLASS[raw] == 3
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        upper_start = np.mean(_CLASS[raw[first]] == 0) if len(first) else 0.0
        row += [np.log1p(len(lines)), len(set(lines)) / len(lines), len(raw) / len(lines) / 100, upper_start, c[0] + c[1] + c[4]]
        out[i] = row
    return out


@dataclass
class GamParams:
    """Bounds and settings of the fit; most_rows is the bound of the labelled sample."""

    most_rows: int = 20000
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 10
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.15
    ridge: float = 3.0


@dataclass
class Gam:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best gain and place of one cut of ordered bins; (0, 0) if none gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < 1e-9) | (hr < 1e-9)] = 0
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Leaf values, spread over the bins, of a tree grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max(((*_split(g[a:b], h[a:b], ridge), i) for i, (a, b) in enumerate(parts)), key=lambda x: (x[0], -x[2]))
        if gain <= 0:
            break
        a, b = parts.pop(k)
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of one cut along an axis and one cut along the other on each side."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    base = g.sum() ** 2 / (h.sum() + ridge)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            value, gain = np.zeros_like(gg), -base
            for a, b in ((0, cut), (cut, len(gg))):
                gs, hs = gg[a:b].sum(0), hh[a:b].sum(0)
                _, at = _split(gs, hs, ridge)
                for lo, hi in ((0, at), (at, len(gs))) if at else ((0, len(gs)),):
                    s, t = gs[lo:hi].sum(), hs[lo:hi].sum()
                    value[a:b, lo:hi] = -s / (t + ridge)
                    gain += s * s / (t + ridge)
            if gain > best[0]:
                best = (float(gain), value.T if turned else value)
    return best


def fit_gam(x: np.ndarray, y: np.ndarray, params: GamParams = GamParams()) -> Gam:
    """Additive terms by cyclic boosting, then the strongest pairs on top. One class only, or no row: a constant."""
    n = len(y)
    rate = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3)) if n else 0.5
    model = Gam(float(np.log(rate / (1 - rate))))
    if not n or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_quantile_edges(x[:, j], params.bins) for j in range(d)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(params.rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = params.rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), params.ridge)
            table += step
            z += step[at[j]]
    model.pair_edges = [_quantile_edges(x[:, j], params.pair_bins) for j in range(d)]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cell[a] * wide[b] + cell[b], v, wide[a] * wide[b]).reshape(wide[a], wide[b])

    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), params.ridge)[0], a, b) for a, b in combinations(range(d), 2)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(a, b) for gain, a, b in ranked[: params.pairs] if gain > 0]
    model.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in model.pairs]
    for _ in range(params.pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = params.rate * _pair_tree(grid(a, b, g), grid(a, b, h), params.ridge)[1]
            table += step
            z += step[cell[a], cell[b]]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, params: GamParams = GamParams(), id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fits on at most most_rows labelled rows that are not held out; repeated labels of an id count as their largest."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(~held_out("_id") & F.col("quality").isNotNull() & F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    wanted = sample_ids(known.select("_id"), params.most_rows)
    wanted = known.join(F.broadcast(wanted), "_id")
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(wanted), "_id").select("_y", "_t")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            f = pa.array([r.tobytes() for r in text_figures(part.column("_t").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("_y"), f], names=["y", "f"])

    got = sorted(tuple(r) for r in rows.mapInArrow(figures, "y int, f binary").collect())  # one row of FEATURES for each of the sample
    x = np.array([np.frombuffer(f) for _, f in got]).reshape(len(got), len(FEATURES))
    return fit_gam(x, np.array([y for y, _ in got], float), params)


def score_quality(docs: DataFrame, model: Gam, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from threshold). Null text counts as empty (all figures zero);
    ids of any type, null and repeated ones pass through; each row is scored alone, from its whole text only."""

    def scores(texts: list[str]) -> list:
        score = model.score(text_figures(texts))
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype("int32"))]

    out = per_text(docs, id_col, text_col, "score double, predicted int", scores)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
