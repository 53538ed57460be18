"""Benchmark decontamination: bigram seeds, then Smith-Waterman alignment.

An alignment that matches m words of an item in r unbroken runs scores at most m - (r - 1),
and m - r bigrams of the item are intact in it. So a score of s needs s - 1 intact bigrams,
whatever was edited. Every bigram of the test items is counted over the whole corpus; of the
bigrams of an item that occur at all, all but the s - 2 most common are seeds, one of which
is then in every alignment of score s. Where a seed is found and enough bigrams of the item
are around it, the stretch is aligned with the item; the alignment's score, as a share of
the item's length, decides. No alignment that would be accepted is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from huestrata.llm.common import APART, shingle_hashes, slices, staged, text_of, text_udf, word_hashes


@dataclass
class Params:
    """Match +1, mismatch and gap -1 a word.

    A text is contaminated by an item if the best local alignment scores at least `least`
    times the item's words, and no less than ngram words or the whole of a shorter item.
    Bigrams are counted in one pass over the corpus, whatever the size of the benchmark.
    For aligning, test items are handled in blocks of about block_bytes of text, so what is
    broadcast is bounded; each block costs one more pass.
    """

    ngram: int = 3
    least: float = 0.4
    block_bytes: int = 16_000_000


#: Words of a seed; an item of a single word is its own seed.
_SEED = 2
#: Bits of the filter that tells which bigrams of the corpus may be of a test item.
_FILTER_BITS = 27
#: Places of seeds in a text that are looked at together, and the words of a stretch that are aligned at once.
_HITS, _STRETCH = 1 << 20, 1 << 16


class Items:
    """One block of test items: words, bigrams and, once counts are known, seeds."""

    def __init__(self, ids: list, texts: list[str], params: Params):
        self.ids, self.words = [], []
        for i, words in zip(ids, word_hashes(texts, APART), strict=True):
            if len(words):
                self.ids.append(i)
                self.words.append(words)
        self.size = np.array([len(w) for w in self.words], np.int64)
        #: the least score that is accepted, and the least number of bigrams intact in such an alignment
        self.least = np.maximum(np.ceil(params.least * self.size - 1e-9).astype(np.int64), np.minimum(params.ngram, self.size))
        self.intact = self.least - np.minimum(_SEED, self.size) + 1
        self.grams = [shingle_hashes(w, _SEED) for w in self.words]
        #: widths of seeds
        self.widths = sorted({min(_SEED, len(w)) for w in self.words})
        self.known = np.unique(np.concatenate([*self.grams, np.empty(0, np.uint64)]))
        self.sets = [np.unique(g) for g in self.grams]

    def doc_grams(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        return [(w, shingle_hashes(words, w)) for w in self.widths if len(words) >= w]

    def choose_seeds(self, df: np.ndarray) -> None:
        """df: for each known bigram, the number of texts that hold it."""
        seeds, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, grams in enumerate(self.grams):
            rarity = df[np.searchsorted(self.known, grams)]
            order = np.lexsort((grams, rarity))
            order = order[rarity[order] > 0]
            chosen = order[: max(0, len(order) - int(self.intact[k]) + 1)]
            seeds.append(grams[chosen])
            item.append(np.full(len(chosen), k))
            at.append(chosen)
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        self.seed, first = np.unique(seed[order], return_index=True)
        self.seed_from = np.append(first, len(seed))
        self.seed_item, self.seed_at = np.concatenate(item)[order], np.concatenate(at)[order]

    def windows(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the stretches of a text to align, overlapping ones of an item joined.

        Very long stretches come in pieces that overlap by more than an accepted alignment can span.
        """
        out: list[tuple[int, int, int]] = []
        if not len(self.seed):
            return out
        for width, grams in self.doc_grams(words):
            at = np.searchsorted(self.seed, grams)
            at[at == len(self.seed)] = 0
            place = np.flatnonzero(self.seed[at] == grams)
            if not len(place):
                continue
            begin = self.seed_from[at[place]]
            many = self.seed_from[at[place] + 1] - begin
            cuts = np.unique(np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), _HITS)))
            found = [self._stretches(p, f, n, len(words)) for p, f, n in zip(*(np.split(x, cuts[cuts > 0]) for x in (place, begin, many)), strict=True)]
            k, a, b = _joined(*(np.concatenate(x) for x in zip(*found, strict=True)), len(words)) if len(found) > 1 else found[0]
            for i, lo, hi in zip(k.tolist(), a.tolist(), b.tolist(), strict=True):
                have, near = self.sets[i], grams[lo : hi - width + 1]
                if len(near) >= self.intact[i]:
                    known = np.searchsorted(have, near)
                    known[known == len(have)] = 0
                    if np.count_nonzero(have[known] == near) >= self.intact[i]:
                        span = int(2 * self.size[i] - self.least[i])
                        step = max(_STRETCH, 4 * span)
                        while hi - lo > step:
                            out.append((i, lo, lo + step))
                            lo += step - span
                        out.append((i, lo, hi))
        return sorted(out)

    def _stretches(self, place: np.ndarray, begin: np.ndarray, many: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, starts and ends of the stretches around seeds at some places of a text of n words, joined."""
        hit = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        k = self.seed_item[hit]
        # an accepted alignment has no more gaps than this, so it lies within
        slack = self.size[k] - self.least[k]
        start = np.repeat(place, many) - self.seed_at[hit]
        return _joined(k, np.maximum(start - slack, 0), np.minimum(start + self.size[k] + slack, n), n)


def _joined(k: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (item, start, end) of a text of n words, those of an item that overlap or touch made one."""
    order = np.lexsort((a, k))
    k, a, b = k[order], a[order], b[order]
    apart = k * (n + 1)
    reach = np.maximum.accumulate(b + apart)
    first = np.flatnonzero(np.append(True, (a + apart)[1:] > reach[:-1]))
    last = np.append(first[1:], len(k)) - 1
    return k[first], a[first], reach[last] - apart[last]


#: Cells of alignment tables that are filled at once.
_CELLS = 1 << 20


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words for many (item, stretch) pairs: best scores and where in the stretch they end."""
    score, end = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        width = len(pairs[order[at]][1])
        to = at
        while to < len(order) and (to - at + 1) * (width := max(width, len(pairs[order[to]][1]))) <= _CELLS:
            to += 1
        to = max(to, at + 1)
        part = order[at:to]
        at = to
        width = max(len(pairs[i][1]) for i in part)
        height = max(len(pairs[i][0]) for i in part)
        item = np.zeros((len(part), height), np.uint64)
        text = np.ones((len(part), width), np.uint64)
        for r, i in enumerate(part):
            item[r, : len(pairs[i][0])] = pairs[i][0]
            text[r, : len(pairs[i][1])] = pairs[i][1]
        columns = np.arange(1, width + 1, dtype=np.int32)
        above = np.zeros((len(part), width + 1), np.int32)
        best, where = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for j in range(height):
            row = np.where(text == item[:, j : j + 1], above[:, :-1] + 1, above[:, :-1] - 1)
            np.maximum(row, above[:, 1:] - 1, out=row)
            np.maximum(row, 0, out=row)
            # gaps in the item: the running maximum of score + place, less the place
            row = np.maximum.accumulate(row + columns, axis=1) - columns
            above[:, 1:] = row
            top = row.max(1)
            better = top > best
            where[better] = row[better].argmax(1) + 1
            best[better] = top[better]
        score[part], end[part] = best, where
    return score, end


def _blocks(bench: DataFrame, params: Params, item_col: str, text_col: str) -> Iterator[Items]:
    rows = bench.select(F.col(item_col).alias("_i"), text_of(text_col).alias("_t"))
    total = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n = max(1, math.ceil(total / params.block_bytes))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(n)) == b).collect()
        got.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        items = Items([r[0] for r in got], [r[1] for r in got], params)
        if items.ids:
            yield items


def contaminated(docs: DataFrame, bench: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs id, item_id, score, word_end: each text and each test item it holds a copy of, edited or not.

    score is the alignment's share of the item's words, word_end the word of the text where
    the best alignment ends. Words are runs of letters and digits, A-Z in lower case. Null
    and empty texts and items match nothing; an item of no more than ngram words must be
    there whole. Rows with a null or repeated id are compared like others. Nothing is shuffled but
    the counts of the test items' own bigrams.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    id_kind, item_kind = rows.schema["_id"].dataType, bench.schema[item_col].dataType
    schema = f"`{id_col}` {id_kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, score double, word_end long"
    out = None
    for items in _seeded(rows, bench, params, item_col, item_text_col):
        pairs = rows.mapInArrow(_aligner(items, to_arrow_type(item_kind), [id_col, item_col, "score", "word_end"]), schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else spark.createDataFrame([], schema)


def _seeded(rows: DataFrame, bench: DataFrame, params: Params, item_col: str, item_text_col: str) -> Iterator[Items]:
    """Blocks of test items with their seeds chosen; the corpus is read once for all counts."""
    marks = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    widths: set[int] = set()
    n = 0
    for items in _blocks(bench, params, item_col, item_text_col):
        at = items.known >> np.uint64(64 - _FILTER_BITS)
        np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        widths.update(items.widths)
        n += 1
    if not n:
        return
    counts = rows.select("_t").mapInArrow(_counter(marks, sorted(widths)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = staged(counts) if n > 1 else counts
    for items in _blocks(bench, params, item_col, item_text_col):
        own = rows.sparkSession.createDataFrame(pa.table({"gram": items.known.view(np.int64), "place": np.arange(len(items.known))}))
        df = np.zeros(len(items.known), np.int64)
        for place, c in counts.join(F.broadcast(own), "gram").select("place", "n").collect():  # a row for each bigram of the block at most
            df[place] = c
        items.choose_seeds(df)
        yield items


def _counter(marks: np.ndarray, widths: list[int]):
    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, back = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return grams, np.bincount(back, np.concatenate([n for _, n in held]), len(grams)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in slices(batches):
            found = []
            for words in word_hashes(part.column("_t").to_pylist(), APART):
                for w in widths:
                    if len(words) >= w:
                        grams = shingle_hashes(words, w)
                        at = grams >> np.uint64(64 - _FILTER_BITS)
                        found.append(np.unique(grams[marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]))
            grams, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            held.append((grams, n))
            if sum(len(g) for g, _ in held) > _HITS:
                held = [merged(held)]
                if len(held[0][0]) > _HITS // 2:
                    yield _counts(*held.pop())
        if held:
            yield _counts(*merged(held))

    return count


def _counts(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _aligned(items: Items, texts: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (score, word where the alignment ends), for the alignments that score enough."""
    keys, pairs, best = [], [], {}
    for i, words in enumerate(word_hashes(texts, APART)):
        for k, a, b in items.windows(words):
            keys.append((i, k, a))
            pairs.append((items.words[k], words[a:b].copy()))
    for (i, k, a), s, e in zip(keys, *align(pairs), strict=True):
        if s >= items.least[k] and s > best.get((i, k), (0,))[0]:
            best[i, k] = (int(s), a + int(e))
    return best


def _aligner(items: Items, item_kind: pa.DataType, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            best = _aligned(items, part.column("_t").to_pylist())
            ids = part.column("_id").take(pa.array([i for i, _ in best], pa.int64()))
            item = pa.array([items.ids[k] for _, k in best], item_kind)
            score = pa.array([s / len(items.words[k]) for (_, k), (s, _) in best.items()], pa.float64())
            yield pa.RecordBatch.from_arrays([ids, item, score, pa.array([e for _, e in best.values()], pa.int64())], names=names)

    return run


def drop_contaminated(docs: DataFrame, bench: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold a copy of no test item. Each whole text is checked on its own, without a shuffle."""
    rows = docs.select(text_of(text_col).alias("_t"))
    for items in _seeded(rows, bench, params, "item_id", "text"):
        docs = docs.where(~_holds(items)(text_of(text_col)))
    return docs


def _holds(items: Items):
    def holds(texts: list[str]) -> list[bool]:
        found = {i for i, _ in _aligned(items, texts)}
        return [i in found for i in range(len(texts))]

    return text_udf("boolean", holds, pa.bool_())
