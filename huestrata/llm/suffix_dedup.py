"""Removal of long repeated byte strings by blockwise suffix sorting.

A string of `length` bytes that starts at two places shares, at both, the same anchor: the
place of the smallest hash among its `gram`-byte substrings. So suffixes fall into buckets
by their anchor, and only a suffix whose bucket has company can start a repeated string.

Buckets are sorted one block at a time. Every suffix of a bucket is aligned at the anchor,
so sample offsets every STEP bytes from the anchor cover all of them (a difference cover of
one residue). Ranks of the samples, `length - STEP` bytes deep, are computed first by
doubling; two suffixes then compare by at most STEP bytes and one rank, however long they
agree. Memory is that of one block of contexts.

A bucket beyond `block` contexts is dealt into blocks at random. Within each, repeats are
found as above; the first suffix of every class goes on to a next round, where buckets have
longer common cores (up to the whole string), so that no group is ever in one task. In the
last round a bucket is one string, and grouping on its bytes counts it.

Copies of a text give the same contexts; these are grouped, with a count, before anything is
sorted, so a text that fills the corpus is one row of a bucket.

A passage of many short words may have fewer bytes than `length`. Passages of `words` words that
stand in another document as well go the same way, words in place of bytes: anchors are the
least hashes of `seed` words, a context has the hashes of all its passages, and those of a
bucket are sorted. The last bit of an anchor's hash says which of the two it is of.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import AS_WRITTEN, mix, shingle_hashes, slices, staged, text_of, word_hashes

STEP = 8
_PLACE = np.uint64(26)
_SEGMENT = 4 << 20
_GROUP = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: list[np.ndarray] = []


@dataclass(frozen=True)
class Params:
    """length: bytes of a string that counts as repeated; gram: bytes of an anchor; block: contexts sorted together;
    words: words of a passage that is looked for in other documents; seed: words of its anchor."""

    length: int = 400
    gram: int = 64
    block: int = 16384
    words: int = 51
    seed: int = 8

    @property
    def reach(self) -> int:
        """Largest distance from the start of a string to its anchor."""
        return self.length - self.gram

    def cells(self, level: int) -> list[tuple[int, int]]:
        """Parts of the distances 0..reach at a level: all, eighths, sixty-fourths, single ones."""
        n = self.reach + 1
        k = min(n, 8**level) if level < 3 else n
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


LAST_LEVEL = 3


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[:1] = down[:1] = 1
        _tables[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _tables[0], _tables[1]


@dataclass
class Runs:
    """Strings with one anchor that start next to each other: text index, first and last start, anchor, hash of its gram (odd: of words)."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray


def anchor_runs(texts: list[bytes] | list[np.ndarray], params: Params) -> Iterator[Runs]:
    """The runs of many texts, bytes or hashes of words, a few texts at a time; places count from the start of each text."""
    group: list[tuple[int, int, bytes | np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        length = params.length if isinstance(text, bytes) else params.words
        if len(text) < length:
            continue
        for base in range(0, max(1, len(text) - length + 1), _SEGMENT):
            piece = text[base : base + _SEGMENT + length - 1]
            if group and size + len(piece) > _GROUP:
                yield _runs(group, params)
                group, size = [], 0
            group.append((i, base, piece))
            size += len(piece)
    if group:
        yield _runs(group, params)


def _runs(group: list[tuple[int, int, bytes | np.ndarray]], params: Params) -> Runs:
    if of_words := not isinstance(group[0][2], bytes):
        length, q = params.words, params.seed
        hashes = shingle_hashes(np.concatenate([x[2] for x in group]), q)
        n = len(hashes) + q - 1
    else:
        raw = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        n, length, q = len(raw), params.length, params.gram
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[q:] - sums[:-q]) * down[: n - q + 1])
    w = length - q + 1
    packed = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
    # sliding minimum over w places: minima from both ends of blocks of w
    blocks = -(-len(packed) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    grid = padded.reshape(blocks, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    low = np.minimum(tail[:starts], head[w - 1 : w - 1 + starts])
    anchor = (low & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)

    ends = np.cumsum([len(x[2]) for x in group])
    begins = ends - [len(x[2]) for x in group]
    owner = np.repeat(np.arange(len(group)), [len(x[2]) for x in group])[:starts]
    valid = np.arange(starts) + length <= ends[owner]
    change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1]))))
    stop = np.append(change[1:], starts)
    good = valid[change]
    change, stop = change[good], stop[good]
    at, own = anchor[change], owner[change]
    shift = np.array([x[1] for x in group])[own] - begins[own]
    return Runs(np.array([x[0] for x in group])[own], change + shift, stop - 1 + shift, at + shift, (hashes[at] >> np.uint64(1) << np.uint64(1) | np.uint64(of_words)).view(np.int64))


def contexts(raw: bytes, runs: list[tuple[int, int, int, int]], tail: int, unit: int = 1) -> list[tuple[int, int, int, list[int], bytes]]:
    """(gram, nearest, furthest, anchors, bytes) for the runs (first, last, anchor, gram) of one text.

    nearest and furthest are distances from a start to the anchor; bytes are those of all
    strings of the run, tail bytes from the last start on. A start is `unit` bytes of raw. Runs that
    agree in all of this become one with several anchors.
    """
    out: dict[tuple, list[int]] = {}
    for first, last, anchor, gram in runs:
        key = (gram, anchor - last, anchor - first, raw[first * unit : last * unit + tail])
        out.setdefault(key, []).append(anchor)
    return [(g, near, far, places, part) for (g, near, far, part), places in out.items()]


# --- sorting a block ----------------------------------------------------------------------


def _classes(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by one key or, through their pairing, two dense ones."""
    key = keys[0] if len(keys) == 1 else keys[0].astype(np.int64) * (int(keys[1].max()) + 1) + keys[1]
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def sort_block(parts: list[bytes], near: np.ndarray, far: np.ndarray, many: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of a block are repeated, and which are the first of their class.

    Row i has the bytes parts[i] of its strings at distances near[i]..far[i]; many[i] says
    that the row stands for several places. Both results are rows x distances.
    """
    m, reach, length = len(parts), params.reach, params.length
    width = -(-(reach + length) // STEP) * STEP
    rows = np.zeros((m, width), np.uint8)
    for i, part in enumerate(parts):
        a = reach - far[i]
        rows[i, a : a + len(part)] = np.frombuffer(part, np.uint8)
    words = rows.view(np.uint64)
    deep = (length - STEP) // STEP  # words that a sample's rank covers
    samples = range(0, reach // STEP + 1)
    level = [_classes(words[:, c]) for c in range(words.shape[1])]
    size = 1
    while size * 2 <= deep:
        level = [_classes(level[c], level[c + size]) for c in range(len(level) - size)]
        size *= 2
    ranks = {c: level[c] if size == deep else _classes(level[c], level[c + deep - size]) for c in samples if c + deep - size < len(level)}
    del level

    repeated = np.zeros((m, reach + 1), bool)
    first = np.zeros((m, reach + 1), bool)
    for s in range(reach + 1):
        idx = np.flatnonzero((near <= s) & (s <= far))
        if not len(idx):
            continue
        at = reach - s
        sample = -(-at // STEP)
        head = sample * STEP - at
        rest = np.concatenate([rows[idx, at : at + head], rows[idx, sample * STEP + length - STEP : at + length]], axis=1)
        rest = np.ascontiguousarray(rest).view(np.uint64).ravel()
        rank = ranks[sample][idx]
        order = np.lexsort((rest, rank))
        same = (rank[order][1:] == rank[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        again = np.zeros(len(idx), bool)
        again[1:] |= same
        again[:-1] |= same
        begins = np.concatenate(([True], ~same))
        repeated[idx[order], s] = again | many[idx[order]]
        first[idx[order], s] = begins
    return repeated, first


def shared_passages(parts: list[bytes], keys: np.ndarray, texts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, repeated, goes on) for each passage of a block, row by row as parts[i] has their hashes.

    A passage is repeated if another text has it within the same bucket, or if many[i] says that its text
    has copies. Of a class in several texts two go on, of two texts; of a class in one text all do.
    """
    row = np.repeat(np.arange(len(parts)), [len(p) // STEP for p in parts])
    hashes = np.frombuffer(b"".join(parts), np.uint64)
    order = np.lexsort((texts[row], hashes, keys[row]))
    h, k, t = hashes[order], keys[row][order], texts[row][order]
    begins = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
    label = np.cumsum(begins) - 1
    ends = np.append(begins[1:], True)
    shared = t[begins] != t[ends]
    repeated, on = np.empty(len(row), bool), np.empty(len(row), bool)
    repeated[order] = shared[label] | many[row[order]]
    on[order] = begins | ends | ~shared[label]
    return row, repeated, on


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of half-open spans; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


# --- DataFrames ---------------------------------------------------------------------------

_ENTRY = "key long, n long, gram long, digest binary, near int, far int, anchors array<int>, part binary, copies long"
_FIELDS = [
    ("key", pa.int64()), ("n", pa.int64()), ("gram", pa.int64()), ("digest", pa.binary()), ("near", pa.int32()),
    ("far", pa.int32()), ("anchors", pa.list_(pa.int32())), ("part", pa.binary()), ("copies", pa.int64()),
]
_ENTRY_NAMES = [name for name, _ in _FIELDS]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _words_of(texts: pa.Array) -> list[np.ndarray]:
    return list(word_hashes(texts.to_pylist(), letters=AS_WRITTEN))


def _anchors(rows: DataFrame, params: Params, passages: bool) -> DataFrame:
    """gram, doc (64-bit text key), c: the anchors of each text and how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            docs = part.column("_d").to_numpy()
            texts = part.column("_t")
            for r in chain(anchor_runs(_bytes_of(texts), params), anchor_runs(_words_of(texts), params) if passages else ()):
                order = np.lexsort((r.gram, r.text))
                text, gram = r.text[order], r.gram[order]
                first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(docs[text[first]]), pa.array(np.diff(np.append(first, len(text))))], names=["gram", "doc", "c"])

    return rows.mapInArrow(run, "gram long, doc long, c long")


def _contexts(rows: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """Entries of the first level for the wanted (doc, grams, counts) of each text; copies of a text that come together are one entry."""
    # another key than the one `wanted` is grouped by: its rows are dealt anew, and Spark can split the copies of a text over tasks
    joined = rows.withColumn("_n", F.bitwise_not("_d")).join(wanted.withColumn("_n", F.bitwise_not("doc")), "_n").select("_t", "grams", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            every = [hashlib.md5(r).digest() for r in _bytes_of(batch.column("_t"))]
            copies, place = Counter(every), {d: i for i, d in enumerate(every)}
            digests, batch = list(place), batch.take(pa.array(list(place.values()), pa.int64()))
            raws = _bytes_of(batch.column("_t"))
            known = [dict(zip(g, n, strict=True)) for g, n in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            with_words = [i for i, grams in enumerate(known) if any(g & 1 for g in grams)]
            words = _words_of(batch.column("_t").take(pa.array(with_words, pa.int64())))
            for of_words, r in chain(((False, r) for r in anchor_runs(raws, params)), ((True, r) for r in anchor_runs(words, params))):
                out = []
                cut = np.flatnonzero(np.concatenate(([True], r.text[1:] != r.text[:-1], [True])))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    k = int(r.text[a])
                    i = with_words[k] if of_words else k
                    runs = [x for x in zip(*(v[a:b].tolist() for v in (r.first, r.last, r.anchor, r.gram)), strict=True) if x[3] in known[i]]
                    # of words, a context has the hash of the passage at each start
                    found = contexts(shingle_hashes(words[k], params.words).tobytes(), runs, STEP, STEP) if of_words else contexts(raws[i], runs, params.length)
                    out += [(gram, known[i][gram], gram, digests[i], near, far, places, part, copies[digests[i]]) for gram, near, far, places, part in found]
                yield _batch(out, _FIELDS)

    return joined.mapInArrow(run, _ENTRY)


_FOUND_FIELDS = [("digest", pa.binary()), ("spans", pa.list_(pa.int64())), ("passages", pa.list_(pa.int64())), *(("digest2" if name == "digest" else name, kind) for name, kind in _FIELDS)]
_FOUND = "digest binary, spans array<long>, passages array<long>, " + _ENTRY.replace("digest binary", "digest2 binary")


def _sorted_blocks(entries: DataFrame, params: Params, level: int) -> DataFrame:
    """Spans found (digest, spans or passages as starts and ends in turn) and, from blocks of larger buckets, entries of the next level."""
    block, parts_n = params.block, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("digest", "anchors", "near"), F.ceil(F.col("n") / F.lit(block)).cast("long"))
    dealt = entries.withColumn("salt", F.when(F.col("n") > block, salt).otherwise(F.lit(0).cast("long"))).repartition(parts_n, "key", "salt")
    if level == 0:  # what is left of copies, without another shuffle
        dealt = dealt.groupBy("salt", *_ENTRY_NAMES[:-1]).agg(F.sum("copies").alias("copies"))
    dealt = dealt.sortWithinPartitions("key", "salt")
    cells = params.cells(level + 1) if level < LAST_LEVEL else []

    def sort(held: pa.Table) -> Iterator[pa.RecordBatch]:
        of_words = pc.equal(pc.bit_wise_and(held.column("gram"), 1), 1)
        if (part := held.filter(pc.invert(of_words))).num_rows:
            yield from sort_bytes(part)
        if (part := held.filter(of_words)).num_rows:
            yield from sort_words(part)

    def sort_words(held: pa.Table) -> Iterator[pa.RecordBatch]:
        near, far, n, key = (held.column(c).to_numpy() for c in ("near", "far", "n", "key"))
        parts, digests, anchors, grams, copies = (held.column(c).to_pylist() for c in ("part", "digest", "anchors", "gram", "copies"))
        texts = held.column("digest").combine_chunks().dictionary_encode().indices.to_numpy()
        row, repeated, on = shared_passages(parts, key, texts, held.column("copies").to_numpy() > 1)
        if level == LAST_LEVEL:  # only passages of several texts come so far
            repeated[:] = True
        ends = np.cumsum(np.bincount(row, minlength=len(parts)))
        out = []
        for i, end in enumerate(ends.tolist()):
            at = slice(end - (far[i] - near[i] + 1), end)  # starts in ascending order: the furthest from the anchor is the first
            if repeated[at].any():
                spans = merge_spans([(p - far[i] + a, p - far[i] + b + params.words) for a, b in _stretches(repeated[at]) for p in anchors[i]])
                out.append((digests[i], None, [x for span in spans for x in span], *[None] * len(_FIELDS)))
            if n[i] > block and level < LAST_LEVEL:
                for a in np.flatnonzero(on[at]).tolist():
                    part, away = parts[i][a * STEP : (a + 1) * STEP], int(far[i]) - a
                    again = int.from_bytes(hashlib.blake2b(part + f"{grams[i]}".encode(), digest_size=8).digest(), "big", signed=True)
                    out.append((None, None, None, again, 0, grams[i], digests[i], away, away, anchors[i], part, copies[i]))
            if len(out) >= 4096:
                yield _batch(out, _FOUND_FIELDS)
                out = []
        if out:
            yield _batch(out, _FOUND_FIELDS)

    def sort_bytes(held: pa.Table) -> Iterator[pa.RecordBatch]:
        near, far, n = (held.column(c).to_numpy() for c in ("near", "far", "n"))
        parts, digests, anchors, grams, copies = (held.column(c).to_pylist() for c in ("part", "digest", "anchors", "gram", "copies"))
        many = np.array([len(a) > 1 or c > 1 for a, c in zip(anchors, copies, strict=True)])
        if level == LAST_LEVEL:  # a row's part is one string, and n counts that string
            repeated = np.zeros((len(parts), params.reach + 1), bool)
            repeated[np.arange(len(parts)), near] = (n > 1) | many
            first = np.zeros_like(repeated)
        else:
            repeated, first = sort_block(parts, near, far, many, params)
        hot = n > block
        out = []
        for i in range(len(parts)):
            if repeated[i].any():
                spans = merge_spans([(at - b, at - a + params.length) for a, b in _stretches(repeated[i]) for at in anchors[i]])
                out.append((digests[i], [x for span in spans for x in span], None, *[None] * len(_FIELDS)))
            if hot[i]:
                for lo, hi in cells:
                    for a, b in _stretches(first[i, lo : hi + 1]):
                        a, b = a + lo, b + lo
                        core = parts[i][far[i] - lo : far[i] + params.length - hi]
                        key = int.from_bytes(hashlib.blake2b(core + f"{grams[i]},{lo}".encode(), digest_size=8).digest(), "big", signed=True)
                        out.append((None, None, None, key, 0, grams[i], digests[i], a, b, anchors[i], parts[i][far[i] - b : far[i] + params.length - a], copies[i]))
            if len(out) >= 4096:
                yield _batch(out, _FOUND_FIELDS)
                out = []
        if out:
            yield _batch(out, _FOUND_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in slices(batches, "part"):
            if rows + batch.num_rows > block and held:  # whole buckets only: the last one may go on in the next batch
                whole = pa.Table.from_batches([*held, batch]).combine_chunks()
                key, salt = (whole.column(c).to_numpy() for c in ("key", "salt"))
                last = len(key) - int(np.argmin(((key == key[-1]) & (salt == salt[-1]))[::-1])) if (key[0], salt[0]) != (key[-1], salt[-1]) else 0
                if last:
                    yield from sort(whole.slice(0, last))
                held, rows = whole.slice(last).to_batches(), whole.num_rows - last
            else:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield from sort(pa.Table.from_batches(held).combine_chunks())

    return dealt.select("key", "salt", *_ENTRY_NAMES[1:]).mapInArrow(run, _FOUND)


def repeated_spans(docs: DataFrame, params: Params = Params(), text_col: str = "text", passages: bool = False) -> DataFrame:
    """digest (MD5 of a text), spans (array of long: starts and ends in turn) of its repeated bytes, not yet merged across rows.

    If asked for, also passages, likewise, counted in words: those of params.words words that stand in another row's text
    too. A row has spans or passages, the other is null.
    """
    least = min(params.length, 2 * params.words - 1) if passages else params.length
    rows = docs.select(text_of(text_col).alias("_t")).where(F.octet_length("_t") >= least).select(F.xxhash64("_t").alias("_d"), "_t")
    # of a text with copies, `places` counts all of them, c one
    anchors = staged(_anchors(rows, params, passages).groupBy("gram", "doc").agg(F.sum("c").alias("places"), F.max("c").alias("c")))
    shared = anchors.groupBy("gram").agg(F.sum("places").alias("places"), F.sum("c").alias("n")).where("places > 1").select("gram", "n")
    wanted = anchors.select("gram", "doc").join(shared, "gram")
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "n")).alias("w")).select("doc", F.col("w.gram").alias("grams"), F.col("w.n").alias("counts"))
    entries = _contexts(rows, wanted, params)
    out = None
    for level in range(LAST_LEVEL + 1):
        found = staged(_sorted_blocks(entries, params, level))
        spans = found.where("digest IS NOT NULL").select("digest", "spans", "passages")
        out = spans if out is None else out.unionByName(spans)
        more = found.where("digest IS NULL").drop("digest", "spans", "passages").withColumnRenamed("digest2", "digest")
        if level == LAST_LEVEL or more.isEmpty():
            break
        same = ["key", "part"] if level + 1 == LAST_LEVEL else ["key"]  # in the last round, strings of equal bytes
        text = F.xxhash64("digest")
        counts = more.groupBy(*same).agg(
            F.sum(F.size("anchors")).cast("long").alias("n"), F.max(F.col("gram").bitwiseAND(1)).alias("of_words"), (F.min(text) != F.max(text)).alias("texts")
        )
        entries = more.drop("n").join(counts.where("n > 1 AND (of_words = 0 OR texts)"), same).select(*_ENTRY_NAMES)
    return out


def remove_repeats(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, keep_text: bool = False, passages: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes that stay,
    or text and n_chars: what stays as a string (a character cut in two becomes U+FFFD) and its length in characters,
    and n_passage_words: words `[^\\x20\\x09-\\x0D]+` in passages of params.words words that stand in another row's text too,
    by hashes of 64 bits and whatever their bytes; of these nothing is removed.

    Every byte goes that lies in a string of params.length bytes which starts at another
    place as well, in the same text or another; strings are judged on the input, and never
    span texts. Null text counts as empty; a shorter text keeps all its bytes. Rows that
    repeat a text are copies of each other. Ids of any type, null and repeated ones pass
    through as they are; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    rows = rows.withColumn("_h", F.concat(F.lit("md5").cast("binary"), F.unhex(F.md5("_t"))))
    spans = repeated_spans(docs, params, text_col, passages)
    spans = spans.distinct().groupBy("digest").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "passages")))
    # again a key of its own, so that the copies of a text can be split
    spans = spans.select(F.concat(F.lit("md5").cast("binary"), "digest").alias("_h"), "spans", "passages")
    joined = rows.join(spans, "_h", "left").select("_id", "_t", "spans", "passages")
    kind = rows.schema["_id"].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary())] * keep_bytes + [("text", pa.string()), ("n_chars", pa.int64())] * keep_text + [("n_passage_words", pa.int64())] * passages
    names = [id_col, *(name for name, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("spans", "passages"))
            for raw, *found in zip(_bytes_of(batch.column("_t")), *columns, strict=True):
                merged, shared = (merge_spans(list(zip(x[::2], x[1::2], strict=True))) if x else [] for x in found)
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), *[left] * keep_bytes)
                if keep_text:
                    row += ((text := left.decode("utf-8", "replace")), len(text))
                out.append((*row, sum(b - a for a, b in shared)) if passages else row)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *_batch(out, fields).columns], names=names)

    ddl = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary", "text": "string", "n_chars": "long", "n_passage_words": "long"}
    return joined.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{name} {ddl[name]}" for name in names[1:])]))
