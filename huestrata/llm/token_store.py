"""A content-addressed store of token ids.

Layout under one folder:
  chunks/   digest, width, payload: every distinct chunk once (little-endian ids, 2 or 4 bytes each)
  recipes/  doc_id, row, part, local_start, n_tokens, digests, root: documents in ascending id order
  manifest/ part, n_docs, n_tokens, root: one Merkle root for the documents of each part

A rolling hash over the ids cuts each document into chunks, so equal passages give equal
chunks wherever they stand. Chunks are addressed by their 128-bit BLAKE2b digest; a
document's root is the Merkle root of its chunks' digests, a part's that of its documents'.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.llm.bpe import _BEYOND_LATIN, WordBpe
from huestrata.llm.common import drop_path, mix, slices, staged, staging_dir, text_of

#: Ids that the rolling hash sees; chunk sizes in ids: least, mean above that (two to the power MEAN_BITS), most.
WINDOW, LEAST, MEAN_BITS, MOST = 16, 128, 10, 8192


# --- ids ----------------------------------------------------------------------------------


#: What Arrow parts words at and the tokenizer does not.
_ALSO_SPACE = "[\x1c-\x1f]"


class LibraryWords(WordBpe):
    """Ids from the tokenizers library's model, asked once for each distinct pre-token that a worker meets.

    No pre-token goes across white space, so the ids of a text are those of its words between
    white space, one after another. Words are parted and counted as Arrow columns; Python sees
    each distinct word of a batch once, and all of them together, as lines of one text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self._tokenize = Tokenizer.from_file(path).model.tokenize

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        """The library's model knows its merges."""

    def encode_word(self, word: str) -> list[int]:
        return [t.id for t in self._tokenize(word)]

    def _entry(self, word: str) -> bytes:
        return b"" if word == "\n" else super()._entry(word)

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of Latin words without white space one after another, and how many each has."""
        tokens = self.latin_line_words("\n".join(words).lower())
        raws = list(map(self.store.__getitem__, tokens))
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        line = np.cumsum(np.fromiter(map("\n".__eq__, tokens), bool, len(tokens)))
        return np.frombuffer(b"".join(raws), "<u4"), np.bincount(line, size, len(words)).astype(np.int64)

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words without white space, and for each word where its ids begin among them and how many there are."""
        kinds: tuple[list[int], list[int]] = [], []  # Latin, and others or with the sign of a special token
        for i, word in enumerate(words):
            kinds["<|" in word or not (word.isascii() or not (_BEYOND_LATIN.search(word) or _BEYOND_LATIN.search(word.lower())))].append(i)
        first, size, flat, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.empty(0, "<u4")], 0
        for kind, chosen in enumerate(kinds):
            if not chosen:
                continue
            if kind:
                raws = [np.frombuffer(self.encode_bytes(words[i]), "<u4") for i in chosen]
                ids, many = np.concatenate(raws), np.array([len(r) for r in raws], np.int64)
            else:
                ids, many = self._lines([words[i] for i in chosen])
            size[chosen], first[chosen] = many, at + np.cumsum(many) - many
            flat.append(ids)
            at += len(ids)
        return np.concatenate(flat), first, size

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if pc.any(pc.match_substring_regex(texts, _ALSO_SPACE)).as_py():
            raws = [self.encode_bytes(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(raws), "<u4"), np.array([len(r) // 4 for r in raws], np.int64)
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, first, size = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        many = size[at]
        ends = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(first[at] - ends[:-1], many) + np.arange(ends[-1])]
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))).astype(np.int64)
        return ids, np.diff(ends[words])


@lru_cache(2)
def library_words(path: str) -> LibraryWords:
    return LibraryWords(path)


# --- chunks -------------------------------------------------------------------------------


_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_table = [np.empty(0, np.uint64)]


def _letters(largest: int) -> np.ndarray:
    """A random 64-bit number for each id up to the largest."""
    if len(_table[0]) <= largest:
        _table[0] = mix(np.arange(max(1 << 16, largest + 1), dtype=np.uint64) + np.uint64(1))
    return _table[0]


def _marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids allows a cut."""
    sums = np.cumsum(_letters(int(ids.max()))[ids])
    rolled = sums.copy()
    rolled[WINDOW:] -= sums[:-WINDOW]
    return np.flatnonzero((rolled * _SPREAD) >> np.uint64(64 - MEAN_BITS) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids: at marks, unless a chunk would be too short or too long."""
    out, at = [], 0
    for mark in marks:
        while mark - at > MOST:
            at += MOST
            out.append(at)
        if mark - at >= LEAST and mark < n:
            at = mark
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n] if n else []


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream; a pure function of the ids, each cut decided by the WINDOW ids before it."""
    return _ends([m for m in _marks(ids).tolist() if m >= LEAST], len(ids)) if len(ids) else []


def cut_streams(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """cut_points() of many streams that lie one after another: a mark from LEAST on sees its own stream only, as LEAST exceeds WINDOW."""
    marks = _marks(ids) if len(ids) else np.empty(0, np.int64)
    at = np.searchsorted(marks, bounds[:-1] + LEAST), np.searchsorted(marks, bounds[1:], "right")
    return [_ends((marks[a:b] - start).tolist(), n) for a, b, start, n in zip(*at, bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True)]


def pack(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def unpack(width: int, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}").astype("<u4")


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def _node(mark: bytes, value: bytes) -> bytes:
    return hashlib.blake2b(mark + value, digest_size=16).digest()


class Merkle:
    """Root of a binary tree over leaves that come in order; leaves and inner nodes are hashed apart, an odd node moves up.

    Only one node for each height is held, however many leaves there are.
    """

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, _node(b"\0", leaf)
        while self.nodes and self.nodes[-1][0] == height:
            height, node = height + 1, _node(b"\1", self.nodes.pop()[1] + node)
        self.nodes.append((height, node))

    def root(self) -> bytes:
        if not self.nodes:
            return _node(b"", b"")
        out = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            out = _node(b"\1", left + out)
        return out


def merkle_root(leaves: list[bytes]) -> bytes:
    if len(leaves) == 1:
        return _node(b"\0", leaves[0])
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


# --- CRC of joined parts ------------------------------------------------------------------

_POLY = 0xEDB88320


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bits reflected, element by element."""
    out, b, one = np.zeros(len(b), np.uint32), b.copy(), np.uint32(1)
    for bit in range(31, -1, -1):
        out ^= b * (a >> np.uint32(bit) & one)
        b = b >> one ^ np.uint32(_POLY) * (b & one)
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x to the powers 8 n modulo the CRC-32 polynomial."""
    n, out, square = n_bytes.astype(np.int64) * 8, np.full(len(n_bytes), 1 << 31, np.uint32), np.array([1 << 30], np.uint32)
    while n.any():
        odd = np.flatnonzero(n & 1)
        out[odd] = _multiply(np.repeat(square, len(odd)), out[odd])
        square, n = _multiply(square, square), n >> 1
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings from those of their parts: string i has the parts bounds[i]..bounds[i + 1], of `sizes` bytes.

    The CRC of a join is the exclusive or of the parts' CRCs, each shifted by the bytes after it.
    """
    if not len(crcs):
        return np.zeros(len(bounds) - 1, np.uint32)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    after = np.repeat(ends[bounds[1:]], np.diff(bounds)) - ends[1:]
    moved = np.bitwise_xor.accumulate(_multiply(_shift(after), crcs.astype(np.uint32)))
    total = np.concatenate(([np.uint32(0)], moved))
    return total[bounds[1:]] ^ total[bounds[:-1]]


# --- writing ------------------------------------------------------------------------------

_STREAM = "n_tokens long, digests array<binary>, root binary, widths array<int>, payloads array<binary>"


#: Texts that are encoded and cut together: more than elsewhere, so that fewer distinct words come up.
_ROWS = 8192

Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _streams(rows: DataFrame, encode: Encoder, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=_ROWS):
            ids, many = encode(batch.column("_t"))
            every = np.insert(ids, np.cumsum(many), end_id).astype("<u4", copy=False)
            bounds = np.concatenate(([0], np.cumsum(many + 1)))
            joined = every.tobytes()
            narrow = int(every.max()) < 1 << 16
            short = every.astype("<u2").tobytes() if narrow else b""
            digests, roots, widths, payloads = [], [], [], []
            for start, cuts in zip(bounds[:-1].tolist(), cut_streams(every, bounds), strict=True):
                mine, wide, packed, at = [], [], {}, start
                for cut in cuts:
                    a, at = at, start + cut
                    digest = hashlib.blake2b(joined[4 * a : 4 * at], digest_size=16).digest()
                    mine.append(digest)
                    if digest not in packed:
                        width, payload = (2, short[2 * a : 2 * at]) if narrow else pack(every[a:at])
                        wide.append(width)
                        packed[digest] = digest + payload
                digests.append(mine)
                roots.append(merkle_root(mine))
                widths.append(wide)
                payloads.append(list(packed.values()))
            lists = [pa.array(np.diff(bounds)), pa.array(digests, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(widths, pa.list_(pa.int32())), pa.array(payloads, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "n_tokens", "digests", "root", "widths", "payloads"])

    return rows.mapInArrow(run, f"doc_id {_kind(rows)}, {_STREAM}")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def write_store(docs: DataFrame, path: str, encode: Encoder, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text, ends it with end_id, and writes the store.

    encode gives the ids of a column of texts one after another, and how many each has. Null
    text counts as empty (only the end id). Document ids may be of any type with an order; null ids come first;
    rows that repeat an id are kept, next to each other. Other columns are ignored. An empty
    table gives a store without rows. Chunks are pre-aggregated per map task
    before their one shuffle, so a chunk that fills the corpus reaches a reducer a few times.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    scratch = staging_dir(spark)
    streams = staged(_streams(rows, encode, end_id), scratch, compression="snappy")

    # a digest stands for one payload, so distinct rows are distinct chunks; they are hashed, not sorted
    pieces = streams.select(F.explode(F.arrays_zip("widths", "payloads")).alias("c"))
    pieces = pieces.select(F.substring("c.payloads", 1, 16).alias("digest"), F.col("c.widths").alias("width"), F.expr("substring(c.payloads, 17)").alias("payload"))
    pieces.distinct().write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = streams.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_tokens", "digests", "root")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = recipes.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ends = np.cumsum(batch.column("n_tokens").to_numpy()) + before
            start = pa.array(np.concatenate(([before], ends[:-1]))[: len(ends)].astype(np.int64))
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), start, *(batch.column(c) for c in names[4:])], names=names)

    names = ["doc_id", "row", "part", "local_start", "n_tokens", "digests", "root"]
    recipes.mapInArrow(number, f"doc_id {_kind(recipes)}, row long, part int, local_start long, n_tokens long, digests array<binary>, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(spark, scratch)

    _manifests(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _manifests(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root of recipes as they are read."""
    parts = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.select("part", "doc_id", "row", "n_tokens", "root")
    in_parts = ordered.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "row")

    def manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # part, documents, tokens, tree

        def row() -> pa.RecordBatch:
            part, n, tokens, tree = held
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

        for batch in batches:
            for part, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                if not held or held[0] != part:
                    if held:
                        yield row()
                    held = [part, 0, 0, Merkle()]
                held[1] += 1
                held[2] += n
                held[3].add(root)
        if held:
            yield row()

    return in_parts.mapInArrow(manifests, "part int, n_docs long, n_tokens long, root binary")


# --- reading ------------------------------------------------------------------------------


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids array<int>: the id streams put together again from recipes and chunks."""
    entries = spark.read.parquet(f"{path}/recipes").select("doc_id", "row", F.posexplode_outer("digests").alias("at", "digest"))
    parts = entries.join(spark.read.parquet(f"{path}/chunks"), "digest", "left").select("doc_id", "row", "at", "width", "payload")
    parts = parts.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "width", "payload"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(p["width"], p["payload"]) for p in x.as_py()]).astype("int32") for x in batch.column("parts")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return parts.mapInArrow(join, f"doc_id {_kind(parts)}, ids array<int>")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified.

    Every stored chunk is unpacked once, checked against its address and reduced to its
    length and CRC; recipes then join these few bytes instead of the ids, and the CRC of a
    document follows from those of its chunks in order. verified: each chunk is there and
    matches its address, lengths and Merkle root agree with the recipe, and the count, tokens
    and root of the recipes of its part agree with the manifest. A part that the manifest
    names and that has no recipe left is an error, for no row could say so.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, n, crc, ok = batch.column("digest").to_pylist(), [], [], []
            for digest, width, payload in zip(digests, batch.column("width").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                raw = unpack(width, payload).tobytes()
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                ok.append(hashlib.blake2b(raw, digest_size=16).digest() == digest)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], names=["digest", "n", "crc", "ok"])

    facts = spark.read.parquet(f"{path}/chunks").mapInArrow(check, "digest binary, n long, crc long, ok boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    entries = recipes.select("row", "part", "doc_id", "local_start", "n_tokens", "root", F.posexplode_outer("digests").alias("at", "digest"))
    found = entries.join(facts, "digest", "left")
    whole = found.groupBy("row", "part", "doc_id", "local_start", "n_tokens", "root").agg(F.collect_list(F.struct("at", "digest", "n", "crc", "ok")).alias("parts"))

    # one row for each part of the store: as many as shuffle partitions
    kept = {r["part"]: tuple(r) for r in spark.read.parquet(f"{path}/manifest").collect()}
    read = {r["part"]: tuple(r) for r in _manifests(recipes).collect()}
    if lost := sorted(kept.keys() - read.keys()):
        raise ValueError(f"parts {lost} of the manifest have no recipes in {path}")
    intact = {part for part, facts_of in read.items() if kept.get(part) == facts_of}
    before, starts = 0, {}
    for part in sorted(read):
        starts[part], before = before, before + kept.get(part, read[part])[2]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            parts, bounds = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), np.diff(bounds))
            order = np.lexsort((parts.field("at").to_numpy(zero_copy_only=False), owner))
            whole = parts.field("ok").fill_null(False).to_numpy(zero_copy_only=False)[order]
            ns, crcs = (parts.field(f).fill_null(0).to_numpy(zero_copy_only=False)[order] for f in ("n", "crc"))
            n = np.bincount(owner, ns, len(lists)).astype(np.int64)
            broken = np.bincount(owner, ~whole, len(lists)) > 0
            crc = joined_crcs(crcs, 4 * ns, bounds).astype(np.int64)
            digests = parts.field("digest").take(pa.array(order)).to_pylist()
            rooted = np.array([merkle_root(digests[a:b]) == r for a, b, r in zip(bounds, bounds[1:], batch.column("root").to_pylist(), strict=False)], bool)
            start = np.array([starts[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("local_start").to_numpy()
            in_order = np.array([p in intact for p in batch.column("part").to_pylist()], bool)
            good = in_order & ~broken & rooted & (n == batch.column("n_tokens").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (start, n, crc, good))], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return whole.mapInArrow(combine, f"doc_id {_kind(whole)}, start long, n_tokens long, ids_crc32 long, verified boolean")
