"""Shared pieces of the training-data operators: staging, row streams, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a worker turns into Python objects at once: rows and bytes of text, but one text at least.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case: name, with underscores if need be."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- rows through Arrow -------------------------------------------------------------------


def bounds(texts: pa.Array, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, bytes or lists of numbers, of at most `rows` of them and SLICE_BYTES bytes; a longer text is a range of its own."""
    sizes = pc.multiply(pc.list_value_length(texts), 8) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = min(max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), at + 1), at + rows, len(texts))
        yield at, to
        at = to


def slices(batches: Iterable[pa.RecordBatch], column: str = "_t", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, few texts at a time. In the end Arrow gives back what it keeps for later, as the worker goes on to other tasks."""
    for batch in batches:
        for a, b in bounds(batch.column(column), rows):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def per_text(docs: DataFrame, id_col: str, text_col: str, fields: str, compute: Callable[[list[str]], list]) -> DataFrame:
    """One row per input row: its id, handed over as Arrow holds it, and the fields (DDL) that compute(texts) gives as columns.

    The id may be of any type; nulls and values beyond 2^53 stay what they are.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = compute(part.column("_t").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {fields}")


def text_udf(kind: str, compute: Callable[[list[str]], list], arrow_type: pa.DataType) -> Callable[[Column], Column]:
    """A column function of a text column: compute() gets few texts at a time and gives a value for each."""

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        out = [pa.array(compute(texts.slice(a, b - a).to_pylist()), arrow_type) for a, b in bounds(texts)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out) if out else pa.array([], arrow_type)

    return apply


# --- staged tables ------------------------------------------------------------------------


#: Folders of this process that staging_dir() has named.
_stages: list[str] = []


def staging_dir(spark: SparkSession) -> str:
    """A new folder under the shared spark.checkpoint.dir. Only a local master may leave that unset: there is one machine then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints/huestrata"
    _stages.append(f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}")
    return _stages[-1]


def clear_stages(spark: SparkSession) -> None:
    """Deletes all staged tables of this process. Call it when no DataFrame that reads them is needed any more."""
    while _stages:
        drop_path(spark, _stages.pop())


def staged(df: DataFrame, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Cuts lineage with a written table in the shared folder; survives lost executors."""
    path = path or staging_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- words and shingles -------------------------------------------------------------------

_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
#: Letters as they are, for word_hashes().
AS_WRITTEN = np.arange(256, dtype=np.uint64) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, _BLOCK + 1)
        one = np.ones(size, np.uint64)
        fwd, back = one.copy(), one.copy()
        fwd[1:], back[1:] = _BASE, _INV
        _powers[:] = [np.multiply.accumulate(fwd), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


#: White space and every other ASCII byte that is no letter or digit.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _hash_block(raw: np.ndarray, apart: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in one block of bytes."""
    edge = np.diff(np.concatenate(([True], apart[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    fwd, back = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * fwd[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Iterable[str | None], apart: np.ndarray = _SPACE, letters: np.ndarray = _LOWER) -> Iterator[np.ndarray]:
    """The 64-bit hash of each word of each text, in order. Long texts go block by block.

    Words are runs of bytes other than `apart` (which must hold the ASCII white space), A-Z in
    lower case unless `letters` are AS_WRITTEN.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > _BLOCK:
            yield from _hash_group(group, apart, letters)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from _hash_group(group, apart, letters)


def _hash_group(group: list[bytes], apart: np.ndarray, letters: np.ndarray) -> Iterator[np.ndarray]:
    if len(group) == 1 and len(group[0]) > _BLOCK:
        raw, at, out = np.frombuffer(group[0], np.uint8), 0, []
        while at < len(raw):
            end = min(len(raw), at + _BLOCK)
            while end < len(raw) and not apart[raw[end]]:
                gap = np.flatnonzero(apart[raw[end : end + _BLOCK]])
                end = end + int(gap[0]) if len(gap) else min(len(raw), end + _BLOCK)
            out.append(_hash_block(raw[at:end], apart, letters)[1])
            at = end
        yield np.concatenate(out)
        return
    starts, hashes = _hash_block(np.frombuffer(b"\n".join(group), np.uint8), apart, letters)
    bounds = np.cumsum([0] + [len(x) + 1 for x in group])
    cut = np.searchsorted(starts, bounds)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield hashes[a:b]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The hash of each run of `size` words; a shorter text is one run; no words, none."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    h = words[: n - width + 1].copy()
    for k in range(1, width):
        h = h * _STEP + words[k : n - width + 1 + k]
    return mix(h + np.uint64(width))


# --- learning -----------------------------------------------------------------------------


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from every learner: the CRC-32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample_ids(ids: DataFrame, n: int) -> DataFrame:
    """At most n distinct ids, the same ones at every run, whatever the order of the rows."""
    return ids.distinct().orderBy(F.xxhash64("_id"), "_id").limit(n)
