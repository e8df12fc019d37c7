"""Helpers that the corpus operators share: table access, batch slicing, word hashing."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space of the word contracts (0x20, 0x09-0x0D).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
#: Bytes outside letters, digits and non-ASCII.
MARKS = np.ones(256, bool)
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = MARKS[128:] = False
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
#: Folders of checkpoints that are still there, in the order they were made.
_KEPT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True for documents whose crc32 of the id as text leaves remainder 1 by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows; sizes the fine ranges of a shuffle."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` holds about `limit` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def rows_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most n rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array, nulls as empty, and the int64 offsets of its rows."""
    array = pc.fill_null(array, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, _U(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words between bytes of a class, and each row's first word."""
    solid = np.ones(len(data) + 2, bool)
    solid[1:-1] = ~between[data]
    solid[0] = solid[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(array: pa.Array, lower: bool = False, between: np.ndarray = _IS_SPACE, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string array, and each row's first word.

    Rows are taken in parts of about `part` bytes, as the work needs 50 times as much.
    """
    data, offsets = utf8(array)
    words, firsts, row, total = [], [np.zeros(1, np.int64)], 0, 0
    while row < len(offsets) - 1:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part, "right")) - 1)
        own, first = _hash_part(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], lower, between)
        words.append(own)
        firsts.append(first[1:] + total)
        row, total = to, total + len(own)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(firsts)


def _hash_part(data: np.ndarray, offsets: np.ndarray, lower: bool, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets, between)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    if lower:
        data = _LOWER[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BASE_INVERSE, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), first


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, base: int = 0xA24BAED4963EE407) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words inside one row, their row, and their start in it."""
    n = len(words) - size + 1
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(size):
        acc *= _U(base)
        acc += words[j : j + n]
    inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
    at = rows[inside]
    return mix(acc[inside]), at, inside - first[at]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def keep(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    kept = df.checkpoint()
    _KEPT.append(kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return kept


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that nobody holds any more; their checkpoints stay.

    Spark's cleaner follows the collector, which may not run for long while the heap is large.
    """
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on, the session's Arrow batches have at most so many rows.

    A batch of whole texts lies outside the heap, in each of a task's two or three steps in
    Python; ten thousand texts, Spark's default, are tens of MB each time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


@contextmanager
def transient(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is kept inside is deleted at the end, but for what goes through the function that this gives.

    Results that still read what was kept inside must be written, or go through it, before the end.
    """
    before, stays = len(_KEPT), set()

    def stay(df: DataFrame) -> DataFrame:
        kept = keep(df)
        stays.add(_KEPT[-1])
        return kept

    try:
        yield stay
    finally:
        for path in [p for p in _KEPT[before:] if p not in stays]:
            _KEPT.remove(path)
            delete(spark, path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until no column, whatever its case, has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _recode(df: DataFrame, make, to) -> DataFrame:
    """`df` with its text column put through `make`, a function for batches of values."""
    fields = [T.StructField(f.name, to) if f.name == "text" else f for f in df.schema.fields]
    k = df.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            columns[k] = make(columns[k])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(rows, T.StructType(fields))


def frames(texts: pa.Array) -> pa.Array:
    """Texts as zstd frames."""
    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else pack.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def zipped(df: DataFrame) -> DataFrame:
    """All columns, with texts as zstd frames, so that a shuffle of texts is less than half as large."""
    return _recode(df, frames, T.BinaryType())


def unzipped(df: DataFrame) -> DataFrame:
    """The texts of `zipped` again."""

    def make(frames: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor()
        return pa.array([None if z is None else unpack.decompress(z) for z in frames.to_pylist()], pa.binary()).cast(pa.string())

    return _recode(df, make, T.StringType())


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): the texts as zstd frames."""
    return zipped(docs.select("doc_id", "text")).withColumnRenamed("text", "z")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the least node.

    Alternates large and small stars: each node hands its larger (then smaller)
    neighbours the least node it knows. Minima combine in the tasks before a shuffle and
    come back by an equi-join, so a node with very many links is no single group.
    """
    edges = keep(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
