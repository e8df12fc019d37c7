"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k least distinct 64-bit hashes of a text's shingles of five words (of
one to four words: the whole sequence). Sketches merge: the sketch of several parts is the
k least hashes of their sketches. From two sketches follow estimates of resemblance, of
containment and of distinct shingles, exact while the parts have fewer than k in all. A
sketch travels as a string, base64 of its hashes, ascending, little-endian.

`compared` puts every document beside the next one. Documents are dealt by ranges of
doc_id, so that a document and the next one meet in a task; the first document of a range
goes to the range before it as well. Texts are shuffled once, compressed; ranges come from
quantiles of doc_id over all rows.

Edge cases: a null text is an empty one; a text without words has an empty sketch, which is
like another empty one (1) and like no other (0); documents of the same doc_id go in order
of a hash of their texts; documents without one come last, in that order; a single
document is its own next one; an empty table gives an empty result; other columns go.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frames, hash_words, rows_of, slices, window_hashes

#: Hashes of a sketch, and words of a shingle.
K, WORDS = 128, 5
_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, distinct double"
_FULL = float(2**64)


def _least(h: np.ndarray, row: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distinct hashes of each of n rows, and each row's first."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    first = np.searchsorted(row, np.arange(n + 1))
    low = np.arange(len(h)) - first[row] < k
    return h[low], np.searchsorted(row[low], np.arange(n + 1))


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of texts, one after the other, and where each begins."""
    own, first = hash_words(texts)
    count, parts = np.diff(first), []
    for size in range(1, words + 1):
        # shorter sequences are one shingle as a whole
        if size == words or (count == size).any():
            h, row, _ = window_hashes(own, first, size)
            whole = count[row] >= words if size == words else count[row] == size
            parts.append((h[whole], row[whole]))
    h, row = (np.concatenate(x) for x in zip(*parts))
    return _least(h, row, len(texts), k)


def _distinct(h: np.ndarray, size: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Estimated distinct shingles of sketches of given sizes whose last hash stands at `last`."""
    top = h[np.maximum(last, 0)].astype(np.float64) if len(h) else np.zeros(len(size))
    return np.where(size < k, size, (k - 1) * _FULL / np.maximum(top, 1.0))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of sketches: resemblance, the share of a's shingles in b, a's distinct shingles."""
    n = len(a[1]) - 1
    row = np.concatenate([np.repeat(np.arange(n), np.diff(x[1])) for x in (a, b)])
    h = np.concatenate([a[0], b[0]])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    twice = np.append(np.diff(at), len(h) - at[-1] if len(at) else []) == 2
    h, row = h[at], row[at]
    first = np.searchsorted(row, np.arange(n + 1))
    low = np.arange(len(h)) - first[row] < k
    size = np.bincount(row[low], minlength=n)
    both = np.bincount(row[low & twice], minlength=n)
    near = np.where(size > 0, both / np.maximum(size, 1), 1.0)
    own = np.diff(a[1])
    in_a = _distinct(a[0], own, a[1][1:] - 1, k)
    union = _distinct(h, size, first[:-1] + size - 1, k)
    return near, np.where(in_a > 0, np.minimum(near * union / np.maximum(in_a, 1), 1.0), 1.0), in_a.astype(np.float64)


def encoded(sketch: tuple[np.ndarray, np.ndarray]) -> list[str]:
    h, first = sketch
    return [base64.b64encode(h[a:b].astype("<u8").tobytes()).decode() for a, b in zip(first, first[1:])]


def decoded(strings: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    own = [np.frombuffer(base64.b64decode(s or ""), "<u8").astype(np.uint64) for s in strings]
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.cumsum([0, *map(len, own)])


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, fingerprint) of whole texts, without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded(sketches(batch.column(1), k)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint, distinct): sketches merged by a column, null being a value of its own.

    Tasks merge what they hold before the shuffle, and what arrives in order of the key, a
    batch at a time, so a key with very many rows needs no more than one sketch of memory.
    """
    kind = prints.schema[key].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            h, first = np.concatenate([np.zeros(0, np.uint64), *held.values()]), np.cumsum([0, *map(len, held.values())])
            distinct = _distinct(h, np.diff(first), first[1:] - 1, k)
            return pa.RecordBatch.from_arrays([pa.array(list(held), schema.field(0).type), pa.array(encoded((h, first)), pa.string()), pa.array(distinct, pa.float64())], ["key", "fingerprint", "distinct"])

        schema = None
        for batch in batches:
            schema = batch.schema
            keys = batch.column(0).to_pylist()
            h, first = decoded(batch.column(1).to_pylist())
            number = {x: i for i, x in enumerate(dict.fromkeys(keys))}
            row = np.repeat([number[x] for x in keys], np.diff(first)).astype(np.int64)
            h, first = _least(h, row, len(number), k)
            for x, i in number.items():
                old = held.get(x, np.zeros(0, np.uint64))
                held[x] = np.unique(np.append(old, h[first[i] : first[i + 1]]))[:k]
            if len(held) > 4096:
                # keys that are done go first: in order of the key, all but the last one
                last = keys[-1]
                kept = held.pop(last)
                yield out()
                held = {last: kept}
        if held:
            yield out()

    schema = f"key {kind}, fingerprint string, distinct double"
    partial = prints.select(F.col(key).alias("key"), "fingerprint").mapInArrow(merge, schema).select("key", "fingerprint")
    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema).withColumnRenamed("key", key)


def _part(ids: pa.Array, h: np.ndarray, edges: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's range in descending order, its place there, and which have no id."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = len(edges) - np.searchsorted(edges, own, "left")
    # without an id: equal shares of the hash's values
    lost = (h.view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(2**64 // parts + 1)
    return np.where(null, len(edges) + 1 + lost.astype(np.int64), part), np.where(null, h, ~own), null


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness, and that to the next document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [1.0], 100 * parts).alias("e")).first()["e"]
    edges = np.unique(np.asarray(cut or [], np.int64))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            part, place, _ = _part(batch.column(0), batch.column(1).to_numpy(), edges, parts)
            for p in np.unique(part).tolist():
                least[p] = min(least.get(p, 2**63 - 1), int(place[part == p].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], ["part", "place"])

    # texts are read for a hash only where there is no id
    keys = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("h"))
    # one row a range
    first = {r["part"]: r["place"] for r in keys.mapInArrow(heads, "part long, place long").groupBy("part").agg(F.min("place").alias("place")).collect()}
    ranges = sorted(first)
    before = dict(zip(ranges, [*ranges[-1:], *ranges[:-1]]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = batch.column(2).to_numpy()
            part, place, _ = _part(batch.column(0), h, edges, parts)
            head = np.flatnonzero([first[p] == x for p, x in zip(part.tolist(), place.tolist())])
            at = np.append(np.arange(len(part)), head)
            to = np.append(part, [before[p] for p in part[head].tolist()]).astype(np.int64)
            z = frames(batch.column(1)).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.arange(len(at)) >= len(part)), pa.array(place[at]), pa.array(h[at]), batch.column(0).take(pa.array(at)), z], ["part", "head", "place", "h", "doc_id", "z"])

    dealt = docs.withColumn("h", F.xxhash64("text")).mapInArrow(deal, "part long, head boolean, place long, h long, doc_id long, z binary")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "head", "place", "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def out(ids: list, texts: list[str], then: str) -> pa.RecordBatch:
            after = [*texts[1:], then]
            edited = [t[: len(t) - len(t) // 2] + y[: len(t) // 2] for t, y in zip(texts, after)]
            h, at = sketches(pa.array([*texts, then], pa.string()), k)
            own, following = (h[: at[-2]], at[:-1]), (h[at[1] :], at[1:] - at[1])
            other = sketches(pa.array(edited, pa.string()), k)
            near, inside, distinct = likeness(own, other, k)
            columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], encoded(own), encoded(other), near, likeness(own, following, k)[0], inside, distinct]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _ROWS.split(", ")])

        ids, texts, size, now, done = [], [], 0, None, False
        for batch in rows_of(batches, 256):
            for part, head, doc_id, z in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if part != now:
                    ids, texts, size, now, done = [], [], 0, part, False
                if done:
                    continue
                text = unpack.decompress(z).decode()
                if head or size > 1 << 20:
                    yield out(ids, texts, text)
                    ids, texts, size, done = [], [], 0, head
                if not head:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(z)

    return dealt.mapInArrow(compare, _ROWS)
