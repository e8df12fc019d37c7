"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased, so that punctuation and case do
not hide a copy. A seed is a run of words of a test item that is rare: at most `RARE`
documents and `RARE_ITEMS` items hold it, however large the tables are. Each place of an item takes the shortest of `LENGTHS` words from there on that is rare.
The longest of them always are seeds, however many documents hold them, and so is the
item as a whole where it is a document as a whole. So an item made of common short runs
finds nothing by them, an item that was copied everywhere is found by its long runs, and
items of fewer words than a seed are found in documents that are equal to them.

Seeds join documents and items. Wherever a document holds a seed, the words around that
diagonal are aligned with the item: as far as the item is long to either side, at most
`BAND` words. For items longer than that, diagonals with seeds that lie no further apart than
the item's length, so that one alignment may lead from one to the other, are one band from
the least to the largest; words inserted between seeds widen it, however many they are. A plain
copy has one diagonal, so its work is linear in the item's length. The score is the best
local alignment over that of the item with itself. A pair counts from a share of the item (`score`) or from a passage of
`passage` equal words, whatever the item's length. Passages are scored more strictly: a
word that differs or is missing costs `STRICT`, as much as two equal words give, so long
chance alignments of common words do not add up (at most one word in three may differ).

Scale: documents are read twice, once to count seeds and once for their hits, whatever
the size of the benchmark. A Bloom filter of all seeds, of at most `FILTER_BYTES`, keeps
nearly all windows out of the exact joins on the seed's hash; what passes is shuffled.
Only documents with a hit travel with their text, once for each `ITEM_BYTES` of their
candidate items' texts, so that no row holds more. Sides of joins are broadcast under
`SMALL_ROWS` rows, which are counted, else both sides are shuffled.

Edge cases: null or empty texts match nothing; an item without words matches nothing;
equal items with ids of their own each match, repeated rows of the benchmark count once;
a passage that stands in a document several times gives one row with its best place;
repeated documents, and those without a doc_id, each give their rows; a very long text is
looked through whole; an empty benchmark or table changes nothing; other columns stay
(`clean`) or are ignored (`matches`). Seeds have their price: a copy that keeps no three
words in a row is not found, nor one with an edit in every 13 words whose shorter runs are
all common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, hash_words, keep, mix, slices, transient, unused

LENGTHS = (3, 5, 8, 13)
SCORE, PASSAGE, RARE, RARE_ITEMS = 0.5, 16, 100, 16
MATCH, MISMATCH, GAP, STRICT = 2, 1, 1, 4
#: Most words of a step of diagonals, and of the room on either side of a band.
BAND = 128
#: Bytes of items' texts that travel with a document.
ITEM_BYTES = 1 << 20
#: Cells of alignment rows computed at once.
CELLS = 1 << 18
#: Bits of the filter a seed, and the largest filter that is broadcast.
BITS, FILTER_BYTES = 128, 64 << 20
SMALL_ROWS = 200_000
_PART = 4096
_U = np.uint64


def all_windows(words: np.ndarray, first: np.ndarray, lengths=LENGTHS, gate: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hashes, row, start) of windows of each length, and of whole rows as length 0.

    With a gate, a filter that holds all windows of the items, longer windows are only
    looked at where the shortest one passes: nowhere else can they be an item's.
    """
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.diff(first)
    acc = np.zeros(max(len(words) - lengths[0] + 1, 0), _U)
    for j in range(lengths[0]):
        acc *= _U(0xA24BAED4963EE407)
        acc += words[j : j + len(acc)]
    at = np.flatnonzero(rows[: len(acc)] == rows[lengths[0] - 1 :]) if len(acc) else np.zeros(0, np.int64)
    h = mix(acc[at] + _U(lengths[0]))
    if gate is not None:
        passed = _passes(gate, h)
        at, h = at[passed], h[passed]
    yield lengths[0], h, rows[at], at - first[rows[at]]
    whole = np.flatnonzero((size > 0) & (size < lengths[0]))
    whole = np.union1d(whole, rows[at[at == first[rows[at]]]])
    acc = acc[at]
    for before, n in zip(lengths, lengths[1:]):
        inside = at + n <= first[rows[at] + 1]
        at, acc = at[inside], acc[inside]
        for j in range(before, n):
            acc = acc * _U(0xA24BAED4963EE407) + words[at + j]
        yield n, mix(acc + _U(n)), rows[at], at - first[rows[at]]
    if len(whole):
        own = np.repeat(whole, size[whole])
        place = np.arange(len(own)) - np.repeat(np.cumsum(size[whole]) - size[whole], size[whole])
        total = np.add.reduceat(mix(words[first[own] + place] + place.astype(_U) * _U(0x9E3779B97F4A7C15)), np.cumsum(size[whole]) - size[whole])
        yield 0, mix(total ^ size[whole].astype(_U)), whole, np.zeros(len(whole), np.int64)


def _masks(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and four bits of each hash."""
    bits = _U(1) << (h & _U(63))
    for k in (6, 12, 18):
        bits |= _U(1) << ((h >> _U(k)) & _U(63))
    return ((h >> _U(24)) % _U(blocks)).astype(np.int64), bits


def seed_filter(seeds: DataFrame, many: int) -> np.ndarray:
    """The Bloom filter over (hash) in blocks of 64 bits, put together from parts by range of blocks."""
    blocks = max(1, min(many * BITS, FILTER_BYTES * 8) // 64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = _masks(batch.column(0).to_numpy().view(_U), blocks)
            yield pa.RecordBatch.from_arrays([pa.array((at // _PART).astype(np.int32)), pa.array(at % _PART), pa.array(bits.view(np.int64))], ["part", "at", "bits"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at, bits = (c.to_numpy() for c in batch.columns)
            for k in np.unique(part):
                own = part == k
                np.bitwise_or.at(held.setdefault(int(k), np.zeros(_PART, _U)), at[own], bits[own].view(_U))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((-(-blocks // _PART), _PART), _U)
    packed = seeds.select("hash").mapInArrow(place, "part int, at long, bits long").repartition("part").mapInArrow(pack, "part int, bits binary")
    for r in packed.collect():
        out[r["part"]] = np.frombuffer(r["bits"], _U)
    return out.ravel()[:blocks]


def _passes(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, bits = _masks(h, len(filled))
    return np.flatnonzero(filled[at] & bits == bits)


def item_seeds(items: DataFrame, lengths=LENGTHS) -> DataFrame:
    """(hash, length, item, at, size): all windows of items (item, text), long before short."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, first = hash_words(batch.column(1), True, MARKS)
            ids, size = batch.column(0).to_numpy(), np.diff(first)
            for n, h, row, at in all_windows(words, first, lengths):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(ids[row]), pa.array(at.astype(np.int32)), pa.array(size[row].astype(np.int32))], ["hash", "length", "item", "at", "size"])

    return items.select("item", "text").mapInArrow(rows, "hash long, length int, item long, at int, size int")


def seed_counts(docs: DataFrame, filled: np.ndarray, lengths=LENGTHS) -> DataFrame:
    """(hash, docs): how many documents hold each window that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def told() -> pa.RecordBatch:
            h, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(of, np.concatenate([v for _, v in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "docs"])

        for batch in slices(batches):
            for n, h, row, _ in all_windows(*hash_words(batch.column(0), True, MARKS), lengths, shared.value):
                at = _passes(shared.value, h) if n else ()
                if len(at):
                    h, row = h[at], row[at]
                    order = np.lexsort((row, h))
                    h, row = h[order], row[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
                    held.append(np.unique(h[new], return_counts=True))
                    waiting += len(held[-1][0])
            if waiting > 1 << 20:
                yield told()
                held, waiting = [], 0
        if held:
            yield told()

    return docs.select("text").mapInArrow(count, "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs"))


def rare_seeds(docs: DataFrame, seeds: DataFrame, filled: np.ndarray, rare: int, lengths=LENGTHS) -> DataFrame:
    """The seeds (hash, item, at, size) that documents are searched for."""
    # kept, as the documents would be read for each of its two uses
    held = keep(seeds.groupBy("hash").agg(F.count_distinct("item").alias("items")).join(seed_counts(docs, filled, lengths), "hash"))
    known = seeds.where("length > 0").join(held, "hash")
    few = known.where((F.col("docs") <= rare) & (F.col("items") <= RARE_ITEMS))
    shortest = few.groupBy("item", "at", "size").agg(F.min(F.struct("length", "hash")).alias("s")).select("s.hash", "item", "at", "size")
    always = known.where(F.col("length") == max(lengths)).unionByName(seeds.where("length = 0"), allowMissingColumns=True)
    return shortest.unionByName(always.select("hash", "item", "at", "size")).distinct()


def align(a: np.ndarray, b: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of rows of a with rows of b, and where it ends in b."""
    room = np.full((len(b), a.shape[1] - 1), np.iinfo(np.uint64).max, np.uint64)
    best, end = align_band(a, np.concatenate([room, b, room], 1), mismatch, gap)
    return best, end - room.shape[1]


def align_band(a: np.ndarray, b: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """The same, in a band of diagonals.

    Row i of the band is b[i : i + width], with width such that the last one ends with b, so
    a diagonal keeps its column. A gap along b is a running maximum: whole rows are computed at once.
    """
    width = b.shape[1] - a.shape[1] + 1
    slope = gap * np.arange(width, dtype=np.int32)
    above = np.zeros((len(b), width + 1), np.int32)
    best, end = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
    for i in range(a.shape[1]):
        step = np.where(a[:, i : i + 1] == b[:, i : i + width], MATCH, -mismatch)
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - gap), 0)
        row = np.maximum.accumulate(row + slope, 1) - slope
        above[:, :-1] = row
        at = row.argmax(1)
        top = row[np.arange(len(row)), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at + i, end)
    return best, end


def diagonals(size: int, bands: list[int]) -> list[tuple[int, int]]:
    """(first diagonal, how many) to align an item of `size` words in, from the steps of diagonals with seeds."""
    step = min(size, BAND)
    if size <= BAND:
        return [(k * step - step, 3 * step) for k in bands]
    out, bands = [], sorted(bands)
    begin = bands[0]
    for k, after in zip(bands, [*bands[1:], None]):
        if after is None or (after - k) * step > size:
            out.append((begin * step - step, (k - begin + 3) * step))
            begin = after
    return out


def aligned(words: np.ndarray, items: list[np.ndarray], item: np.ndarray, begin: np.ndarray, width: np.ndarray, score: float, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, score, last word) of one document's best alignment with each item that counts.

    `item`, `begin` and `width` say which diagonals of which item to look at.
    """
    size = np.array([len(x) for x in items])[item]
    order = np.lexsort((size, width))
    item, begin, width, size = item[order], begin[order], width[order], size[order]
    out, at = [], 0
    while at < len(item):
        wide, long = (np.maximum.accumulate(x[at : at + 4096]) for x in (width, size))
        many = np.arange(1, len(wide) + 1)
        fit = (many * wide <= CELLS) & (many * (wide + long) <= 4 * CELLS)
        to = at + max(1, int(fit.sum()))
        own, m, first = item[at:to], size[at:to], begin[at:to]
        longest, widest = int(m.max()), int(width[to - 1])
        a = np.full((len(own), longest), _U(1))
        for row, k in enumerate(own):
            a[row, : m[row]] = items[k]
        span = np.arange(longest + widest - 1)
        j = first[:, None] + span
        inside = (j >= 0) & (j < len(words)) & (span < (m + width[at:to])[:, None])
        b = np.where(inside, words[np.clip(j, 0, max(len(words) - 1, 0))], _U(2))
        best, end = align_band(a, b)
        value = best / (MATCH * m)
        good = value >= score
        # the strict score is never the larger one
        look = np.flatnonzero(~good & (best >= MATCH * passage))
        if len(look):
            strict, at_end = align_band(a[look], b[look], STRICT, STRICT)
            good[look] = strict >= MATCH * passage
            end[look] = at_end
        out.append((own[good], value[good], (first + end)[good]))
        at = to
    item, value, end = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((end, -value, item))
    item, value, end = item[order], value[order], end[order]
    top = np.append(True, np.diff(item) != 0)[: len(item)]
    return item[top], value[top], end[top]


def _small(df: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def found(docs: DataFrame, benchmark: DataFrame, score: float, rare: int, passage: int, lengths=LENGTHS) -> DataFrame:
    """(doc_id, _text, item_id, score, last_word), `_text` a hash of the text."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    items = keep(items)
    seeds = keep(item_seeds(items, lengths))
    gate = seed_filter(seeds, seeds.count())
    chosen = keep(rare_seeds(docs, seeds, gate, rare, lengths))
    wanted = seed_filter(chosen, chosen.count())
    shared = docs.sparkSession.sparkContext.broadcast((gate, wanted))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, first = hash_words(batch.column(1), True, MARKS)
            gate, wanted = shared.value
            kept = [(h[at], row[at], pos[at]) for _, h, row, pos in all_windows(words, first, lengths, gate) for at in [_passes(wanted, h)]]
            h, row, pos = (np.concatenate(c) for c in zip(*kept))
            order = np.argsort(row, kind="stable")
            docs_at, begin = np.unique(row[order], return_index=True)
            offsets = pa.array(np.append(begin, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], t)) for x, t in ((h.view(np.int64), pa.int64()), (pos, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(docs_at)) for c in batch.columns), *lists], ["doc_id", "text", "hash", "pos"])

    held = keep(docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(hits, "doc_id long, text string, hash array<long>, pos array<int>"))
    held = held.withColumn("_text", F.xxhash64("text"))
    each = held.select("doc_id", "_text", F.explode(F.arrays_zip("hash", "pos")).alias("h")).select("doc_id", "_text", "h.hash", "h.pos")
    width = F.least("size", F.lit(BAND))
    pairs = each.join(_small(chosen), "hash").select("doc_id", "_text", "item", F.floor((F.col("pos") - F.col("at")) / width).alias("band"))
    pairs = pairs.groupBy("doc_id", "_text", "item").agg(F.collect_set("band").alias("bands")).join(_small(items), "item")
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("doc_id", "_text").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pairs = pairs.withColumn("part", F.floor(before / ITEM_BYTES))
    by_doc = pairs.groupBy("doc_id", "_text", "part").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item_text"), "bands")).alias("pairs"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_doc", "_text": "_hash"})
    joined = held.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            out = []
            for doc, key, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                words, _ = hash_words(pa.array([text]), True, MARKS)
                at, first = hash_words(pa.array([p["item_text"] for p in own], pa.string()), True, MARKS)
                sets = [at[a:b] for a, b in zip(first, first[1:])]
                places = [(k, *d) for k, p in enumerate(own) for d in diagonals(len(sets[k]), p["bands"])]
                for k, value, end in zip(*aligned(words, sets, *np.array(places, np.int64).T, score, passage)):
                    out.append((doc, key, own[k]["item_id"], float(value), int(end)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "_text", "item_id", "score", "last_word"])

    return joined.select("doc_id", "_text", "text", "pairs").mapInArrow(judge, "doc_id long, _text long, item_id long, score double, last_word long")


def matches(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, rare: int = RARE, passage: int = PASSAGE) -> DataFrame:
    """Rows (doc_id, item_id, score, last_word) of documents that hold a test item's passage."""
    return found(docs, benchmark, score, rare, passage).drop("_text")


def clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, rare: int = RARE, passage: int = PASSAGE) -> DataFrame:
    """The documents, with all their columns, that hold no test item's passage."""
    doc, text_hash = unused(docs.columns, "_doc", "_hash")
    with transient(docs.sparkSession) as stay:
        bad = stay(found(docs, benchmark, score, rare, passage).select(F.col("doc_id").alias(doc), F.col("_text").alias(text_hash)).distinct())
    bad = _small(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[doc]) & (F.xxhash64(docs["text"]) == bad[text_hash]), "left_anti")
