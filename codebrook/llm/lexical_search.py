"""Ranked lexical search by presence-mask grouping.

Items are searched in blocks whose text is bounded (`BLOCK_BYTES`); a block reads all
documents twice. First every document becomes postings of the block's terms: (document,
length, terms, counts), a slice of documents a row, which is kept in the shared folder.
From these follow the counts over all documents (N, L, df). Then each slice answers all
items of the block: the bitmaps of an item's terms are packed into one mask a document,
documents of equal masks are grouped, each mask gets the largest score that its terms can
give in the slice, and masks are evaluated in descending order of that until no mask left
can reach the item's tenth score so far. A task hands on at most ten documents an item.

What is broadcast is a block: its terms' hashes and each item's terms. Terms are known by
64-bit hashes.

Edge cases: a null text has no terms; items without terms, and tables without any, give
no rows; items with the same id and text count once, those with the same id and another
text rank on their own; repeated documents rank each on its own, those without a doc_id
after others of the same score; a very long text is taken whole; other columns go.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, hash_words, keep, slices

#: Documents an item, bytes of item texts a block, documents a slice.
BEST, BLOCK_BYTES, SLICE = 10, 4 << 20, 2048
_LAST = 2**63 - 1


@dataclass
class Block:
    """Sorted distinct term hashes, and each item's terms as places there."""

    terms: np.ndarray
    items: list[np.ndarray]


def block_of(texts: list[str | None]) -> Block:
    h, first = hash_words(pa.array(texts, pa.string()), lower=True, between=MARKS)
    terms = np.unique(h)
    return Block(terms, [np.unique(np.searchsorted(terms, h[a:b])) for a, b in zip(first, first[1:])])


@dataclass
class Postings:
    """Documents of a slice: ids (null: none), lengths, and (document, term, count) in order."""

    ids: np.ndarray
    null: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    def packed(self) -> bytes:
        own = [np.array([len(self.ids), len(self.doc)], np.int64), self.ids, self.null.astype(np.uint8), self.n, np.bincount(self.doc, minlength=len(self.ids)).astype(np.int32), self.term.astype(np.int32), self.tf.astype(np.int32)]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in own))

    @staticmethod
    def unpacked(data: bytes) -> Postings:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, m = np.frombuffer(raw, np.int64, 2)
        at, out = 16, []
        for kind, size in ((np.int64, n), (np.uint8, n), (np.int64, n), (np.int32, n), (np.int32, m), (np.int32, m)):
            out.append(np.frombuffer(raw, kind, int(size), at))
            at += out[-1].nbytes
        return Postings(out[0], out[1] > 0, out[2], np.repeat(np.arange(n), out[3]), out[4], out[5].astype(np.int64))


def postings_of(ids: pa.Array, texts: pa.Array, terms: np.ndarray) -> Postings:
    """Postings of the documents that have terms at all."""
    h, first = hash_words(texts, lower=True, between=MARKS)
    n = np.diff(first)
    some = np.flatnonzero(n)
    row = np.repeat(np.cumsum(n > 0) - 1, n)
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    known = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    pair, tf = np.unique(row[known] * max(len(terms), 1) + at[known], return_counts=True)
    null = ids.is_null().to_numpy(zero_copy_only=False)[some]
    return Postings(ids.fill_null(0).to_numpy(zero_copy_only=False)[some], null, n[some], pair // max(len(terms), 1), pair % max(len(terms), 1), tf)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Ranking:
    """The best documents of every item so far, as heaps of (score, -doc_id)."""

    def __init__(self, items: int, best: int = BEST):
        self.best, self.heaps = best, [[] for _ in range(items)]

    def least(self, item: int) -> int:
        """The score below which a document can't enter."""
        return self.heaps[item][0][0] if len(self.heaps[item]) == self.best else 1

    def put(self, item: int, score: int, doc: int) -> None:
        heap = self.heaps[item]
        if len(heap) < self.best:
            heapq.heappush(heap, (score, -doc))
        elif (score, -doc) > heap[0]:
            heapq.heapreplace(heap, (score, -doc))


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps (terms x documents) as one mask a document: distinct masks as bits, documents in order of masks, each mask's first."""
    bits = np.packbits(present, axis=0)
    wide = -(-len(bits) // 8) * 8
    words = np.zeros((present.shape[1], wide), np.uint8)
    words[:, : len(bits)] = bits.T
    words = words.view(">u8")
    order = np.lexsort(words.T[::-1])
    own = words[order]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(1)))
    distinct = np.unpackbits(own[first].view(np.uint8).reshape(len(first), -1), axis=1)[:, : len(present)]
    return distinct, order, first


def rank_slice(p: Postings, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, ranking: Ranking) -> None:
    """Put a slice's documents into the ranking of every item."""
    m = 10 + (90 * p.n * n_docs) // n_terms
    gain = (1_000_000_000 * p.tf) // (1000 * p.tf + 8 * m[p.doc])
    # the slice's own terms, in dense numbers
    local, at = np.unique(p.term, return_inverse=True)
    if not len(local):
        return
    largest = np.zeros(len(local), np.int64)
    np.maximum.at(largest, at, gain)
    present = np.zeros((len(local), len(p.ids)), bool)
    present[at, p.doc] = True
    begin = np.searchsorted(p.doc, np.arange(len(p.ids) + 1))
    chosen = np.zeros(len(local), np.int64)
    for q, terms in enumerate(items):
        spot = np.searchsorted(local, terms)
        spot = spot[spot < len(local)]
        own = spot[np.isin(local[spot], terms)]
        own = own[weight[local[own]] > 0]
        if not len(own):
            continue
        distinct, order, first = _masks(present[own])
        bound = distinct @ (weight[local[own]] * largest[own])
        size = np.diff(np.append(first, len(order)))
        chosen[own] = weight[local[own]]
        by_bound, done = np.argsort(-bound, kind="stable"), 0
        while done < len(by_bound) and bound[by_bound[done]] >= ranking.least(q):
            # masks of 64 documents at a time, one at least, as far as they can still enter
            upto = done + max(1, int(np.searchsorted(np.cumsum(size[by_bound[done:]]), 64, "right")))
            now = by_bound[done:upto]
            now = now[bound[now] >= ranking.least(q)]
            docs = np.concatenate([order[first[g] : first[g] + size[g]] for g in now])
            lengths = begin[docs + 1] - begin[docs]
            place = np.repeat(begin[docs] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            score = np.add.reduceat(gain[place] * chosen[at[place]], np.append(0, np.cumsum(lengths)[:-1]))
            least = ranking.least(q)
            for i in np.flatnonzero(score >= least).tolist():
                ranking.put(q, int(score[i]), _LAST if p.null[docs[i]] else int(p.ids[docs[i]]))
            done = upto
        chosen[own] = 0


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of every item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_bytes)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        # by hash, so a block has about block_bytes of text
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = _search_block(docs, [r["text"] for r in own], best)
        if found is not None:
            names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(own)], f"q int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    return out


def _search_block(docs: DataFrame, texts: list[str], best: int) -> DataFrame | None:
    """(q, rank, doc_id, score) for a block's items by number; None where nothing can match."""
    block = block_of(texts)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for batch in slices(batches):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                p = postings_of(part.column(0), part.column(1), terms)
                if len(p.ids):
                    yield pa.RecordBatch.from_arrays([pa.array([len(p.ids)], pa.int64()), pa.array([int(p.n.sum())], pa.int64()), pa.array([p.packed()], pa.binary())], ["n_docs", "n_terms", "data"])

    kept = keep(docs.mapInArrow(post, "n_docs long, n_terms long, data binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value.terms), np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                df += np.bincount(Postings.unpacked(data).term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    n_docs, n_terms = kept.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs or not len(block.terms):
        return None
    df = np.zeros(len(block.terms), np.int64)
    # a block's terms at most
    for r in kept.select("data").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = weights(n_docs, df)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value.items
        ranking = Ranking(len(items), best)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rank_slice(Postings.unpacked(data), items, weight, n_docs, n_terms, ranking)
        rows = [(q, None if d == -_LAST else -d, s) for q, heap in enumerate(ranking.heaps) for s, d in heap]
        q, d, s = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["q", "doc_id", "score"])

    near = kept.select("data").mapInArrow(rank, "q int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
