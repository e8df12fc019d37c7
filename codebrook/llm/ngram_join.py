"""N-gram Jaccard join by prefix trees.

A document's set holds the hashes of its distinct n-word shingles in one global order,
rarest first, by a count sketch of fixed size over all documents. Documents with equal
sets are one from the start. A set can only link if `ceil(t n)` of its shingles stand in
other documents, which an exchange of three bytes a shingle tells; the rest of the work
is on those sets. Two sets that reach the threshold share a shingle among
their first `n - ceil(t n) + 1`; for each such shingle, the sets of like size that have
it there join the block of the one that has it earliest, so any pair that may link meets in a
block. A block's ordered sets form a trie. A set's traversal of it shares the overlap of
common beginnings, and leaves a subtree when what remains on either side cannot reach the
required overlap, or when all its sets are linked already. The block's head goes first;
then only those that nothing has linked with it.

The order only has to put shingles last that very many documents share. A counter of the
sketch holds those of all shingles that fall to it, N / `SKETCH` on average; shingles
stand out that are some times more frequent than the root of that.

Blocks over `BLOCK` shingles are dealt in chunks, each with the head; sets that the head
does not link then meet every chunk. No task holds more than two chunks, pairs already
known to be connected are never compared, and links are only dropped when both sets
are connected by others.

Edge cases: a text of fewer words than n is one shingle; null or empty texts, or
texts without words, have an empty set and link with nothing; repeated rows share
their class; rows without a doc_id share the class of an equal set, else they link
nothing; a class is named by its
least doc_id, which also is the one that `representatives` keeps, beside all rows without
words; a very long text is one set of the work; an empty table gives
an empty result; other columns are ignored (`classes`) or stay (`representatives`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, compressed, frames, hash_words, keep, mix, release, slices, text_bytes, transient, unused, unzipped, window_hashes
from .entries import ENTRIES, Frequent, by_key, dealt, entry_batch, in_ranges, planes, unplanes

#: Counters of the sketch, and about how many shingles (of 8 bytes) a chunk of a block has.
SKETCH, BLOCK = 1 << 18, 1 << 17
#: Text in a fine range.
RANGE_BYTES = 4 << 20
_U = np.uint64


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text, and where each text's begin."""
    words, first = hash_words(texts, lower=True)
    h, row, _ = window_hashes(words, first, n)
    size = np.diff(first)
    for k in np.flatnonzero((size > 0) & (size < n)):
        own, at, _ = window_hashes(words[first[k] : first[k + 1]], np.array([0, size[k]]), int(size[k]))
        h, row = np.append(h, mix(own + _U(size[k]))), np.append(row, np.full(len(at), k))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(texts) + 1))


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Documents per hashed shingle in `SKETCH` counters, over all documents."""
    width = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in slices(batches):
            h, _ = shingle_sets(batch.column(0), n)
            total += np.bincount((h % _U(SKETCH)).astype(np.int64), minlength=SKETCH)
        parts = total.reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    rows = sorted((r["part"], r["counts"]) for r in summed.collect())
    return np.concatenate([np.frombuffer(c, np.int64) for _, c in rows]) if rows else np.zeros(SKETCH, np.int64)


def in_order(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's hashes in the global order: sketch count, then hash."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return h[np.lexsort((h, counts[(h % _U(SKETCH)).astype(np.int64)], row))]


def least(n, percent: int):
    """Shingles that a set of n must share to reach the threshold with any set."""
    return -(-percent * n // 100)


def needed(a, b, percent: int):
    """Least overlap of sets of a and b shingles: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _signature(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and a hash of the whole set."""
    h, first = shingle_sets(texts, n)
    size = np.diff(first)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h))])
    return size, mix((total[first[1:]] - total[first[:-1]]) + size.astype(_U)).view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, sig): set size and a hash of the whole set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, sig = _signature(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig)], ["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, sig long")


def repeated_counts(docs: DataFrame, n: int, slice_bytes: int = 3 << 19) -> DataFrame:
    """(doc_id, repeated): at least as many of its shingles stand in other documents too.

    Shingles that repeat inside a slice are counted there and sent once, without a
    document; the task keeps them, up to a bound, and sends them no more. The others travel as three bytes to fine ranges, which grow in number
    with the input; the few that only seem to repeat (about one in 25) make candidates.
    """
    ranges = max(1, -(-text_bytes(docs) // RANGE_BYTES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent()
        for batch in slices(batches, limit=slice_bytes):
            ids = batch.column(0).to_numpy()
            h, first = shingle_sets(batch.column(1), n)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(ids)), np.diff(first))
            by = np.argsort(h, kind="stable")
            begin = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
            lead, held = by[begin], np.diff(np.append(begin, len(h)))
            known, _ = frequent.among(h[lead], held)
            fresh = np.setdiff1d(np.flatnonzero(held > 1), known, assume_unique=True)
            repeats = held > 1
            repeats[known] = True
            frequent.add(h[lead[fresh]], held[fresh])
            many = np.empty(len(h), bool)
            many[by] = np.repeat(repeats, held)
            local = np.bincount(row[many], minlength=len(ids))
            told = np.flatnonzero(local)
            out = [(to, 2, planes(ids[told[at]]), local[told[at]].astype(np.int32).tobytes(), None, None) for to, at in by_key(_part(ids[told], ranges))]
            to = ((h >> _U(32)) % _U(ranges)).astype(np.int64)
            low = h.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            shared, own = lead[fresh], np.flatnonzero(~many)
            out += [(k, 1, None, low[shared[at]].tobytes(), None, None) for k, at in by_key(to[shared])]
            out += [(k, 0, planes(ids[row[own[at]]]), low[own[at]].tobytes(), None, None) for k, at in by_key(to[own])]
            yield entry_batch(out)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_ranges(batches):
            out, sent, shared = ([r for r in rows if r[1] == kind] for kind in (2, 0, 1))
            if sent:
                doc = np.concatenate([unplanes(r[2], np.int64) for r in sent])
                low = np.zeros((len(doc) + sum(len(r[3]) for r in shared) // 3, 4), np.uint8)
                low[:, :3] = np.frombuffer(b"".join(r[3] for r in [*sent, *shared]), np.uint8).reshape(-1, 3)
                low = low.view("<u4")[:, 0]
                order = np.argsort(low)
                again = low[order][1:] == low[order][:-1]
                order = order[np.append(again, False) | np.append(False, again)]
                ids, counts = np.unique(doc[order[order < len(doc)]], return_counts=True)
                out += [(to, 2, planes(ids[at]), counts[at].astype(np.int32).tobytes(), None, None) for to, at in by_key(_part(ids, ranges))]
            if out:
                yield entry_batch(out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_ranges(batches):
            doc = np.concatenate([unplanes(r[2], np.int64) for r in rows])
            ids, of = np.unique(doc, return_inverse=True)
            counts = np.bincount(of, np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64))], ["doc_id", "repeated"])

    sent = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(emit, ENTRIES)
    return dealt(dealt(sent, ranges).mapInArrow(find, ENTRIES), ranges).mapInArrow(add, "doc_id long, repeated long")


def _part(ids: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(ids.astype(_U)) % _U(ranges)).astype(np.int64)


class Trie:
    """A compressed prefix tree over ordered sets."""

    def __init__(self, sets: list[np.ndarray], keys: list[bytes]):
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        common = []
        for a, b in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = np.array(common, np.int64)
        self.size = np.array([len(s) for s in self.sets])
        self.kids: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def node(self, lo: int, hi: int) -> tuple[int, list[tuple[int, int]]]:
        """Depth to which sets lo..hi agree, and the child intervals below it."""
        if hi - lo == 1:
            return int(self.size[lo]), []
        found = self.kids.get((lo, hi))
        if found is None:
            inner = self.common[lo : hi - 1]
            depth = int(inner.min())
            cuts = [lo, *(np.flatnonzero(inner == depth) + lo + 1).tolist(), hi]
            found = self.kids[lo, hi] = depth, list(zip(cuts, cuts[1:]))
        return found

    def links(self, x: np.ndarray, percent: int, group: np.ndarray, own: int) -> Iterator[int]:
        """Sets (in tree order) that link with x and are not of the group `own` yet."""
        have = np.sort(x)
        stack = [(0, len(self.sets), 0, 0)]
        while stack:
            lo, hi, depth, shared = stack.pop()
            if (group[lo:hi] == own).all():
                continue
            to, kids = self.node(lo, hi)
            part = self.sets[lo][depth:to]
            if len(part):
                at = np.minimum(np.searchsorted(have, part), len(have) - 1)
                shared += int((have[at] == part).sum())
            sizes = self.size[lo:hi]
            room = shared + np.minimum(len(x) - shared, sizes - to)
            if not ((room >= needed(len(x), sizes, percent)) & (group[lo:hi] != own)).any():
                continue
            if kids:
                stack += [(a, b, to, shared) for a, b in kids]
            elif shared >= needed(len(x), int(sizes[0]), percent):
                yield lo


def block_links(sets: list[np.ndarray], keys: list[bytes], percent: int, seekers: list[int], done: int | None = None) -> list[tuple[int, int]]:
    """Links (seeker, other), enough to connect all that link with a seeker.

    Seekers that are connected with the set `done` by the time of their turn are skipped.
    """
    if not seekers:
        return []
    trie, out = Trie(sets, keys), []
    group = np.arange(len(sets))
    place = np.empty(len(sets), np.int64)
    place[trie.order] = np.arange(len(sets))
    for s in seekers:
        if done is not None and s != done and group[place[s]] == group[place[done]]:
            continue
        for other in trie.links(sets[s], percent, group, group[place[s]]):
            if group[other] != group[place[s]]:
                out.append((s, trie.order[other]))
                group[group == group[other]] = group[place[s]]
    return out


def links(docs: DataFrame, signed: DataFrame, n: int, percent: int, counts, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between set hashes, enough to connect all that link."""
    reps = signed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    able = reps.join(repeated_counts(docs, n), "doc_id").where(f"100 * repeated >= {percent} * n")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "z", 1 << 19):
            texts = pa.array([unpack.decompress(z) if z else b"" for z in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
            h, first = shingle_sets(texts, n)
            size = np.diff(first)
            h = in_order(h, first, counts.value)
            take = np.where(size > 0, size - least(size, percent) + 1, 0)
            at = np.repeat(first[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(h[at].view(np.int64)))
            whole = pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), prefix, whole], ["sig", "n", "prefix", "set"])

    held = compressed(docs).join(able.select("doc_id", "sig"), "doc_id").dropDuplicates(["sig"])
    held = keep(held.select("sig", "z").mapInArrow(sets, "sig long, n long, prefix array<long>, set binary"))
    # sets that may link are in the same size class or in adjoining ones; each set is in its own and the next
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / max(percent - 1, 1)))).cast("int")
    postings = held.select("sig", "n", F.posexplode("prefix").alias("pos", "shingle")).select("*", F.explode(F.array(own, own + 1)).alias("size"))
    heads = postings.groupBy("shingle", "size").agg(F.min(F.struct("pos", F.col("sig").alias("head"))).alias("first"), F.count("*").alias("many"))
    heads = heads.where("many > 1").select("shingle", "size", "first.head")
    pairs = keep(postings.join(heads, ["shingle", "size"]).groupBy("head", "sig").agg(F.first("n").alias("n")))
    size = pairs.groupBy("head").agg(F.ceil(F.sum("n") / block).cast("int").alias("chunks"))
    pairs = pairs.join(size, "head").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    # the head itself is in every chunk
    every = size.select(F.col("head").alias("sig"), "head", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    members = pairs.where("sig <> head").select("sig", "head", "chunks", "chunk").unionByName(every).join(held.select("sig", "set"), "sig")

    def order_keys(own: list[np.ndarray]) -> list[bytes]:
        return [np.stack([counts.value[(s % _U(SKETCH)).astype(np.int64)].astype(">u8"), s.astype(">u8")], 1).tobytes() for s in own]

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        sig, head = group.column("sig").to_pylist(), key[0].as_py()
        own = [np.frombuffer(x, _U) for x in group.column("set").to_pylist()]
        lead = sig.index(head)
        pairs = block_links(own, order_keys(own), percent, [lead, *(i for i in range(len(own)) if i != lead)], lead)
        out = [(sig[a], sig[b]) for a, b in pairs]
        held = {lead, *(b for a, b in pairs if a == lead)}
        apart = [] if group.column("chunks")[0].as_py() == 1 else [(sig[i], None) for i in range(len(own)) if i not in held]
        return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*out + apart)) or ([], []))], ["a", "b"])

    def across(key: tuple, group: pa.Table) -> pa.Table:
        sig = group.column("sig").to_pylist()
        own = [np.frombuffer(x, _U) for x in group.column("set").to_pylist()]
        seek = [i for i, x in enumerate(group.column("seek").to_pylist()) if x]
        out = [(sig[a], sig[b]) for a, b in block_links(own, order_keys(own), percent, seek)]
        return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*out)) or ([], []))], ["a", "b"])

    within = keep(members.groupBy("head", "chunk").applyInArrow(compare, "a long, b long"))
    found = within.where("b IS NOT NULL")
    if size.where("chunks > 1").isEmpty():
        return found
    # in blocks of several chunks, sets that the head does not hold meet the other chunks
    large = members.where("chunks > 1 AND sig <> head")
    loose = large.join(within.where("b IS NULL").select(F.col("a").alias("sig")).distinct(), "sig")
    meeting = loose.select("sig", "head", "set", F.col("chunk").alias("from"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("seek")).where("from <> chunk")
    other = large.join(meeting.select("head", "chunk", "from").distinct(), ["head", "chunk"]).select("sig", "head", "set", "from", "chunk", F.lit(False).alias("seek"))
    crossed = meeting.unionByName(other).groupBy("head", "chunk", "from").applyInArrow(across, "a long, b long")
    return found.unionByName(crossed)


def _roots(docs: DataFrame, signed: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(sig, root, least): the class of every set that is not empty, and the set's least doc_id."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, n))
    roots = components(links(docs, signed, n, percent, counts, block))
    least_doc = signed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    return least_doc.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def classes(docs: DataFrame, n: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id): the least doc_id that links reach."""
    signed = keep(signatures(docs, n))
    of_sig = _roots(docs, signed, n, percent, block)
    of_root = of_sig.groupBy("root").agg(F.min("least").alias("component_id"))
    known = of_sig.join(of_root, "root").select("sig", "component_id")
    full = signed.where("n > 0").select("doc_id", "n", "sig").join(known, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, n: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """All columns of one document, that of the least doc_id, of each class.

    A class keeps one row. A doc_id with different texts counts with each of them, rows
    without a doc_id are kept where their set is nobody else's, and rows without words
    stay. Texts travel compressed to the join.
    """
    size, sig, doc, row, mark = unused(docs.columns, "_n", "_sig", "_id", "_row", "_kept")
    with transient(docs.sparkSession) as stay:
        signed = keep(signatures(docs, n))
        of_sig = _roots(docs, signed, n, percent, block)
        first = of_sig.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sig")).alias("f"))
        of = F.when(F.col("f.none"), F.bitwise_not("f.sig")).otherwise(F.col("f.sig"))
        kept = stay(first.select(of.alias(sig), F.coalesce("f.least", F.lit(0)).alias(doc), F.lit(True).alias(mark)))
    del signed, of_sig, first
    release(docs.sparkSession)
    # one exchange of texts: the join and the choice of one row have the same keys
    joined = _signed(docs, n, [size, sig, doc]).join(kept, [sig, doc], "left").where((F.col(size) == 0) | F.col(mark))
    joined = joined.withColumn(row, F.when(F.col(size) == 0, F.monotonically_increasing_id()))
    return unzipped(joined.dropDuplicates([sig, doc, row]).select(*docs.columns))


def _signed(docs: DataFrame, n: int, more: list[str]) -> DataFrame:
    """All columns, with texts as zstd frames, and, by the names in `more`, the size and the hash of each row's set, and its doc_id.

    A row without a doc_id has 0 there, and the hash's complement. All is made in one pass,
    so that a task needs one Python worker only.
    """
    k, at = docs.columns.index("text"), docs.columns.index("doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            columns = list(batch.columns)
            size, sig = _signature(columns[k], n)
            none = columns[at].is_null().to_numpy(zero_copy_only=False)
            own = [pa.array(size, pa.int64()), pa.array(np.where(none, ~sig, sig)), columns[at].cast(pa.int64()).fill_null(0)]
            columns[k] = frames(columns[k])
            yield pa.RecordBatch.from_arrays([*columns, *own], [*batch.schema.names, *more])

    fields = [T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(rows, T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in more)]))
