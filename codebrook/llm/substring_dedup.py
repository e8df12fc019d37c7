"""Substring dedup by level-wise doubling.

Level 0 hashes all windows of `size` words. A window that occurs more than once gets
a class: its first place, the least (doc_id, position) of all its occurrences. Level
k + 1 takes only places p whose windows at p and p + L (L = size * 2**k) both repeat,
and asks which windows of 2L words repeat. Where the classes of the two halves lie L
words apart in one document, the doubled window is that document's text and keeps its
class; only other pairs are grouped anew. Doubling ends when no such pair is left: what remains
then repeats as far as its runs reach.

What is removed is the union of the runs of all levels. A level keeps only what did not double: a
place that a window of twice the length covers, with a first place in an earlier
document as well, is that level's. So long repeats come from the doubled windows, and
from each level below what did not repeat at twice the length.

Scale: first occurrences are found in three steps. A slice of documents sends each
distinct hash for one document only; windows that are met in several documents are kept
by the task, up to a bound, so that its later slices send them no more; what is left
meets in the ranges. A passage that a third of all documents share costs about one entry
a task. Entries travel packed, about 9 bytes a window, to fine hash ranges of about
`RANGE_BYTES` of text each, which tasks take one after the other; ranges grow in number
with the input, so a range has windows of that text and a few entries a task for each
shared one. Window identity is a 56-bit hash plus an independent hash that picks the range, and ranges do
not grow, so a window is mistaken for another with probability under 1e-11.

Edge cases: null or empty texts, texts under `size` words and rows without a doc_id
have no windows and lose nothing; repeated rows of one doc_id count as one document;
windows that repeat only inside a document have a class but are not removed; of equal
passages that of the least doc_id stays; a very long text is a slice of its own and its
windows go to all ranges; an empty table gives empty results; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressed, hash_words, keep, mix, rows_of, slices, text_bytes, window_hashes
from .entries import ENTRIES, Frequent, by_key, dealt, entry_batch, in_ranges, planes, unplanes

RANGE_BYTES = 4 << 20
#: Text of a slice of documents.
SLICE_BYTES = 3 << 19
#: Bytes of a window's hash that travel; the range adds an independent part.
HASH_BYTES = 7
RUNS = "doc_id long, start int, n int, step int, first_doc long, first_start int"
BY_DOC = "doc_id long, runs array<struct<start: int, n: int, step: int, first_doc: long, first_start: int>>"
_NAMES = ["doc_id", "start", "n", "step", "first_doc", "first_start"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def _send(doc: np.ndarray, pos: np.ndarray, h: np.ndarray, route: np.ndarray, ranges: int) -> list[tuple]:
    """Rows of entries (document, position, hash) for each range."""
    return [(key, 0, planes(doc[at]), planes(pos[at].astype(np.int32)), h[at].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes(), None) for key, at in by_key((route % np.uint64(ranges)).astype(np.int64))]


def _reply(doc: np.ndarray, pos: np.ndarray, first_doc: np.ndarray, first_pos: np.ndarray, ranges: int, kind: int) -> list[tuple]:
    """Rows of places and their classes for each range of documents."""
    to = (mix(doc.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    pos, first_pos = pos.astype(np.int32), first_pos.astype(np.int32)
    return [(key, kind, planes(doc[at]), planes(pos[at]), planes(first_doc[at]), planes(first_pos[at])) for key, at in by_key(to)]


def runs(doc: np.ndarray, pos: np.ndarray, first_doc: np.ndarray, first_pos: np.ndarray) -> list[np.ndarray]:
    """Places in order of (doc, pos) as runs whose classes advance by one word or stay."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 6
    near = (np.diff(doc) == 0) & (np.diff(pos) == 1) & (np.diff(first_doc) == 0)
    move = np.diff(first_pos)
    begin = np.flatnonzero(np.append(True, ~(near & (move == 1))))
    single = np.diff(np.append(begin, len(doc))) == 1
    stay = np.append(False, single[1:] & single[:-1] & (near & (move == 0))[begin[1:] - 1])
    begin = begin[~stay]
    n = np.diff(np.append(begin, len(doc)))
    step = np.where((n > 1) & (np.append(first_pos, 0)[np.minimum(begin + 1, len(doc))] == first_pos[begin]), 0, 1)
    return [doc[begin], pos[begin], n, step, first_doc[begin], first_pos[begin]]


def places(start: np.ndarray, n: np.ndarray, step: np.ndarray, first_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions of runs, the positions of their classes, and their run."""
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return start[of] + k, first_start[of] + k * step[of], of


def _listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """The row of each element of a column of lists of structs, and fields of all elements."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), *(flat.field(name).to_numpy().astype(np.int64) for name in names)


def _run_batch(columns: list[np.ndarray], extra: int | None = None) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(c), type=pa.int64()).cast(t) for c, t in zip(columns, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays if extra is None else [*arrays, pa.array(np.full(len(columns[0]), extra, np.int32))], _NAMES if extra is None else [*_NAMES, "kind"])


def _by_doc(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Runs in order of documents, as one row a document."""
    flat, doc = _run_batch(columns), np.asarray(columns[0], np.int64)
    begin = np.flatnonzero(np.append(True, np.diff(doc) != 0)[: len(doc)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)), pa.int32()), pa.StructArray.from_arrays(flat.columns[1:], _NAMES[1:]))
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), lists], ["doc_id", "runs"])


def _window_entries(docs: DataFrame, size: int, ranges: int, limit: int) -> DataFrame:
    """Entries of level 0, and the classes that a task's documents give each other."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(2)
        for batch in slices(batches, limit=limit):
            ids = batch.column(0).to_numpy()
            if (np.diff(ids) < 0).any():
                batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
                ids = batch.column(0).to_numpy()
            words, first = hash_words(batch.column(1))
            h, row, pos = window_hashes(words, first, size)
            if not len(h):
                continue
            route, _, _ = window_hashes(words, first, size, 0xD1342543DE82EF95)
            doc = ids[row]
            if (np.diff(ids) == 0).any():
                order = np.lexsort((pos, doc))
                doc, pos, h, route = doc[order], pos[order], h[order], route[order]
            by = np.argsort(h, kind="stable")
            begin = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
            lead, many = by[begin], np.diff(np.append(begin, len(h)))
            of = np.empty(len(h), np.int64)
            of[by] = np.repeat(np.arange(len(lead)), many)
            lead_doc, lead_pos = doc[lead], pos[lead]
            # a place of an earlier slice leads on where it is the smaller one, else it is followed from now on
            k, at = frequent.among(h[lead], many)
            old_doc, old_pos = frequent.values[0][at], frequent.values[1][at]
            earlier = (old_doc < lead_doc[k]) | ((old_doc == lead_doc[k]) & (old_pos <= lead_pos[k]))
            frequent.values[0][at[~earlier]], frequent.values[1][at[~earlier]] = lead_doc[k[~earlier]], lead_pos[k[~earlier]]
            lead_doc[k[earlier]], lead_pos[k[earlier]] = old_doc[earlier], old_pos[earlier]
            lead[k[earlier]] = -1
            own = doc == lead_doc[of]
            rows = _send(doc[own], pos[own], h[own], route[own], ranges)
            other = np.flatnonzero(~own)
            if len(other):
                heads = lead[of[other]]
                told = np.unique(np.append(other, heads[heads >= 0]))
                rows += _reply(doc[told], pos[told], lead_doc[of[told]], lead_pos[of[told]], ranges, 2)
                fresh = np.setdiff1d(np.unique(of[other]), k, assume_unique=True)
                frequent.add(h[lead[fresh]], many[fresh], lead_doc[fresh], lead_pos[fresh])
            yield entry_batch(rows)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(emit, ENTRIES)


def _finder(ranges: int):
    """The task that looks for repeated hashes, range by range; classes pass through."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_ranges(batches):
            out = [r for r in rows if r[1]]
            sent = [r for r in rows if not r[1]]
            if sent:
                doc, pos = (np.concatenate([unplanes(r[k], t) for r in sent]) for k, t in ((2, np.int64), (3, np.int32)))
                h = np.zeros((len(doc), 8), np.uint8)
                h[:, :HASH_BYTES] = np.frombuffer(b"".join(r[4] for r in sent), np.uint8).reshape(-1, HASH_BYTES)
                h = h.view(np.uint64)[:, 0]
                order = np.argsort(h)
                again = h[order][1:] == h[order][:-1]
                order = order[np.append(again, False) | np.append(False, again)]
                order = order[np.lexsort((pos[order], doc[order], h[order]))]
                if len(order):
                    new = np.append(True, h[order][1:] != h[order][:-1])
                    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                    by = np.lexsort((pos[order], doc[order]))
                    order, lead = order[by], lead[by]
                    out += _reply(doc[order], pos[order], doc[lead], pos[lead], ranges, 1)
            if out:
                yield entry_batch(out)

    return find


def _ordered(rows: list[tuple]) -> list[np.ndarray]:
    """Places and classes of replies, in order of (doc, pos)."""
    at = [np.concatenate([unplanes(r[k], t) for r in rows]) for k, t in ((2, np.int64), (3, np.int32), (4, np.int64), (5, np.int32))]
    order = np.lexsort((at[1], at[0]))
    return [v[order] for v in at]


def _repeated(entries: DataFrame, ranges: int) -> DataFrame:
    """Runs of level 0 with their class, and kind: 1 final, 2 as seen inside one slice."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_ranges(batches):
            for kind in (1, 2):
                own = [r for r in rows if r[1] == kind]
                if own:
                    yield _run_batch(runs(*_ordered(own)), kind)

    found = dealt(entries, ranges).mapInArrow(_finder(ranges), ENTRIES)
    return dealt(found, ranges).mapInArrow(gather, f"{RUNS}, kind int")


def _resolved(found: DataFrame) -> DataFrame:
    """(doc_id, runs): runs of one slice's classes are led on to the class that the slice's
    first document has. A document may have several rows, one for each such first document.
    """
    run = F.struct("start", "n", "step", "first_doc", "first_start")
    final = found.where("kind = 1").groupBy("doc_id").agg(F.collect_list(run).alias("runs"))
    of_pair = found.where("kind = 2").groupBy("doc_id", "first_doc").agg(F.collect_list(run).alias("runs"))

    def lead_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 200):
            if not batch.num_rows:
                continue
            row, start, n, step, first_start = _listed(batch.column(2), "start", "n", "step", "first_start")
            pos, at, of = places(start, n, step, first_start)
            order = np.lexsort((pos, row[of]))
            pos, at, row = pos[order], at[order], row[of][order]
            first_doc, first_pos = batch.column(1).to_numpy()[row], at.copy()
            own, s, m, t, fs, d = _listed(batch.column(3), "start", "n", "step", "first_start", "first_doc")
            if len(own):
                by = np.lexsort((s, own))
                own, s, m, t, fs, d = (v[by] for v in (own, s, m, t, fs, d))
                i = np.maximum(np.searchsorted((own << 32) + s, (row << 32) + at, "right") - 1, 0)
                hit = (own[i] == row) & (at >= s[i]) & (at < s[i] + m[i])
                first_doc[hit] = d[i][hit]
                first_pos[hit] = (fs[i] + (at - s[i]) * t[i])[hit]
            found = runs(row, pos, first_doc, first_pos)
            ends = np.cumsum(np.append(0, np.bincount(found[0], minlength=batch.num_rows)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(_run_batch(found).columns[1:], _NAMES[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "runs"])

    known = final.select(F.col("doc_id").alias("first_doc"), F.col("runs").alias("known"))
    joined = of_pair.join(known, "first_doc", "left").select("doc_id", "first_doc", "runs", "known")
    return final.unionByName(joined.mapInArrow(lead_on, BY_DOC))


def _pair_up(doc: np.ndarray, pos: np.ndarray, first_doc: np.ndarray, first_pos: np.ndarray, length: int, ranges: int) -> list[tuple]:
    """Entries and classes of windows of twice the length, from places in order of (doc, pos)."""
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(pos) != 0))[: len(doc)]
    doc, pos, first_doc, first_pos = (v[new].astype(np.int64) for v in (doc, pos, first_doc, first_pos))
    key = (np.cumsum(np.append(True, np.diff(doc) != 0)[: len(doc)]) << 32) + pos
    j = np.minimum(np.searchsorted(key, key + length), max(len(key) - 1, 0))
    i = np.flatnonzero(key[j] == key + length) if len(key) else np.zeros(0, np.int64)
    j = j[i]
    doc, pos, a, x, b, y = doc[i], pos[i], first_doc[i], first_pos[i], first_doc[j], first_pos[j]
    whole = (a == b) & (x + length == y)
    u = [v[~whole].astype(np.uint64) for v in (a, x, b, y)]
    h = mix(mix(mix(mix(u[0]) + u[1]) + u[2]) + u[3])
    route = mix(u[0] * np.uint64(3) + mix(u[1] + mix(u[2] + mix(u[3]))))
    return _reply(doc[whole], pos[whole], a[whole], x[whole], ranges, 1) + _send(doc[~whole], pos[~whole], h, route, ranges)


def _doubled(state: DataFrame, length: int, ranges: int) -> DataFrame:
    """The first doubling: entries and classes from runs of windows of `length`."""
    docs = state.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    reach = F.array_max(F.transform("runs", lambda r: r["start"] + r["n"])) - F.array_min("runs.start")
    docs = docs.where(reach > length)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 200):
            if batch.num_rows:
                row, start, n, step, first_doc, first_start = _listed(batch.column(1), "start", "n", "step", "first_doc", "first_start")
                pos, first_pos, of = places(start, n, step, first_start)
                order = np.lexsort((pos, row[of]))
                of = of[order]
                yield entry_batch(_pair_up(batch.column(0).to_numpy()[row[of]], pos[order], first_doc[of], first_pos[order], length, ranges))

    return docs.mapInArrow(emit, ENTRIES)


def _level(entries: DataFrame, length: int, ranges: int) -> DataFrame:
    """Runs of repeated windows of `length` with an earlier document's class (range null), and entries of the next doubling.

    A document's places meet in one task here, so the next doubling starts from them. Levels
    get smaller and smaller, and so does their number of tasks.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_ranges(batches):
            at = _ordered(rows)
            own = runs(*at)
            earlier = np.asarray(own[4]) < own[0]
            kept, more = _by_doc([v[earlier] for v in own]), entry_batch(_pair_up(*at, length, ranges))
            for batch, mine in ((kept, True), (more, False)):
                null = lambda t: pa.nulls(batch.num_rows, t)  # noqa: B023, E731
                left = batch.columns if mine else [null(f.type) for f in kept.schema]
                right = [null(f.type) for f in more.schema] if mine else batch.columns
                yield pa.RecordBatch.from_arrays([*left, *right], ["doc_id", "runs", *more.schema.names])

    found = dealt(entries, ranges, merged=True).mapInArrow(_finder(ranges), ENTRIES)
    return dealt(found, ranges, merged=True).mapInArrow(gather, f"{BY_DOC}, {ENTRIES}")


def repeated_runs(docs: DataFrame, size: int = 13, slice_bytes: int = SLICE_BYTES) -> list[tuple[int, DataFrame, DataFrame | None]]:
    """For each level, the window length, the runs of its places, and those of the level above.

    Runs are rows (doc_id, runs) of repeated places whose class is an earlier document's. Places
    that a doubled window of the level above covers are that level's (`removed`).
    """
    ranges = max(1, -(-text_bytes(docs) // RANGE_BYTES))
    found = keep(_repeated(_window_entries(docs, size, ranges, slice_bytes), ranges))
    every = keep(_resolved(found))
    earlier = every.select("doc_id", F.filter("runs", lambda r: r["first_doc"] < F.col("doc_id")).alias("runs"))
    levels = [(size, earlier.where(F.size("runs") > 0))]
    entries = _doubled(every, size, ranges)
    while True:
        length = 2 * levels[-1][0]
        level = keep(_level(entries, length, ranges))
        levels.append((length, level.where("range IS NULL").select("doc_id", "runs")))
        entries = level.where("range IS NOT NULL").select(*ENTRIES.replace(" int", "").replace(" binary", "").split(", "))
        # places whose class goes on in its own document repeat as far as their runs say
        if level.where("kind = 0").isEmpty():
            return [*((own, state, above) for (own, state), (_, above) in zip(levels, levels[1:])), (*levels[-1], None)]


def _marked(base: np.ndarray, n: np.ndarray, at: np.ndarray, start: np.ndarray, many: np.ndarray, step: np.ndarray, length: np.ndarray, counted: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which words of documents go, and each document's longest repeat.

    Document i has `n[i]` words from `base[i]` on; runs `start`, `many`, `step` of windows of `length` are of documents `at`.
    """
    size = int(base[-1] + n[-1]) + 1
    edge, longest = np.zeros(size, np.int64), np.zeros(len(n), np.int64)

    def within(own: np.ndarray, more: int, width: int) -> np.ndarray:
        """Places of runs and `more` places after each, as far as windows of `width` fit."""
        last = np.maximum(n[at[own]] - (width - 1), 0)
        to = base[at[own]] + np.minimum(start[own] + many[own] + more, last)
        begin = base[at[own]] + np.minimum(start[own], last)
        return np.cumsum(np.bincount(begin, minlength=size) - np.bincount(to, minlength=size)) > 0

    for width in sorted(counted.intersection(np.unique(length).tolist())):
        own, above = np.flatnonzero(length == width), np.flatnonzero(length == 2 * width)
        left = within(own, 0, width)
        if len(above):
            # a doubled window covers the places from its own to that of its second half
            left &= ~within(above, width, width)
        there = np.flatnonzero(left)
        edge += np.bincount(there, minlength=size) - np.bincount(there + width, minlength=size)
        upto = np.append(0, np.cumsum(left))
        begin, end = (base[at[own]] + np.minimum(v, n[at[own]]) for v in (start[own], start[own] + many[own]))
        some = own[upto[end] > upto[begin]]
        np.maximum.at(longest, at[some], np.where(step[some] == 1, many[some] + (width - 1), width))
    return np.cumsum(edge)[:-1] > 0, longest


def removed(docs: DataFrame, levels: list[tuple[int, DataFrame, DataFrame | None]]) -> DataFrame:
    """Per document: words, removed words, longest earlier repeat, and the kept text's sha256.

    A word goes if a window over it also starts in a document with a smaller doc_id: it
    lies in a run of some level whose class has one. A level has the places that no doubled window covers: long
    repeats come from the doubled windows. Runs of all levels and texts, compressed, travel once: they are dealt by
    document, each one's runs before its text. Rows without a doc_id have no runs, and are dealt by their text.
    """
    counted = {length for length, *_ in levels}
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("length", "int"), ("z", "binary"), ("runs", BY_DOC.split("runs ")[1]))}
    both = compressed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), nothing["runs"].alias("runs"), nothing["length"].alias("length"), "z")
    for length, state, above in levels:
        for wide, runs_of in ((length, state), (2 * length, above)):
            if wide == length or (runs_of is not None and wide not in counted):
                both = both.unionByName(runs_of.select("doc_id", "runs", F.lit(wide).alias("length"), nothing["z"].alias("z")))
    both = both.repartition(F.coalesce("doc_id", F.xxhash64("z"))).sortWithinPartitions("doc_id", F.col("length").asc_nulls_last())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, carry = zstandard.ZstdDecompressor(), []
        for batch in rows_of(batches, 1000):
            if carry:
                batch = pa.Table.from_batches([*carry, batch]).combine_chunks().to_batches()[0]
            is_text = pc.is_null(batch.column(2))
            marks = batch.filter(pc.invert(is_text))
            of, start, many, step = _listed(marks.column(1), "start", "n", "step")
            doc, length = (marks.column(c).to_numpy().astype(np.int64)[of] for c in (0, 2))
            for texts in slices(iter([batch.filter(is_text)]), "z", 1 << 18):
                words = [unpack.decompress(z).split() if z else [] for z in texts.column(3).to_pylist()]
                ids, known = pc.fill_null(texts.column(0), 0).to_numpy(), pc.is_valid(texts.column(0)).to_numpy(zero_copy_only=False)
                low, high = (np.searchsorted(doc, ids, side) for side in ("left", "right"))
                found = np.flatnonzero(known & (high > low))
                out, gone, longest = [], {}, {}
                if len(found):
                    n = np.array([len(words[i]) for i in found])
                    base, per = np.cumsum(n) - n, (high - low)[found]
                    k = np.repeat(low[found] - np.cumsum(per) + per, per) + np.arange(per.sum())
                    mask, most = _marked(base, n, np.repeat(np.arange(len(found)), per), start[k], many[k], step[k], length[k], counted)
                    gone, longest = dict(zip(found.tolist(), np.split(mask, base[1:]))), dict(zip(found.tolist(), most.tolist()))
                for i, (own, id_) in enumerate(zip(words, texts.column(0).to_pylist())):
                    stay = [own[j] for j in np.flatnonzero(~gone[i])] if i in gone and gone[i].any() else own
                    out.append((id_, len(own), len(own) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest(), longest.get(i, 0)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat"])
            # the last document's texts may go on in the next batch
            last = batch.column(0)[-1]
            carry = [marks.filter(pc.equal(marks.column(0), last))] if last.is_valid else []

    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, longest_repeat long")
