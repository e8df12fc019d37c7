"""Packed rows that travel to fine ranges: many small values in a few binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENTRIES = "range int, kind int, a binary, b binary, c binary, d binary"
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]


def planes(values: np.ndarray) -> bytes:
    """Differences of integers, all first bytes, then all second bytes and so on."""
    v = np.diff(values, prepend=values.dtype.type(0))
    return v.view(np.uint8).reshape(len(v), -1).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(wide, -1).T.copy().view(dtype)[:, 0], dtype=dtype)


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and the places where it stands, in order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(keys[part[0]]), part


def entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by range; the input is sorted by it."""
    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def dealt(entries: DataFrame, ranges: int, merged: bool = False) -> DataFrame:
    """Rows by range, each range in one task, tasks take one range after the other.

    With `merged`, few bytes are few tasks, as Spark sees fit.
    """
    if merged:
        return entries.repartition("range").sortWithinPartitions("range")
    parts = min(ranges, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return entries.repartition(parts, "range").sortWithinPartitions("range")


class Frequent:
    """Hashes that a task has met in several documents, at most `most`, with columns of values.

    What is let go when it is full are the least frequent ones; they are only combined less.
    """

    def __init__(self, columns: int = 0, most: int = 1 << 15):
        self.most, self.h, self.n = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values = [np.zeros(0, np.int64) for _ in range(columns)]

    def among(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known hashes in sorted distinct ones, and here; adds their counts."""
        at = np.searchsorted(hashes, self.h)
        own = np.flatnonzero(at < len(hashes))
        own = own[hashes[at[own]] == self.h[own]]
        self.n[own] += counts[at[own]]
        return at[own], own

    def add(self, hashes: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> None:
        h, n = np.append(self.h, hashes), np.append(self.n, counts)
        order = np.argsort(-n, kind="stable")[: self.most]
        order = order[np.argsort(h[order])]
        self.values = [np.append(a, b)[order] for a, b in zip(self.values, values)]
        self.h, self.n = h[order], n[order]
