"""The best cut of every bucket in two passes over sorted values, without a row-level join.

Whole numbers are counted by (bucket, value) first: rows of one value follow each other, and
what cuts between them leave follows from their count, so rows are not sorted or written.
Fractions stay rows. Values are sorted once by (bucket, value) in ranges. The first pass gives each part's
sums by bucket, one row a part and bucket that meet; with what comes before it, the second
pass finds the part's best cut, and one candidate a part and bucket is left to compare.
Whole numbers are summed exactly, in whole numbers of any size where they need it: losses
are compared as floats first, and those within their error of the least one exactly. Inside
a value's rows the gain is convex, so it is looked into only where one of its ends is that near.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan

_LIMIT = 1 << 62
#: Rows of a value that are looked into at a time.
_ROWS = 1 << 16


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple]:
    """(key, part, values, their numbers of rows) of consecutive values of one bucket."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(n_keys)], 1)
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else []
        for a, b in zip(first, [*first[1:], len(keys)]):
            yield tuple(keys[a].tolist()), batch.column(n_keys + 2)[0].as_py(), batch.column(n_keys).to_numpy()[a:b], batch.column(n_keys + 1).to_numpy()[a:b]


def _sums(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running counts, sums and sums of squares; of whole numbers exact."""
    n = np.cumsum(rows)
    if x.dtype.kind == "i":
        most = max(-int(x.min()), int(x.max()))
        if most * most * int(n[-1]) >= _LIMIT:
            x, rows = x.astype(object), rows.astype(object)
    return n, np.cumsum(x * rows), np.cumsum(x * x * rows)


def _whole_loss(n: int, s: int, q: int) -> int:
    """q - s^2 / n, rounded down."""
    return q - (s * s + n - 1) // n if n else 0


def _gain(n: np.ndarray, s: np.ndarray, total: int, all_s: float) -> np.ndarray:
    """What cuts after n rows of sum s take from the whole squares, as floats."""
    rest = total - n
    return np.where(n > 0, s * s / np.maximum(n, 1), 0) + np.where(rest > 0, (all_s - s) ** 2 / np.maximum(rest, 1), 0)


class _Best:
    """The least (loss, value, place) of a bucket while its values pass by, and the value after it."""

    def __init__(self, before: tuple, whole: tuple, exact: bool):
        (self.n, self.s, self.q), self.whole, self.exact = before, whole, exact
        self.best, self.after, self.last, self.top = None, None, False, -np.inf

    def take(self, x: np.ndarray, rows: np.ndarray) -> None:
        if self.last:
            self.after, self.last = x[0], False
        dn, ds, dq = _sums(x, rows)
        total, all_s, all_q = self.whole
        n, s = dn + float(self.n), ds.astype(np.float64) + float(self.s)
        if self.exact:
            for j, value in self._exactly(x, rows, dn, ds, n, s):
                self._offer(value[0], x, j, value[1] == rows[j])
        else:
            rest = total - n
            head = np.maximum(dq + self.q - s * s / n, 0)
            loss = head + np.where(rest > 0, np.maximum(all_q - dq - self.q - (all_s - s) ** 2 / np.maximum(rest, 1), 0), 0)
            j = int(loss.argmin())
            self._offer(float(loss[j]), x, j, True)
        end = int if self.exact else float
        self.n, self.s, self.q = self.n + int(dn[-1]), self.s + end(ds[-1]), self.q + end(dq[-1])

    def _exactly(self, x: np.ndarray, rows: np.ndarray, dn: np.ndarray, ds: np.ndarray, n: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
        """(place, (loss, row of the value)) of cuts that may be the best, in order, with exact losses."""
        total, all_s, all_q = self.whole
        gain = _gain(n, s, total, float(all_s))
        self.top = max(self.top, float(gain.max()))
        least = self.top * (1 - 1e-12) - 4
        before = _gain(np.array([float(self.n)]), np.array([float(self.s)]), total, float(all_s))
        for j in np.flatnonzero(np.maximum(gain, np.append(before, gain[:-1])) >= least).tolist():
            many, v = int(rows[j]), int(x[j])
            n0, s0 = self.n + int(dn[j]) - many, self.s + int(ds[j]) - v * many
            for at in range(0, many, _ROWS):
                i = np.arange(at + 1, min(at + _ROWS, many) + 1)
                for k in i[_gain(n0 + i.astype(np.float64), s0 + i * float(v), total, float(all_s)) >= least].tolist():
                    # losses differ by what the two rounded quotients take from all squares
                    m, a = n0 + k, s0 + k * v
                    value = all_q + _whole_loss(m, a, 0) + _whole_loss(total - m, all_s - a, 0)
                    yield j, (value, k)
                    if value == 0:
                        return

    def _offer(self, value: int | float, x: np.ndarray, j: int, ends: bool) -> None:
        """A cut after a value's last row (`ends`) or between its rows; they come in order, so the first of the least stays."""
        if self.best is None or value < self.best[0]:
            self.best, self.last = (value, x[j].item()), ends and j == len(x) - 1
            self.after = None if self.last else x[j + 1] if ends else x[j]

    def threshold(self, following: float | None) -> float:
        after = following if self.last else self.after
        return float(self.best[1]) if after is None else (float(self.best[1]) + float(after)) / 2


def best_splits(cells: DataFrame, keys: list[str], row_id: str = "row_id", x: str = "x") -> DataFrame:
    """(keys, threshold, loss): the cut of least squared error on both sides; ties go to the lower value and row.

    Keys are whole numbers, and there are few of them. Rows with a null among keys, value or
    row are left out.
    """
    exact = isinstance(cells.schema[x].dataType, T.IntegralType)
    kind = "long" if exact else "double"
    used = [*keys, x] if exact else [*keys, x, row_id]
    rows = cells.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col(x).cast(kind).alias(x), F.col(row_id).cast("long").alias(row_id)).dropna()
    rows = rows.groupBy(*used).agg(F.count("*").alias("rows")) if exact else rows.withColumn("rows", F.lit(1).cast("long"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *used).sortWithinPartitions(*used)
    rows = scan.keep(rows.select(*keys, x, "rows", F.spark_partition_id().alias(scan.PART)))
    n_keys = len(keys)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        end = int if exact else float
        for key, part, v, many in _runs(batches, n_keys):
            own = held.setdefault((*key, part), [0, end(0), end(0), v[0]])
            n, s, q = _sums(v, many)
            own[:3] = own[0] + int(n[-1]), own[1] + end(s[-1]), own[2] + end(q[-1])
        out = [(*key, n, repr(s), repr(q), float(first)) for key, (n, s, q, first) in held.items()]
        kinds = [*[pa.int64()] * (n_keys + 2), pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * len(kinds), kinds)], [*keys, "part", "n", "s", "q", "first"])

    before: dict[tuple, tuple] = {}
    whole: dict[tuple, tuple] = {}
    following: dict[tuple, float] = {}
    last: dict[tuple, int] = {}
    number = int if exact else float
    schema = ", ".join(f"{k} long" for k in keys) + ", part long, n long, s string, q string, first double"
    for r in rows.mapInArrow(sums, schema).orderBy("part").collect():
        key = tuple(r[k] for k in keys)
        n, s, q = whole.get(key, (0, number(0), number(0)))
        before[(*key, r["part"])] = (n, s, q)
        if key in last:
            following[(*key, last[key])] = r["first"]
        last[key], whole[key] = r["part"], (n + r["n"], s + number(r["s"]), q + number(r["q"]))
    state = cells.sparkSession.sparkContext.broadcast((before, whole, following))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, whole, following = state.value
        held: dict[tuple, _Best] = {}
        for key, part, v, many in _runs(batches, n_keys):
            if (*key, part) not in held:
                held[(*key, part)] = _Best(before[(*key, part)], whole[key], exact)
            held[(*key, part)].take(v, many)
        out = [(*key[:-1], own.threshold(following.get(key)), Decimal(own.best[0]) if exact else own.best[0], own.best[1], key[-1]) for key, own in held.items()]
        loss = pa.decimal128(38, 0) if exact else pa.float64()
        kinds = [*[pa.int64()] * n_keys, pa.float64(), loss, pa.int64() if exact else pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * len(kinds), kinds)], [*keys, "threshold", "loss", "x", "part"])

    schema = ", ".join(f"{k} long" for k in keys) + f", threshold double, loss {'decimal(38,0)' if exact else 'double'}, x {kind}, part long"
    found = rows.mapInArrow(cuts, schema)
    best = found.groupBy(*keys).agg(F.min_by("threshold", F.struct("loss", "x", "part")).alias("threshold"), F.min("loss").alias("loss"))
    return best.select(*(F.col(k).cast(cells.schema[k].dataType).alias(k) for k in keys), "threshold", "loss")
