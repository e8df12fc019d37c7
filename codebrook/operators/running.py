"""Squared errors of all rows up to each one, or after it, from one sort of the rows.

Rows are dealt by ranges and sorted once; the task that has a part adds up its whole numbers in Arrow
batches and writes rows with their sums inside the part. Of each part only the last row of a
bucket is read again, to carry sums over; rows then get their errors one by one, in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import shared_folder
from . import fit, scan

#: Values below this have squares of 63 bits; buckets below `ROWS` have sums of 63 bits, and squares of rests.
VALUE, ROWS = 3_000_000_000, 1 << 31
_SUMS = ["_n", "_s", "_h", "_l"]
_MASK = (1 << 32) - 1
_BITS = 33


def running_sse(cells: DataFrame, keys: list[str], order: list[str], x: str = "x", tail: bool = False, decimals: bool = True) -> DataFrame:
    """`cells` with n_head and sse_head, of all rows of the bucket up to each one; n_tail and sse_tail, after it.

    Errors of whole numbers are exact, rounded down; without `decimals` the nearest doubles of that.
    `order` is of all rows, without ties. Whole keys of few values travel with the number as one word. Fractions, nulls, keys
    that are floats, and numbers or buckets beyond `VALUE` and `ROWS` go by windows instead.
    """
    kinds = {f.name: f.dataType for f in cells.schema}
    plain = isinstance(kinds[x], T.IntegralType) and not any(isinstance(kinds[k], T.FractionalType) for k in keys)
    if plain:
        per = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count(x).alias("there"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        whole = [k for k in keys if isinstance(kinds[k], T.IntegralType)]
        spans = [F.struct(F.min(k), F.max(k), F.count(k) == F.count("*")).alias(f"_{k}") for k in whole]
        most = per.agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("there")).alias("nulls"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *spans).first()
        plain = most["n"] is not None and most["nulls"] == 0 and most["n"] < ROWS and -VALUE < most["lo"] and most["hi"] < VALUE
    side = "tail" if tail else "head"
    if not plain:
        heads = fit.cum_sse_head(cells, keys, order, x)
        if tail:
            whole = heads.groupBy(*keys).agg(F.count("*").alias("_all"))
            heads = scan.joined(fit.cum_sse_tail(heads, keys, x), whole, keys).withColumn("n_tail", F.col("_all") - F.col("n_head"))
        return heads.select(*cells.columns, f"n_{side}", F.col(f"sse_{side}").cast("decimal(38,0)" if decimals and isinstance(kinds[x], T.IntegralType) else "double").alias(f"sse_{side}"))
    spark = cells.sparkSession
    folder = shared_folder(spark, "sums")
    # (key, its least value, its number of values)
    digits = [(k, most[f"_{k}"][0], most[f"_{k}"][1] - most[f"_{k}"][0] + 1) for k in whole if most[f"_{k}"][2]]
    packed = len(digits) == len(keys) and order[0] == x and set(cells.columns) == {*keys, *order} and math.prod(d[2] for d in digits) < 1 << (63 - _BITS)
    if packed:
        index = F.lit(0).cast("long")
        for k, least, size in digits:
            index = index * size + (F.col(k).cast("long") - least)
        word = F.shiftleft(index, _BITS) + F.col(x).cast("long") + VALUE
        _sorted_sums(cells.select(word.alias("_word"), *order[1:]), None, ["_word", *order[1:]], None, tail).write.parquet(folder)
    else:
        _sorted_sums(cells, keys, order, x, tail).write.parquet(folder)
    rows = spark.read.parquet(folder)
    by = F.shiftright("_word", _BITS).alias("_key") if packed else F.struct(*keys).alias("_key")
    before = scan.parts_before(["_key"])
    ends = rows.where("_end").select(by, scan.PART, *_SUMS)
    held = ends.select(scan.PART, *(F.sum(c).over(before).alias(c) for c in _SUMS)).where("_n IS NOT NULL").collect()
    carry = np.zeros((4, max((r[0] for r in held), default=0) + 1), np.int64)
    for part, *sums in held:
        carry[:, part] = sums
    state = spark.sparkContext.broadcast(carry)
    names = list(cells.columns)
    types = {f.name: f.dataType for f in cells.schema}
    arrow = {k: to_arrow_type(types[k]) for k in [*keys, x]}

    def unpacked(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        word = batch.column("_word").to_numpy()
        index, out = word >> _BITS, {x: pa.array((word & ((1 << _BITS) - 1)) - VALUE).cast(arrow[x])}
        for k, least, size in reversed(digits):
            out[k] = pa.array(index % size + least).cast(arrow[k])
            index = index // size
        return out | {c: batch.column(c) for c in order[1:]}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = state.value
        for batch in batches:
            part = batch.column(scan.PART).to_numpy()
            own = np.where(batch.column("_begun").to_numpy(zero_copy_only=False) & (part < carry.shape[1]), carry[:, np.minimum(part, carry.shape[1] - 1)], 0)
            n, s, h, low = (batch.column(c).to_numpy() + o for c, o in zip(_SUMS, own))
            cells = unpacked(batch) if packed else {c: batch.column(c) for c in names}
            if tail:
                v = cells[x].to_numpy().astype(np.int64)
                n, s, h, low = n - 1, s - v, h - (v * v >> 32), low - (v * v & _MASK)
            words = whole_errors(n, s, h, low)
            yield pa.RecordBatch.from_arrays([*(cells[c] for c in names), pa.array(n), as_decimals(words) if decimals else pa.array(as_doubles(words))], [*names, f"n_{side}", f"sse_{side}"])

    return rows.mapInArrow(finish, T.StructType([*cells.schema.fields, T.StructField(f"n_{side}", T.LongType()), T.StructField(f"sse_{side}", T.DecimalType(38, 0) if decimals else T.DoubleType())]))


def as_decimals(words: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(words), [None, pa.py_buffer(words)])


def as_doubles(words: np.ndarray) -> np.ndarray:
    """The nearest doubles: the first 64 bits, the last of them set if any bit after them is."""
    lo, hi = words[:, 0], words[:, 1]
    bits = np.frexp(hi.astype(np.float64))[1].astype(np.uint64)
    left = np.minimum(np.uint64(64) - bits, np.uint64(63))
    top = np.where(bits > 0, (hi << left) | (lo >> np.minimum(bits, np.uint64(63))) | ((lo << left) != 0), lo)
    return np.ldexp(top.astype(np.float64), bits.astype(np.int32))


def whole_errors(n: np.ndarray, s: np.ndarray, h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """q - s^2 / n rounded down, of squares q = 2^32 h + low; 0 without rows. Exact, as two words of 64 bits, the low one first.

    With s = m n + r, s^2 / n rounded up is m (s + r) and r^2 / n rounded up.
    """
    u = lambda v: v.astype(np.uint64)
    n = np.maximum(n, 1)
    m = s // n
    r = s - m * n
    t = s + r
    a, b, up = u(np.abs(m)), u(np.abs(t)), u((r * r + n - 1) // n)
    half, word = np.uint64(32), np.uint64(_MASK)

    def wide(top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """2^32 top + bottom, as two words."""
        lo = (top << half) + bottom
        return (top >> half) + (lo < bottom), lo

    q_hi, q_lo = wide(u(h), u(low))
    p_hi, p_lo = wide(a * (b >> half), a * (b & word))
    less = (m < 0) == (t < 0)
    lo = q_lo - up
    hi = q_hi - (q_lo < up)
    down, top = lo - p_lo, lo + p_lo
    out = np.empty((len(n), 2), np.uint64)
    out[:, 0] = np.where(less, down, top)
    out[:, 1] = np.where(less, hi - p_hi - (lo < p_lo), hi + p_hi + (top < lo))
    return out


def _sorted_sums(cells: DataFrame, keys: list[str] | None, order: list[str], x: str | None, backwards: bool) -> DataFrame:
    """Rows with the sums of their bucket in their part up to them, whether it began the part, and whether they end it.

    Without keys, the first column of the order is a word of bucket and number.
    """
    by = [*(F.col(k) for k in keys or []), *(F.desc(o) if backwards else F.col(o) for o in order)]
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    fields = [*rows.schema.fields, T.StructField(scan.PART, T.IntegerType()), *(T.StructField(c, T.LongType()) for c in _SUMS), T.StructField("_begun", T.BooleanType()), T.StructField("_end", T.BooleanType())]
    names = [f.name for f in fields]

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
        """The numbers, where a row's bucket is another than the one's before, and the first and last bucket."""
        new = np.zeros(batch.num_rows, bool)
        if keys is None:
            word = batch.column(0).to_numpy()
            index = word >> _BITS
            new[1:] = index[1:] != index[:-1]
            return (word & ((1 << _BITS) - 1)) - VALUE, new, int(index[0]), int(index[-1])
        ks = [batch.column(k) for k in keys]
        for k in ks:
            a, b = k.slice(1), k.slice(0, len(k) - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        return batch.column(x).to_numpy().astype(np.int64), new, *(tuple(k[at].as_py() for k in ks) for at in (0, batch.num_rows - 1))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry, runs, key, waiting = [0, 0, 0, 0], 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, new, first, last = numbers(batch)
            new[0] = waiting is not None and first != key
            if waiting is not None:
                yield pa.RecordBatch.from_arrays([*waiting[0], pa.array(np.append(waiting[1], new[0]))], names)
            begin, run, square, sums = np.flatnonzero(new), np.cumsum(new), v * v, []
            for i, term in enumerate((np.ones(len(v), np.int64), v, square >> 32, square & _MASK)):
                own = np.cumsum(term)
                own = own - np.append(-carry[i], own[begin] - term[begin])[run]
                carry[i] = int(own[-1])
                sums.append(pa.array(own))
            begun, runs, key = runs + run == 0, runs + int(run[-1]), last
            waiting = ([*batch.columns, pa.array(np.full(len(v), part, np.int32)), *sums, pa.array(begun)], new[1:])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([*waiting[0], pa.array(np.append(waiting[1], True))], names)

    return rows.mapInArrow(inside, T.StructType(fields))
