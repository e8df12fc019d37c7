"""Exact trees from attribute lists.

A list holds, for each column, the rows in order of its value, with the codebook's whole
sub-vector: that is all that a tree needs, as its levels look at no other columns. Lists are
sorted once, by ranges of (column, value, row), and written to the shared folder; a column
with very many rows is many parts. A level reads them twice: for sums by (part, column,
node), from which follow the columns to try and what comes before each part, and for the
best cut of each part. Tasks stream; what they hold is one running sum a node.

A list has as many values as the sub-vector is wide for each value of the table: it is for
narrow sub-vectors, and `tree_fit_many` for wide ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import bounds
from . import scan

_SUMS = "part int, dim int, node int, low double, n double, s array<double>, q array<double>"


def attribute_lists(m: DataFrame, layout: list[tuple[int, int]]) -> DataFrame:
    """(dim, v, row_id, sub, _part): every column in order of its values, in parts that hold consecutive rows."""
    own = [F.struct(F.lit(j).alias("dim"), F.get("features", F.lit(j)).alias("v"), F.slice("features", a + 1, b - a).alias("sub")) for a, b in layout for j in range(a, b)]
    rows = m.select("row_id", F.explode(F.array(*own)).alias("p")).select("p.dim", "p.v", "row_id", "p.sub")
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "dim", "v", "row_id").sortWithinPartitions("dim", "v", "row_id")
    return scan.keep(dealt.withColumn(scan.PART, F.spark_partition_id()))


def nodes_of(sub: np.ndarray, first: int, dims: list[int], thresholds: list[float]) -> np.ndarray:
    """The node of each sub-vector in a codebook's tree so far."""
    node = np.zeros(len(sub), np.int64)
    for level, dim in enumerate(dims):
        node = 2 * node + (sub[:, dim - first] > np.asarray(thresholds[(1 << level) - 1 : (2 << level) - 1])[node])
    return node


def _runs(batches: Iterator[pa.RecordBatch], layout: list[tuple[int, int]], chosen: list, thresholds: list, only: set[int] | None) -> Iterator[tuple]:
    """(part, dim, node, v, sub) of a stream of list rows: consecutive rows of a column and node, in order."""
    owner = {j: c for c, (a, b) in enumerate(layout) for j in range(a, b)}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            if only is not None and dim not in only:
                continue
            # rows are in order of the column, so a column's rows are one slice
            at, to = np.searchsorted(dims, dim, "left"), np.searchsorted(dims, dim, "right")
            rows, c = batch.slice(at, to - at), owner[dim]
            sub = pc.list_flatten(rows.column(2)).to_numpy(zero_copy_only=False).reshape(to - at, -1)
            v, node = rows.column(1).to_numpy(), nodes_of(sub, layout[c][0], chosen[c], thresholds[c])
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.unique(node))
            for own in np.split(order, cuts[1:]):
                yield rows.column(3)[0].as_py(), dim, int(node[own[0]]), v[own], sub[own]


def _squared_error(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum(q - s * s / np.maximum(n, 1)[:, None], 0).sum(1) * (n > 0)


class _Cuts:
    """The best cut of one column and node while its rows pass by in order."""

    def __init__(self, n: float, s: np.ndarray, q: np.ndarray, whole: tuple):
        self.n, self.s, self.q, self.whole = n, s, q, whole
        self.open: tuple[float, float] | None = None
        self.best: tuple[float, float, float] | None = None

    def offer(self, loss: float, v: float, following: float) -> None:
        own = (round(loss, 9), v, (v + following) / 2)
        if self.best is None or own < self.best:
            self.best = own

    def take(self, v: np.ndarray, sub: np.ndarray) -> None:
        if self.open is not None and v[0] > self.open[1]:
            self.offer(*self.open, float(v[0]))
        n = self.n + np.arange(1, len(v) + 1)
        s, q = self.s + np.cumsum(sub, 0), self.q + np.cumsum(sub * sub, 0)
        total, all_s, all_q = self.whole
        loss = _squared_error(n, s, q) + _squared_error(total - n, all_s - s, all_q - q)
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            rounded = np.round(loss[at], 9)
            k = at[int(rounded.argmin())]
            self.offer(float(loss[k]), float(v[k]), float(v[k + 1]))
        self.n, self.s, self.q, self.open = float(n[-1]), s[-1], q[-1], (float(loss[-1]), float(v[-1]))

    def end(self, following: float | None) -> tuple[float, float, float] | None:
        """The best cut, given the first value of the column and node after this part; the last one takes all to the left."""
        loss, v = self.open
        if following is None or following > v:
            self.offer(loss, v, v if following is None else following)
        return self.best


def tree_fit_exact(m: DataFrame, dims: int, codebooks: int, depth: int, tried: int) -> tuple[list[list[int]], list[list[float]]]:
    """Split columns and thresholds of all codebooks, from all values: two passes over the lists a level.

    What comes to the driver is one row a part, column and node that meet, and one a column
    and node.
    """
    layout = bounds(dims, codebooks)
    chosen: list[list[int]] = [[] for _ in layout]
    thresholds: list[list[float]] = [[] for _ in layout]
    lists = attribute_lists(m, layout).select("dim", "v", "sub", scan.PART)

    for level in range(depth):

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for part, dim, node, v, sub in _runs(batches, layout, chosen, thresholds, None):
                own = held.setdefault((part, dim, node), [float(v[0]), 0, 0.0, 0.0])
                own[1:] = own[1] + len(v), own[2] + sub.sum(0), own[3] + (sub * sub).sum(0)
            columns = [*zip(*held)] or [(), (), ()], [*zip(*held.values())] or [(), (), (), ()]
            kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.float64())] * 2
            values = [*columns[0], *columns[1][:2], *([x.tolist() for x in c] for c in columns[1][2:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, kinds)], [x.split()[0] for x in _SUMS.split(", ")])

        rows = lists.mapInArrow(sums, _SUMS).orderBy("part").collect()
        whole: dict[tuple[int, int], list] = {}
        before: dict[tuple[int, int, int], tuple] = {}
        after: dict[tuple[int, int, int], float] = {}
        last: dict[tuple[int, int], int] = {}
        for r in rows:
            key, s, q = (r["dim"], r["node"]), np.array(r["s"]), np.array(r["q"])
            n0, s0, q0 = whole.get(key, (0.0, 0.0 * s, 0.0 * q))
            before[r["part"], *key] = (n0, s0, q0)
            if key in last:
                after[last[key], *key] = r["low"]
            last[key], whole[key] = r["part"], (n0 + r["n"], s0 + s, q0 + q)
        tries: set[int] = set()
        for a, b in layout:
            # every column's list holds all sub-vectors of its codebook
            own = [(n, s, q) for (dim, _), (n, s, q) in sorted(whole.items()) if dim == a]
            error = np.sum([np.maximum(q - s * s / n, 0) for n, s, q in own], 0) if own else np.zeros(b - a)
            most = b - a if level == 0 else tried
            tries |= {a + int(j) for j in np.argsort(-np.round(error, 9), kind="stable")[:most]}
        state = m.sparkSession.sparkContext.broadcast((whole, before, after))

        def cuts(batches: Iterator[pa.RecordBatch], tries=tries) -> Iterator[pa.RecordBatch]:
            whole, before, after = state.value
            held: dict[tuple, _Cuts] = {}
            for part, dim, node, v, sub in _runs(batches, layout, chosen, thresholds, tries):
                key = (part, dim, node)
                if key not in held:
                    held[key] = _Cuts(*before[key], whole[dim, node])
                held[key].take(v, sub)
            best = [(*key[1:], *found) for key, x in held.items() for found in [x.end(after.get(key))] if found]
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*best)] or [()] * 5, kinds)], ["dim", "node", "loss", "v", "threshold"])

        found = lists.mapInArrow(cuts, "dim int, node int, loss double, v double, threshold double")
        found = found.groupBy("dim", "node").agg(F.min(F.struct("loss", "v", "threshold")).alias("b")).collect()
        at = {(r["dim"], r["node"]): r["b"] for r in found}
        for c, (a, b) in enumerate(layout):
            own = {j: sum(x["loss"] for (dim, _), x in sorted(at.items()) if dim == j) for j in sorted(tries) if a <= j < b}
            j = min(own, key=lambda x: (own[x], x)) if at and own else a
            chosen[c].append(j)
            thresholds[c] += [float(at[j, node]["threshold"]) if (j, node) in at else 0.0 for node in range(1 << level)]
    return chosen, thresholds
