"""Classification trees that imitate codes, all of them grown together.

For every codebook and level of frequency there is one tree: it tells that level's codes
apart, and from all others. A level of all trees is one scan: tasks find each row's node and
count classes by (tree, column, node, bin); counts of tasks are added up where they meet,
one tree after the other, and give each node's split of least Gini impurity. What comes to the
driver is one row a tree and node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, scan
from .encode import cascade_predict

#: Levels of frequency that a codebook's codes are dealt to.
LEVELS = 3


@dataclass
class ClassTree:
    """Of one codebook and level: its codes in order, and splits or answers by node (1: the root)."""

    codebook: int
    classes: list[int]
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    answers: dict[int, int] = field(default_factory=dict)

    def labels(self, k: np.ndarray) -> np.ndarray:
        """Each code's place among the tree's own; the number of them for all others."""
        own = np.asarray(self.classes, np.int64)
        if not len(own):
            return np.zeros(len(k), np.int64)
        at = np.minimum(np.searchsorted(own, k), len(own) - 1)
        return np.where(own[at] == k, at, len(own))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        node = np.ones(len(x), np.int64)
        for at in sorted(self.splits):
            dim, threshold = self.splits[at]
            here = node == at
            node[here] = 2 * at + (x[here, dim] > threshold)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The code of each row, -1 for those of other levels."""
        codes = np.append(self.classes, -1)
        answer = np.full(2 * max([1, *self.answers]) + 2, len(self.classes), np.int64)
        for node, label in self.answers.items():
            answer[node] = label
        return codes[answer[np.minimum(self.nodes(x), len(answer) - 1)]]


def gini_splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted impurity after each cut between the bins of (bins, classes), and rows to its left."""
    left = np.cumsum(counts, 0)[:-1]
    right = counts.sum(0) - left
    impurity = lambda x: x.sum(1) - (x.astype(float) ** 2).sum(1) / np.maximum(x.sum(1), 1)
    return impurity(left) + impurity(right), left.sum(1)


def _best(columns: list[tuple[int, np.ndarray]]) -> tuple:
    """(dim, bin, n, answer, left answer, right answer) of one node; no dim where no cut lessens the impurity."""
    total = columns[0][1].sum(0)
    n, best = int(total.sum()), None
    whole = n - float((total.astype(float) ** 2).sum()) / max(n, 1)
    for dim, counts in columns:
        loss, left = gini_splits(counts)
        loss = np.where((left > 0) & (left < n), loss, np.inf)
        at = int(loss.argmin()) if len(loss) else 0
        if len(loss) and loss[at] < whole - 1e-9 and (best is None or loss[at] < best[0] - 1e-12):
            left_counts = counts[: at + 1].sum(0)
            best = (loss[at], dim, at, int(left_counts.argmax()), int((total - left_counts).argmax()))
    return (*(best[1:3] if best else (None, None)), n, int(total.argmax()), *(best[3:] if best else (None, None)))


def class_trees(rows: DataFrame, layout: list[tuple[int, int]], classes: list[list[list[int]]], depth: int, bins: int = 32) -> list[ClassTree]:
    """Trees over (features, ks): the row's sub-vectors and its code of each codebook, null where it has none."""
    spark = rows.sparkSession
    dims = layout[-1][1]
    shares = [i / bins for i in range(1, bins)]
    got = rows.agg(*(F.percentile_approx(F.get("features", F.lit(d)), shares, 10_000).alias(f"d{d}") for d in range(dims))).first()
    edges = [np.unique(got[f"d{d}"] or [0.0]) for d in range(dims)]
    trees = [ClassTree(c, sorted(own)) for c, levels in enumerate(classes) for own in levels]
    for level in range(depth):
        state = spark.sparkContext.broadcast((trees, edges))

        def count(batches: Iterator[pa.RecordBatch], state=state, level=level) -> Iterator[pa.RecordBatch]:
            trees, edges = state.value
            total: dict[tuple[int, int], np.ndarray] = {}
            first = many = 1 << level
            for x, ks in _arrays(batches, dims, len(layout)):
                bin_of = [np.searchsorted(e, x[:, d], "left") for d, e in enumerate(edges)]
                for t, tree in enumerate(trees):
                    node, k = tree.nodes(x) - first, ks[:, tree.codebook]
                    at = np.flatnonzero((node >= 0) & (k >= 0))
                    label, wide = tree.labels(k[at]), len(tree.classes) + 1
                    for d in range(*layout[tree.codebook]):
                        size = len(edges[d]) + 1
                        own = np.bincount((node[at] * size + bin_of[d][at]) * wide + label, minlength=many * size * wide)
                        total[t, d] = total[t, d] + own if (t, d) in total else own
            kinds = (pa.int32(), pa.int32(), pa.binary())
            out = [(t, d, counts.astype("<i8").tobytes()) for (t, d), counts in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * 3, kinds)], ["t", "dim", "counts"])

        def split(batches: Iterator[pa.RecordBatch], state=state, level=level) -> Iterator[pa.RecordBatch]:
            trees, edges = state.value
            now, columns, done = None, {}, []

            def close() -> None:
                for n in np.flatnonzero(next(iter(columns.values())).sum(axis=(1, 2))).tolist():
                    done.append((now, (1 << level) + n, *_best([(d, x[n]) for d, x in columns.items()])))

            for batch in batches:
                for t, d, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if t != now and columns:
                        close()
                        columns = {}
                    now = t
                    own = np.frombuffer(data, "<i8").reshape(1 << level, len(edges[d]) + 1, len(trees[t].classes) + 1)
                    columns[d] = columns[d] + own if d in columns else own
            if columns:
                close()
            names = ["t", "node", "dim", "cut", "n", "answer", "left", "right"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([*zip(*done)] or [()] * 8)], names)

        counts = rows.mapInArrow(count, "t int, dim int, counts binary")
        found = counts.repartition("t").sortWithinPartitions("t", "dim").mapInArrow(split, "t long, node long, dim long, cut long, n long, answer long, left long, right long").collect()
        for r in found:
            tree = trees[r["t"]]
            tree.answers[r["node"]] = r["answer"]
            if r["dim"] is not None:
                tree.splits[r["node"]] = (r["dim"], float(edges[r["dim"]][r["cut"]]))
                tree.answers[2 * r["node"]], tree.answers[2 * r["node"] + 1] = r["left"], r["right"]
    return trees


def _arrays(batches: Iterator[pa.RecordBatch], dims: int, codebooks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and codes (-1: none) of batches whose first columns they are."""
    for batch in batches:
        x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, dims)
        k = pc.fill_null(pc.list_flatten(batch.column(1)), -1).to_numpy(zero_copy_only=False).reshape(-1, codebooks)
        yield x, k


def distill(m: DataFrame, near: DataFrame, layout: list[tuple[int, int]], depth: int = 4, bins: int = 32) -> DataFrame:
    """(row_id, c, k, class): what the trees of all levels answer, for every code (row_id, c, k) of a row with features."""
    codebooks, dims = len(layout), layout[-1][1]
    classes: list[list[list[int]]] = [[[] for _ in range(LEVELS)] for _ in layout]
    for r in metrics.classes_by_level(near).collect():
        classes[r["c"]][r["level"]].append(r["k"])
    ks = near.groupBy("row_id").agg(F.array(*(F.max(F.when(F.col("c") == c, F.col("k"))).cast("int") for c in range(codebooks))).alias("ks"))
    usable = m.where((F.size("features") == dims) & ~F.exists("features", lambda v: v.isNull() | F.isnan(v)))
    rows = scan.keep(usable.select("row_id", "features").join(ks, "row_id").select("features", "ks", "row_id"))
    trees = class_trees(rows.select("features", "ks"), layout, classes, depth, bins)
    shared = m.sparkSession.sparkContext.broadcast(trees)

    def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x, ks = np.stack(part["features"]), np.stack([np.array([-1 if v is None or v != v else v for v in k], np.int64) for k in part["ks"]])
                said = np.stack([t.predict(x) for t in shared.value], 1).reshape(len(x), codebooks, LEVELS)
                at, c = np.nonzero(ks >= 0)
                yield pd.DataFrame({"row_id": part["row_id"].to_numpy()[at], "c": c, "k": ks[at, c], **{f"t{i}": said[at, c, i] for i in range(LEVELS)}})

    row_id = m.schema["row_id"].dataType.simpleString()
    answered = rows.mapInPandas(answer, f"row_id {row_id}, c int, k int, t0 int, t1 int, t2 int")
    return cascade_predict(answered, ["t0", "t1", "t2"]).select("row_id", "c", "k", "class")
