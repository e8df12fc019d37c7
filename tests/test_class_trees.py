"""Classification trees grown from counts against trees grown row by row."""

import numpy as np
import pytest

from codebrook.operators import classify
from codebrook.plans import api

from .test_learning import table


def impurity(y):
    return len(y) - sum((y == v).sum() ** 2 for v in np.unique(y)) / len(y) if len(y) else 0.0


def grown(x, y, depth, node=1, out=None):
    """{node: (dim, last value to the left)} and {node: most frequent label}, all cuts tried."""
    splits, answers = out = out or ({}, {})
    labels, n = np.unique(y, return_counts=True)
    answers[node] = int(labels[n.argmax()])
    best = None
    for d in range(x.shape[1]):
        for v in np.unique(x[:, d])[:-1]:
            loss = impurity(y[x[:, d] <= v]) + impurity(y[x[:, d] > v])
            if loss < impurity(y) - 1e-9 and (best is None or loss < best[0] - 1e-12):
                best = (loss, d, v)
    if best and depth:
        _, d, v = best
        splits[node] = (d, float(v))
        grown(x[x[:, d] <= v], y[x[:, d] <= v], depth - 1, 2 * node, out)
        grown(x[x[:, d] > v], y[x[:, d] > v], depth - 1, 2 * node + 1, out)
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(41)
    x = rng.integers(0, 10, (300, 5)).astype(float)
    k = np.stack([(x[:, 0] // 3 + 2 * (x[:, 1] > 4)).astype(int), (x[:, 2] + x[:, 4]).astype(int) // 3], 1)
    k[rng.random(300) < 0.1, 0] = 7
    return x, k


def test_all_trees_at_once_are_as_each_alone(spark, made):
    x, k = made
    near = spark.createDataFrame([(i, c, int(k[i, c])) for i in range(300) for c in range(2)], "row_id long, c int, k int")
    layout = [(0, 3), (3, 5)]
    ks = spark.createDataFrame([([float(v) for v in r], [int(v) for v in q]) for r, q in zip(x, k)], "features array<double>, ks array<int>").repartition(5)
    classes = [[[0, 3], [1, 7], [2, 5]], [[1, 2], [3], [0, 4, 5, 6]]]
    trees = classify.class_trees(ks, layout, classes, 3)
    for t, tree in enumerate(trees):
        a, b = layout[tree.codebook]
        own = sorted(classes[tree.codebook][t % 3])
        y = np.array([own.index(v) if v in own else len(own) for v in k[:, tree.codebook]])
        splits, answers = grown(x[:, a:b], y, 3)
        assert {n: (d - a, v) for n, (d, v) in tree.splits.items()} == splits
        leaves = {n for n in answers if n not in splits}
        assert {n: tree.answers[n] for n in leaves} == {n: answers[n] for n in leaves}
    got = api.distill_trees(table(spark, x), near, layout, 16).collect()
    assert len(got) == 600 and np.mean([r["k"] == r["class"] for r in got]) > 0.6


def test_odd_rows(spark, made):
    """Rows without features, rows with codes of some codebooks only, and no rows at all."""
    x, k = made
    near = spark.createDataFrame([(i, c, int(k[i, c])) for i in range(300) for c in range(2) if i % 3 or c], "row_id long, c int, k int")
    m = table(spark, x).unionByName(spark.createDataFrame([(5000, None), (5001, [1.0])], "row_id long, features array<double>"))
    more = near.unionByName(spark.createDataFrame([(5000, 0, 1), (5001, 1, 1), (9999, 0, 2)], near.schema))
    a, b = (sorted(tuple(r) for r in api.distill_trees(rows, codes, [(0, 3), (3, 5)], 16).collect() if r["row_id"] < 5000) for rows, codes in ((table(spark, x), near), (m, more)))
    assert len(a) == len(b) == near.count()
    assert api.distill_trees(m.limit(0), near, [(0, 3), (3, 5)], 16).count() == 0
    assert api.distill_trees(m, near.limit(0), [(0, 3), (3, 5)], 16).count() == 0
