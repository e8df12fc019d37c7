"""Cases that show whether a registered query takes its whole table."""

import numpy as np
import pytest

from codebrook import registry
from codebrook.catalog.base import C, D, LAYOUT, K
from codebrook.plans import layout


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A folder with more embeddings than 256 a code."""
    folder = str(tmp_path_factory.mktemp("large"))
    x = np.random.default_rng(2).normal(size=(5000, D)).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 10) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def lloyd(x, first, rounds):
    """Centroids and inertia as each round's aggregation has them."""
    centroids = first.copy()
    for _ in range(rounds):
        k = ((x[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        centroids = np.array([x[k == j].mean(0) for j in range(len(centroids))])
        inertia = ((x - centroids[k]) ** 2).sum()
    return centroids, inertia


def starts(m, seed, k):
    from pyspark.sql import functions as F

    return np.array([r["features"] for r in m.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(k).collect()])


@pytest.fixture(scope="module")
def m(spark, large):
    return layout.matrix(spark.read.parquet(f"{large}/embeddings.parquet"))


@pytest.fixture(scope="module")
def x(m):
    return np.array([r["features"] for r in m.orderBy("row_id").collect()])


def test_kmeans_takes_all_rows(spark, large, m, x):
    first = starts(m, 1, K)
    for name, rounds, blocks in (("pq_kmeans_fit", 4, range(C)), ("pq_refit_codebook", 3, [3])):
        got = {(r["c"], r["k"], r["dim"]): r["value"] for r in registry.queries()[name](spark, large).collect()}
        for c in blocks:
            a, b = LAYOUT[c]
            want, _ = lloyd(x[:, a:b], first[:, a:b], rounds)
            assert np.allclose([[got[c, k, d] for d in range(a, b)] for k in range(K)], want, atol=2e-4), name


def test_restarts_are_judged_on_all_rows(spark, large, m, x):
    want = {seed: sum(lloyd(x[:, a:b], starts(m, seed + 1, K)[:, a:b], 2)[1] for a, b in layout.bounds(D, 2)) for seed in (1, 2)}
    r = registry.queries()["best_of_restarts"](spark, large).first()
    assert r["seed"] == min(want, key=want.get) and abs(r["inertia"] - want[r["seed"]]) < 1e-2


def test_every_row_has_its_products(spark, data):
    got = registry.queries()["approx_matmul"](spark, data).groupBy("row_id").count().collect()
    want = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()
    assert {r["row_id"]: r["count"] for r in got} == {r["vec_id"]: 10 for r in want}


def test_patches_are_cut_from_whole_batches(spark, monkeypatch):
    """No expression for each value of a patch; pictures that are short, null or hold nulls keep their patches."""
    from codebrook.operators import images

    monkeypatch.setattr(images, "PATCH_VALUES", 100)
    pictures = {i: [float(10 * i + j) for j in range(8)] for i in range(7)} | {7: [1.0] * 5, 8: None, 9: [None, 2.0] * 4}
    df = spark.createDataFrame(list(pictures.items()), "row_id long, features array<double>").repartition(2)
    got = images.patch_rows(df, 2, 2, 2, padding=2, channels=2, dilation=2)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, v in pictures.items():
        v = [*(v or []), *[None] * 8][:8]
        for oy in range(4):
            for ox in range(4):
                spots = [(c, oy + 2 * ky - 2, ox + 2 * kx - 2) for c in range(2) for ky in range(2) for kx in range(2)]
                want[16 * i + 4 * oy + ox] = [v[4 * c + 2 * y + x] if 0 <= y < 2 and 0 <= x < 2 else 0.0 for c, y, x in spots]
    assert {r["row_id"]: r["features"] for r in got.collect()} == want
