"""k-means of many restarts at once, and its starts."""

import numpy as np
from pyspark.sql import functions as F

from codebrook.operators import fit, kmeans

from .test_learning import table


def lloyd(x, first, rounds):
    c, inertia = first.copy(), 0.0
    for _ in range(rounds):
        k = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        n = np.bincount(k, minlength=len(c))
        means = np.array([x[k == j].mean(0) if n[j] else x[k == n.argmax()].mean(0) * (1 + 1e-3 * (1 + j)) for j in range(len(c))])
        inertia = sum(((x[k == j] - x[k == j].mean(0)) ** 2).sum() for j in range(len(c)) if n[j])
        c = means
    return c, inertia


def clustered(rng, n=1200, centers=12, dims=4):
    at = rng.normal(size=(centers, dims)) * 10
    sizes = np.array([0.4, *[0.6 / (centers - 1)] * (centers - 1)])
    return at[rng.choice(centers, n, p=sizes)] + rng.normal(size=(n, dims)) * 0.2


def test_restarts_at_once_are_as_each_alone(spark):
    x = np.random.default_rng(2).normal(size=(500, 6))
    m = table(spark, x)
    found = fit.kmeans_many(m, 6, 2, k=5, rounds=3, seeds=[4, 9])
    for seed, (centroids, inertia) in found.items():
        first = np.array([r["features"] for r in m.orderBy(F.xxhash64("row_id", F.lit(seed + 1)), "row_id").limit(5).collect()])
        total = 0.0
        for c, (a, b) in enumerate(((0, 3), (3, 6))):
            want, own = lloyd(x[:, a:b], first[:, a:b], 3)
            assert np.allclose(centroids[c], want)
            total += own
        assert abs(inertia - total) < 1e-6
        assert np.allclose(fit.kmeans_fit(m, 6, 2, k=5, rounds=3, seed=seed)[0], centroids)
    assert fit.kmeans_fit(m, 6, 2, k=5, rounds=3, seed=9, restarts=3)[1] == min(i for _, i in fit.kmeans_many(m, 6, 2, k=5, rounds=3, seeds=[9, 10, 11]).values())


def test_oversampled_starts_are_not_worse(spark):
    """Many small groups and a large one: rows by hash miss groups, draws by distance do not."""
    x = np.hstack([clustered(np.random.default_rng(s)) for s in (5, 6)])
    m = table(spark, x)
    by_hash, drawn = (fit.kmeans_many(m, 8, 2, k=12, rounds=4, seeds=[1, 2, 3], start=s) for s in ("hash", "oversampled"))
    for seed in (1, 2, 3):
        assert drawn[seed][1] <= by_hash[seed][1] + 1e-9
    assert max(i for _, i in drawn.values()) < 1.3 * 1200 * 8 * 0.2**2


def test_draws_are_the_twins(spark):
    """The rows drawn in a step are those of least time over the whole table, whatever its parts."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    m = table(spark, x).repartition(7)
    h = {r["row_id"]: r["h"] for r in m.select("row_id", F.xxhash64("row_id").alias("h")).collect()}
    state = [[x[:2, :2].copy(), x[:3, 2:].copy()]]
    got = kmeans._drawn(m, [(0, 2), (2, 4)], 4, [0, 1], [5], state, 10, 1)
    for c, (a, b) in enumerate(((0, 2), (2, 4))):
        d = ((x[:, None, a:b] - state[0][c][None]) ** 2).sum(2).min(1)
        time = kmeans.race(np.array([h[i] for i in range(300)]).view(np.uint64), d, 5, c, 1)
        assert np.allclose([r["sub"] for r in got if r["c"] == c], x[np.argsort(time)[:10], a:b])


def test_race_draws_by_weight():
    weight = np.array([1.0, 3.0, 6.0, 0.0])
    first = [int(kmeans.race(np.arange(4, dtype=np.uint64) + np.uint64(7), weight, s).argmin()) for s in range(6000)]
    assert np.allclose(np.bincount(first, minlength=4) / 6000, weight / 10, atol=0.03)


def test_few_different_rows(spark):
    m = table(spark, np.repeat([[1.0, 2.0], [3.0, 4.0]], 20, 0))
    (centroids, inertia), = fit.kmeans_many(m, 2, 1, k=4, rounds=2, start="oversampled").values()
    assert inertia < 1e-9 and np.shape(centroids[0]) == (4, 2)
    assert fit.kmeans_many(m.limit(0), 2, 1, k=4, start="oversampled") == {0: ([[[0.0, 0.0]] * 4], 0.0)}


def test_bounds_spare_distances_and_change_nothing(spark):
    """The same codes, centroids and inertia as with all distances, ties among them; later rounds take fewer."""
    rng = np.random.default_rng(12)
    x = np.vstack([clustered(rng, 600, 8, 6), np.round(rng.normal(size=(100, 6)))])
    m = table(spark, x)
    centroids, inertia, report = fit.kmeans_bounded(m, 6, 2, k=8, rounds=5, seed=3)
    want, whole = fit.kmeans_fit(m, 6, 2, k=8, rounds=5, seed=3)
    assert all(np.allclose(a, b) for a, b in zip(centroids, want)) and abs(inertia - whole) < 1e-6 * whole
    taken = [t for _, n, t in report]
    assert taken[0] == 700 * 16 and taken[-1] < 0.5 * taken[0]
    assert fit.kmeans_bounded(m.limit(0), 6, 2, k=8) == ([[[0.0] * 3] * 8] * 2, 0.0, [])


def test_pruned_codes_are_the_nearest():
    rng = np.random.default_rng(13)
    sub = np.vstack([rng.normal(size=(400, 3)), np.round(rng.normal(size=(200, 3)) * 2) / 2])
    old = np.round(rng.normal(size=(12, 3)) * 2) / 2
    code, upper, lower = kmeans.two_nearest(sub, old)
    for scale in (0.0, 0.01, 0.3):
        new = old + rng.normal(size=old.shape) * scale
        moved = np.sqrt(((new - old) ** 2).sum(1))
        got, up, low, taken = kmeans.pruned_nearest(sub, new, code, upper.copy(), lower.copy(), moved)
        d = np.sqrt(((sub[:, None] - new[None]) ** 2).sum(2))
        assert (got == ((sub[:, None] - new[None]) ** 2).sum(2).argmin(1)).all()
        assert (up >= d[np.arange(600), got] - 1e-9).all() and (low <= np.sort(d, 1)[:, 1] + 1e-9).all()
        old, code, upper, lower = new, got, up, low
    assert kmeans.two_nearest(sub, old[:1])[0].max() == 0
