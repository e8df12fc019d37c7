"""Numpy twins of what is learned and answered end to end, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codebrook.operators import encode, fit, lists, lut, metrics, runs, scan
from codebrook.plans import api, layout
from codebrook.plans.model import Model, by_rule

GOLD = by_rule()


def table(spark, x, **more):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>").withColumns({k: F.lit(v) for k, v in more.items()})


def sse(x):
    return ((x - x.mean(0)) ** 2).sum() if len(x) else 0.0


def grown(x, dims, codebooks, depth, cuts):
    """Trees by trying every cut: `cuts` gives the thresholds between (or at) the values of a column."""
    chosen, thresholds, codes = [], [], []
    for a, b in layout.bounds(dims, codebooks):
        node, own, dim_of, cut_of = np.zeros(len(x), int), x[:, a:b], [], []
        for level in range(depth):
            best = None
            for j in range(b - a):
                total, at = 0.0, []
                for n in range(1 << level):
                    rows = own[node == n]
                    tried = [(sse(rows[rows[:, j] <= t]) + sse(rows[rows[:, j] > t]), t) for t in cuts(rows[:, j])] if len(rows) else [(0.0, 0.0)]
                    loss, t = min(tried, key=lambda p: (round(p[0], 9), p[1]))
                    total, at = total + loss, [*at, t]
                if best is None or total < best[0] - 1e-9:
                    best = (total, j, at)
            dim_of.append(a + best[1])
            cut_of += best[2]
            node = 2 * node + (own[:, best[1]] > np.array(best[2])[node])
        chosen.append(tuple(dim_of))
        thresholds.append(tuple(cut_of))
        codes.append(node)
    return chosen, thresholds, np.array(codes).T


def means(x, codes, dims, codebooks, k):
    return {(c, j, d): x[codes[:, c] == j, d].mean() if (codes[:, c] == j).any() else 0.0 for c, (a, b) in enumerate(layout.bounds(dims, codebooks)) for j in range(k) for d in range(a, b)}


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(1).integers(0, 12, (160, 5)).astype(float)


@pytest.mark.parametrize("exact", [True, False])
def test_trees_against_every_cut(spark, x, exact):
    """The exact fit cuts between values, the binned one at values; twelve values a column have bins of their own."""
    between = lambda v: [*((a + b) / 2 for a, b in zip(np.unique(v), np.unique(v)[1:])), v.max()]
    model = fit.tree_fit(table(spark, x), 5, 2, depth=3, exact=exact)
    chosen, thresholds, codes = grown(x, 5, 2, 3, between if exact else np.unique)
    assert list(model.dims) == chosen
    filled = [[any(codes[:, c] >> (3 - lv) == n) for lv in range(3) for n in range(1 << lv)] for c in range(2)]
    for c in range(2):
        assert np.allclose([t for t, f in zip(model.thresholds[c], filled[c]) if f], [t for t, f in zip(thresholds[c], filled[c]) if f])
    want = means(x, codes, 5, 2, 8)
    assert model.prototypes.keys() == want.keys() and np.allclose([model.prototypes[k] for k in want], list(want.values()))


def test_many_layers_are_as_each_alone(spark):
    rng = np.random.default_rng(3)
    layers = {"a": rng.normal(size=(150, 6)), "b": rng.normal(size=(90, 6)) * 5 + 2, "empty": np.zeros((0, 6))}
    found = api.fit_many({k: table(spark, v) for k, v in layers.items()}, [("a", 3), ("a", 2), ("b", 2), ("empty", 2)], 6, depth=3)
    for name, c in (("a", 3), ("a", 2), ("b", 2)):
        alone = fit.tree_fit(table(spark, layers[name]), 6, c, depth=3)
        assert found[name, c].dims == alone.dims and np.allclose(found[name, c].thresholds, alone.thresholds)
        assert np.allclose(list(found[name, c].prototypes.values()), list(alone.prototypes.values()))
    assert set(found["empty", 2].prototypes.values()) == {0.0}


def same_models(a, b):
    assert a.dims == b.dims and a.prototypes.keys() == b.prototypes.keys()
    assert np.allclose(np.concatenate([np.array(t) for t in a.thresholds]), np.concatenate([np.array(t) for t in b.thresholds]))
    assert np.allclose(list(a.prototypes.values()), list(b.prototypes.values()))


def test_ragged_layers_and_codes_are_as_each_alone(spark):
    """Three widths, two numbers of codes; rows of a wrong length teach nothing."""
    rng = np.random.default_rng(23)
    dims = {"a": 16, "b": 64, "c": 72}
    layers = {n: rng.normal(size=(130, w)) * (1 + w) for n, w in dims.items()}
    tables = {n: table(spark, v) for n, v in layers.items()}
    mixed = {**tables, "a": tables["a"].unionByName(tables["b"].limit(5))}
    configs = [(n, w // 8, k) for n, w in dims.items() for k in (4, 8)]
    found = api.fit_many(mixed, configs, dims)
    assert set(found) == set(configs)
    for n, c, k in configs:
        assert found[n, c, k].codes == k
        same_models(found[n, c, k], fit.tree_fit(tables[n], dims[n], c, depth=k.bit_length() - 1))
    todo = spark.createDataFrame(configs, "layer string, c int, k int")
    assert set(api.fit_many(tables, todo, dims, todo.where("k = 4 OR layer = 'c'"))) == {("a", 2, 8), ("b", 8, 8)}
    with pytest.raises(ValueError):
        api.fit_many(tables, [("a", 2, 6)], dims)


def test_wide_sub_vectors_in_several_scans_give_the_same_trees(spark):
    x = np.random.default_rng(24).normal(size=(90, 24))
    m, config = table(spark, x, layer="l"), {0: ("l", 2, 3)}
    whole = fit.tree_fit_many(m, 24, config, bins=8)
    same_models(fit.tree_fit_many(m, 24, config, bins=8, sums_bytes=9 * 26 * 8 * 5)[0], whole[0])
    parts = list(fit._column_parts([fit._Tree("l", [(0, 12), (12, 24)], [[], []], [[], []], [list(range(12)), list(range(12, 24))], {})], 26 * 5))
    assert len(parts) == 5 and sorted(j for p in parts for js in p[0].values() for j in js) == list(range(24))


def test_first_level_of_the_columns_of_largest_error(spark):
    """The columns tried are those of numpy's largest squared error; with room for all of them nothing changes."""
    rng = np.random.default_rng(25)
    x = rng.normal(size=(200, 24)) * rng.permutation(np.arange(1, 25)) + 3
    m = table(spark, x, layer="l").unionByName(table(spark, x[:50, :12] * 4, layer="half"))
    dims, configs = {"l": 24, "half": 12}, {0: ("l", 2, 2), 1: ("half", 1, 2)}
    same = fit.tree_fit_many(m, dims, configs, bins=8)
    room = fit.tree_fit_many(m, dims, configs, bins=8, first=12)
    for key in configs:
        same_models(room[key], same[key])
    one = fit.tree_fit_many(m, dims, configs, bins=8, first=1)
    for key, own, layout in ((0, x, ((0, 12), (12, 24))), (1, x[:50, :12] * 4, ((0, 12),))):
        assert [c[0] for c in one[key].dims] == [a + int(own[:, a:b].var(0).argmax()) for a, b in layout]
    found = fit._column_errors(m.select("layer", "features"), dims)
    assert np.allclose(found["l"], x.var(0) * 200) and np.allclose(found["half"], (x[:50, :12] * 4).var(0) * 50)
    assert set(fit.tree_fit_many(m.limit(0), dims, configs, first=3)[0].prototypes.values()) == {0.0}
    # all rows of one width, whatever their layer
    alone = fit.tree_fit_many(table(spark, x, layer="l"), 24, {0: (None, 2, 2)}, bins=8, first=12)
    same_models(alone[0], same[0])


def test_first_level_of_wide_sub_vectors_fits_a_task():
    tries = [list(range(a, a + 8)) for a in range(0, 4608, 288)]
    tree = fit._Tree("l", [(a, a + 288) for a in range(0, 4608, 288)], [[] for _ in tries], [[] for _ in tries], tries, {})
    assert len(list(fit._column_parts([tree], fit.SUMS_BYTES // (8 * 65)))) == 1


def test_pairs_of_codes_of_several_lengths_in_one_scan(spark):
    rows = [(i, [int(v) for v in np.random.default_rng(i).integers(0, 4, 1 + i % 3)]) for i in range(60)] + [(90, None), (91, []), (92, [1, None])]
    want = {}
    for _, own in rows[:60]:
        for c1, k1 in enumerate(own):
            for c2, k2 in enumerate(own):
                want[c1, k1, c2, k2] = want.get((c1, k1, c2, k2), 0) + 1
    df = spark.createDataFrame(rows, "row_id long, codes array<int>").repartition(2)
    assert {tuple(r)[:4]: r["n"] for r in metrics.code_gram(df, 4).collect()} == want


def test_odd_tables_do_not_break_the_fits(spark, x):
    none = table(spark, x).limit(0)
    holes = table(spark, x).unionByName(spark.createDataFrame([(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [1.0]), (903, [])], "row_id long, features array<double>"))
    for exact in (True, False):
        empty = fit.tree_fit(none, 5, 2, depth=2, exact=exact)
        assert set(empty.prototypes.values()) == {0.0} and len(empty.dims) == 2
        assert fit.tree_fit(holes, 5, 2, depth=2, exact=exact) == fit.tree_fit(table(spark, x), 5, 2, depth=2, exact=exact)
    centroids, inertia = fit.kmeans_fit(none, 5, 2, k=4)
    assert inertia == 0.0 and np.allclose(np.concatenate([np.ravel(c) for c in centroids]), 0)
    few, _ = fit.kmeans_fit(table(spark, x[:3]), 5, 2, k=8, rounds=2)
    assert np.shape(few[0]) == (8, 3) and fit.kmeans_fit(holes, 5, 2, k=4, rounds=2) == fit.kmeans_fit(table(spark, x), 5, 2, k=4, rounds=2)
    same = fit.tree_fit(table(spark, np.ones((20, 4))), 4, 2, depth=2)
    assert {v for (c, k, d), v in same.prototypes.items()} <= {0.0, 1.0}


def test_kmeans_takes_all_rows_by_default(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(10_000, 2))
    first = np.array([r["features"] for r in table(spark, data).orderBy(F.xxhash64("row_id", F.lit(1)), "row_id").limit(16).collect()])
    for _ in range(2):
        k = ((data[:, None] - first[None]) ** 2).sum(2).argmin(1)
        first = np.array([data[k == j].mean(0) for j in range(16)])
    got, inertia = fit.kmeans_fit(table(spark, data), 2, 1, rounds=2)
    assert np.allclose(got[0], first) and abs(inertia - sum(sse(data[k == j]) for j in range(16))) < 1e-6


def encoded(x, model):
    codes = np.zeros((len(x), model.codebooks), int)
    for c in range(model.codebooks):
        node = np.zeros(len(x), int)
        for level, dim in enumerate(model.dims[c]):
            node = 2 * node + (x[:, dim] > np.array(model.thresholds[c][(1 << level) - 1 : (2 << level) - 1])[node])
        codes[:, c] = node
    return codes


def test_products_by_look_up(spark):
    """Against numpy with the same model; near the true product; 8-bit entries move them by a little."""
    rng = np.random.default_rng(5)
    a, b = rng.random((400, 8)), rng.random((3, 8)).tolist()
    m = table(spark, a)
    got = {q: np.array([r["y"] for r in api.approx_matmul(m, m, b, 8, 4, quantize=q).orderBy("row_id").collect()]) for q in (False, True)}
    model = api.learn(m, b, 8, 4)
    t = np.array(model.lut())
    want = t[:, encoded(a, model) + np.arange(4) * 16].sum(2).T
    assert np.allclose(got[False], want)
    exact = a @ np.array(b).T
    assert np.abs(want - exact).mean() < 0.25 * np.abs(exact - exact.mean(0)).mean()
    _, scale, _ = lut.quantized_table(model.lut())
    assert np.abs(got[True] - want).max() <= 4 * 0.5 / scale + 1e-9 and not np.allclose(got[True], want)
    line = np.array([r["y"] for r in api.approx_linear(m, m, b, [1.0, -2.0, 0.5], 8, 4).orderBy("row_id").collect()])
    assert np.allclose(line, want + np.array([1.0, -2.0, 0.5]))
    assert np.allclose([r["y"] for r in api.approx_linear(m, m, b, None, 8, 4).orderBy("row_id").collect()], want)
    places = m.select(F.floor(F.col("row_id") / 4).alias("batch"), (F.col("row_id") % 4).alias("place"), "features")
    shaped = {(r["batch"], r["place"]): r["y"] for r in api.approx_linear(m, places, b, None, 8, 4, lead=["batch", "place"]).collect()}
    assert len(shaped) == 400 and all(np.allclose(shaped[i // 4, i % 4], want[i]) for i in range(400))


@pytest.mark.parametrize("loop,kernel,stride,padding,dilation", [("kn2col", 3, 1, 1, 1), ("kn2col", 3, 2, 1, 1), ("kn2col", 2, 1, 0, 1), ("im2col", 1, 1, 0, 1), ("kn2col", 3, 1, 2, 2), ("kn2col", 2, 2, 1, 3)])
def test_convolutions_of_few_values_are_exact(spark, loop, kernel, stride, padding, dilation):
    """Two channels of zeros and ones a codebook: sixteen codes tell all apart, so the look-up is the product."""
    rng = np.random.default_rng(7)
    pictures = rng.integers(0, 2, (12, 4, 5, 6)).astype(float)
    kernels, bias = rng.normal(size=(2, 4, kernel, kernel)), [0.5, -1.0]
    m = table(spark, pictures.reshape(12, -1))
    out = api.approx_conv2d(m, m, kernels.reshape(2, -1).tolist(), 5, 6, kernel, 2, stride, padding, channels=4, bias=bias, loop=loop, dilation=dilation, **({"ridge": False} if loop == "im2col" else {}))
    padded = np.pad(pictures, ((0, 0), (0, 0), (padding, padding), (padding, padding)))
    far = dilation * (kernel - 1) + 1
    oh, ow = (5 + 2 * padding - far) // stride + 1, (6 + 2 * padding - far) // stride + 1
    want = np.zeros((12, 2, oh, ow))
    for y in range(oh):
        for z in range(ow):
            want[:, :, y, z] = np.einsum("ncij,mcij->nm", padded[:, :, y * stride : y * stride + far : dilation, z * stride : z * stride + far : dilation], kernels)
    rows = out.collect()
    assert len(rows) == want.size
    for r in rows:
        assert abs(r["v"] - want[r["img_id"], r["ch"], r["y"], r["x"]] - bias[r["ch"]]) < 1e-9


def test_im2col_convolution_is_the_models(spark):
    rng = np.random.default_rng(8)
    pictures, kernels = rng.normal(size=(9, 2, 4, 4)), rng.normal(size=(3, 18))
    m = table(spark, pictures.reshape(9, -1))
    padded, patch = np.pad(pictures, ((0, 0), (0, 0), (1, 1), (1, 1))), []
    for n in range(9):
        patch += [padded[n, :, y : y + 3, z : z + 3].ravel() for y in range(4) for z in range(4)]
    model = api.learn(table(spark, patch), kernels.tolist(), 18, 3, ridge=False)
    want = np.array(model.lut())[:, encoded(np.array(patch), model) + np.arange(3) * 16].sum(2).T
    for r in api.approx_conv2d(m, m, kernels.tolist(), 4, 4, 3, 3, padding=1, channels=2, ridge=False).collect():
        assert abs(r["v"] - want[r["img_id"] * 16 + r["y"] * 4 + r["x"], r["ch"]]) < 1e-9


def test_sweep_and_distilling(spark, data):
    m = layout.matrix(spark.read.parquet(f"{data}/embeddings.parquet"))
    rows = {(r["c"], r["bits"]): r["mse"] for r in api.config_sweep(m, [list(w) for w in GOLD.weights], 64, [4, 8], (0, 8, 4)).collect()}
    assert set(rows) == {(c, b) for c in (4, 8) for b in (0, 8, 4)} and rows[8, 0] < rows[4, 0] and rows[8, 4] > rows[8, 8]
    near = encode.assign_nearest(layout.to_cells(m), GOLD.prototype_table(spark)).cache()
    got = api.distill_trees(m, near, layout.bounds(64, 8), 16).collect()
    assert len(got) == near.count() and {r["c"] for r in got} == set(range(8))
    # three levels of depth 4 beat the share of the most frequent code
    top = near.groupBy("c", "k").count().groupBy("c").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert sum(r["k"] == r["class"] for r in got) > 1.5 * top


def test_solved_tables_and_prototypes(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 4))
    model = fit.tree_fit(table(spark, a), 4, 2, depth=2)
    codes = encoded(a, model)
    onehot = np.zeros((300, 8))
    for c in range(2):
        onehot[np.arange(300), c * 4 + codes[:, c]] = 1
    proto = np.zeros((8, 4))
    for (c, k, d), v in model.prototypes.items():
        proto[c * 4 + k, d] = v
    solved = proto + np.linalg.solve(onehot.T @ onehot + np.eye(8), onehot.T @ (a - onehot @ proto))
    ridge = fit.ridge_refine(table(spark, a), model, 4)
    assert all(abs(ridge.prototypes[c, k, d] - solved[c * 4 + k, d]) < 1e-9 for c in range(2) for k in range(4) for d in range(4))
    y = rng.normal(size=(300, 3))
    outputs = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(300) for j in range(3)], "row_id long, m int, y double")
    coded = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(codes)], "row_id long, codes array<int>")
    want = np.linalg.solve(onehot.T @ onehot + 1e-6 * np.eye(8), onehot.T @ y).T
    assert np.allclose(fit.lut_refit(coded, outputs, 2, 4), want)
    # the same without the matrix; rows without codes, or with a null among them, count nothing
    odd = coded.unionByName(spark.createDataFrame([(900, None), (901, [1, None])], coded.schema))
    assert np.allclose(fit.lut_refit(odd, outputs, 2, 4, penalty=1e-2, largest=0), fit.lut_refit(coded, outputs, 2, 4, penalty=1e-2), atol=1e-8, rtol=0)
    large = fit.ridge_refine(table(spark, a), model, 4, largest=0)
    assert all(abs(large.prototypes[k] - v) < 1e-8 for k, v in ridge.prototypes.items())


def test_products_with_more_codes_than_a_matrix_holds(spark):
    """8 x 1024 codes: the solution's residual is small, and no matrix of codes squared is made."""
    rng = np.random.default_rng(14)
    codes, y = rng.integers(0, 1024, (600, 8)), rng.normal(size=(600, 2))
    coded = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(codes)], "row_id long, codes array<int>")
    outputs = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(600) for j in range(2)], "row_id long, m int, y double")
    t = np.array(fit.lut_refit(coded, outputs, 8, 1024, penalty=0.5))
    onehot = np.zeros((600, 8192))
    onehot[np.arange(600)[:, None], codes + np.arange(8) * 1024] = 1
    assert np.abs(onehot.T @ (onehot @ t.T) + 0.5 * t.T - onehot.T @ y).max() < 1e-8


def test_codes_that_are_null_or_short(spark):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [1, None]), (4, [1]), (5, [1, 1]), (6, [])], "row_id long, codes array<int>")
    t = [[1.0, 2.0, 10.0, 20.0], [3.0, 4.0, 30.0, 40.0]]
    for how in (lut.decode_arrow, lut.decode_lut):
        assert {r["row_id"]: r["y"] for r in how(rows, t, 2).collect()} == {1: [21.0, 43.0], 2: None, 3: None, 4: None, 5: [22.0, 44.0], 6: None}
        assert [r["y"] for r in how(rows.where("row_id = 2"), t, 2).collect()] == [None] and how(rows.limit(0), t, 2).count() == 0
    gram = {tuple(r)[:4]: r["n"] for r in metrics.code_gram(rows.where("size(codes) = 2 OR codes IS NULL"), 2).collect()}
    assert gram == {(0, 0, 0, 0): 1, (0, 0, 1, 1): 1, (1, 1, 0, 0): 1, (1, 1, 1, 1): 2, (0, 1, 0, 1): 1, (0, 1, 1, 1): 1, (1, 1, 0, 1): 1}
    assert metrics.code_gram(rows.limit(0), 2).count() == 0


@pytest.mark.parametrize("decay", [0.0, 0.3, 0.9, 0.999])
def test_moving_average_of_a_long_series(spark, decay):
    v = np.random.default_rng(6).normal(size=3000)
    series = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)] + [(None, 1, 2.0), ("one", 5, 3.0)], "key string, at long, value double")
    got = {(r["key"], r["at"]): r["ema"] for r in runs.ema(series, ["key"], ["at"], decay=decay).collect()}
    want = v[0]
    for i, x in enumerate(v):
        want = x if i == 0 else decay * want + (1 - decay) * x
        assert abs(got["k", i] - want) < 1e-9
    assert got[None, 1] == 2.0 and got["one", 5] == 3.0 and len(got) == 3002


def test_running_statistics_over_parts(spark):
    """One key with nearly all rows, ties in the values, and parts that hold one row of a key."""
    rng = np.random.default_rng(10)
    rows = [("hot" if i % 50 else f"k{i}", i, float(rng.integers(0, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, at long, value double")
    got = {(r["key"], r["at"]): r for r in runs.smoothed_metric(df, ["key"], ["at"], window=7).collect()}
    best = {(r["key"], r["at"]): r["best_before"] for r in runs.best_so_far(df, ["key"], ["at"], "value", 100.0).collect()}
    for key in {k for k, _, _ in rows}:
        own = [(i, v) for k, i, v in rows if k == key]
        for n, (i, v) in enumerate(own):
            held = [x for _, x in own[max(0, n - 6) : n + 1]]
            r = got[key, i]
            assert (r["median"], r["max"], r["last"]) == (sorted(held)[(len(held) - 1) // 2], max(held), v)
            assert abs(r["avg"] - np.mean(held)) < 1e-12 and abs(r["global_avg"] - np.mean([x for _, x in own[: n + 1]])) < 1e-12
            assert best[key, i] == (max(x for _, x in own[:n]) if n else None)


def test_exact_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(13)
    for v in (rng.normal(size=2000), np.repeat([1.0, 5.0], 1000), np.append(rng.random(1999), 1e12), np.array([3.0])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        assert np.allclose(scan.exact_quantiles(df, "v", [0.0, 0.05, 0.5, 0.95, 1.0], bins=8, most=50), np.quantile(v, [0.0, 0.05, 0.5, 0.95, 1.0]))
    assert scan.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_model_with_many_outputs_takes_the_arrow_path(spark):
    model = Model(GOLD.dims, GOLD.thresholds, GOLD.prototypes, tuple(tuple(float((m * d) % 7) for d in range(64)) for m in range(600)))
    coded = spark.createDataFrame([(1, [1] * 8), (2, None)], "row_id long, codes array<int>")
    t = model.lut()
    assert len(t) * len(t[0]) > lut.UNROLL
    got = {r["row_id"]: r["y"] for r in lut.decode_lut(coded, t).collect()}
    assert got[2] is None and np.allclose(got[1], np.array(t)[:, np.arange(8) * 16 + 1].sum(1))


def test_attribute_lists_carry_between_parts(spark):
    """Few columns over more parts, and equal values on both sides of a part's end."""
    rng = np.random.default_rng(31)
    x = np.column_stack([rng.integers(0, 3, 400), rng.integers(0, 40, 400)]).astype(float)
    held = lists.attribute_lists(table(spark, x), [(0, 2)])
    per = {(r["dim"], r["n"]) for r in held.groupBy("dim").agg(F.count_distinct("_part").alias("n")).collect()}
    assert all(n > 1 for _, n in per)
    between = lambda v: [*((a + b) / 2 for a, b in zip(np.unique(v), np.unique(v)[1:])), v.max()]
    chosen, thresholds, _ = grown(x, 2, 1, 2, between)
    model = fit.tree_fit(table(spark, x), 2, 1, depth=2, exact=True)
    assert list(model.dims) == chosen and np.allclose(model.thresholds, thresholds)


def test_deep_trees_in_arrow_batches_give_the_same_codes(spark, data):
    m = layout.matrix(spark.read.parquet(f"{data}/embeddings.parquet")).limit(150)
    odd = m.unionByName(spark.createDataFrame([(9000, None), (9001, [1.0, 2.0]), (9002, [None] * 64)], m.schema))
    model = by_rule(64, 8, 5, 1)
    want = {r["row_id"]: r["codes"] for r in encode.encode_tree(m, model).collect()}
    got = {r["row_id"]: r["codes"] for r in encode.encode_tree_arrow(odd, model).collect()}
    assert {i: got.pop(i) for i in (9000, 9001, 9002)} == {9000: None, 9001: None, 9002: None} and got == want
    assert encode.encode_tree_arrow(m.limit(0), model).count() == 0
