"""Running statistics and quantiles with nulls, infinities and many parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codebrook.operators import fit, metrics, running, runs, scan, splits


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 8])
def test_nulls_in_a_window(spark, parts, n):
    """Every fifth value null, a key of nulls, a key that begins with some: the same for any number of parts."""
    parts(n)
    rows = [("a", i, None if i % 5 == 0 else float((7 * i) % 11)) for i in range(40)] + [("none", i, None) for i in range(4)] + [("late", i, None if i < 6 else 2.0 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, at long, value double")
    got = {(r["key"], r["at"]): r for r in runs.smoothed_metric(df, ["key"], ["at"], window=4).collect()}
    assert len(got) == len(rows)
    ema = {(r["key"], r["at"]): r["ema"] for r in runs.ema(df, ["key"], ["at"], decay=0.5).collect()}
    for key in ("a", "none", "late"):
        own, average = [v for k, _, v in rows if k == key], None
        for i, v in enumerate(own):
            held, every = ([x for x in xs if x is not None] for xs in (own[max(0, i - 3) : i + 1], own[: i + 1]))
            r = got[key, i]
            assert (r["median"], r["max"], r["last"]) == (sorted(held)[(len(held) - 1) // 2] if held else None, max(held, default=None), v)
            assert r["avg"] == (None if not held else pytest.approx(np.mean(held)))
            assert r["global_avg"] == (None if not every else pytest.approx(np.mean(every)))
            average = average if v is None else v if average is None else 0.5 * average + 0.5 * v
            assert ema[key, i] == (None if average is None else pytest.approx(average))


def test_quantiles_of_every_key_at_once(spark):
    rng = np.random.default_rng(17)
    own = {"even": rng.random(700), "ties": np.repeat([1.0, 1.0, 5.0], 100), "far": np.append(rng.random(299), 1e300), None: rng.normal(size=50), "one": np.array([3.0]), "wide": np.array([-1.7e308, 1.7e308, 0.0] * 40)}
    rows = [(k, float(v)) for k, x in own.items() for v in x] + [("one", None), ("one", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    for most in (20, 100_000):
        got = {(r["key"], r["share"]): r["value"] for r in scan.quantiles_by(df, ["key"], "v", shares, bins=8, most=most).collect()}
        assert len(got) == 7 * len(shares)
        for k, x in own.items():
            with np.errstate(over="ignore", invalid="ignore"):
                want = np.quantile(np.sort(x), shares)
            for s, w in zip(shares, want):
                assert np.isclose(got[k, s], w, rtol=1e-12) or not np.isfinite(w), (k, s)
        assert all(got["nothing", s] is None for s in shares)


def test_scans_do_not_depend_on_the_number_of_ranks(spark):
    df = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") * 7 % 3001).cast("double").alias("v"))
    scans = []
    for shares in ([0.5], [i / 20 for i in range(21)]):
        seen, plain = [], scan._meeting
        scan._meeting = lambda *a, plain=plain, seen=seen: (seen.append(1), plain(*a))[1]
        try:
            got = scan.quantiles_by(df, ["key"], "v", shares, bins=16, most=40).collect()
        finally:
            scan._meeting = plain
        assert np.allclose(sorted(r["value"] for r in got), np.quantile([i * 7 % 3001 for i in range(3000)], shares))
        scans.append(len(seen))
    assert scans[0] == scans[1]


def test_an_infinite_value_ends(spark):
    v = [float(i) for i in range(200)]
    df = spark.createDataFrame([(x,) for x in [*v, float("inf")]], "v double")
    assert scan.exact_quantiles(df, "v", [0.5, 0.9, 1.0], bins=8, most=50) == [100.0, 180.0, float("inf")]
    both = df.unionByName(spark.createDataFrame([(float("-inf"),)], "v double"))
    assert scan.exact_quantiles(both, "v", [0.0, 0.5], bins=8, most=50) == [float("-inf"), 99.5]
    assert metrics.trimmed_range(both, "v").count() > 150


def test_best_cuts_are_those_of_the_row_level_form(spark, parts):
    """Two passes against all cuts listed row by row: whole numbers large enough to leave 64 bits, ties, one value alone."""
    parts(5)
    rng = np.random.default_rng(19)
    values = {0: rng.integers(0, 6, 300), 1: rng.integers(-(10**10), 10**10, 200), 2: np.full(30, 7), 3: np.array([5]), 4: rng.integers(0, 10**7, 400)}
    rows = [(k % 2, k, i, int(v)) for k, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "c int, node int, row_id long, x long")
    keys, order = ["c", "node"], ["x", "row_id"]
    for cells in (df, df.where("node <> 1").withColumn("x", F.col("x").cast("double"))):
        full = fit.split_candidates(fit.cum_sse_tail(fit.cum_sse_head(cells, keys, order), keys), keys, order)
        want = {(r["c"], r["node"]): (r["threshold"], r["loss"]) for r in fit.best_split(full, keys).collect()}
        got = {(r["c"], r["node"]): (r["threshold"], r["loss"]) for r in splits.best_splits(cells, keys).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == want[k] or (cells is not df and abs(got[k][1] - want[k][1]) <= 1e-9 * abs(want[k][1]))
    assert splits.best_splits(df.limit(0), keys).count() == 0


def test_sums_of_squares_beyond_64_bits(spark):
    """Two columns of whole numbers: one whose squares add up to more than a long holds, one of small values."""
    own = {0: [4_000_000_001 - 7 * i for i in range(40)], 1: list(range(-20, 20))}
    cells = spark.createDataFrame([(0, dim % 1, dim, x) for dim, xs in own.items() for x in xs], "c int, node int, dim int, x long")
    stats = metrics.bucket_stats(cells)
    got = {r["dim"]: (r["n"], int(r["sum_x"]), int(r["sum_x2"])) for r in stats.collect()}
    assert got == {dim: (40, sum(xs), sum(x * x for x in xs)) for dim, xs in own.items()}
    shown = metrics.as_longs(stats, "sum_x", "sum_x2")
    assert dict(shown.dtypes)["sum_x"] == "bigint" and dict(shown.dtypes)["sum_x2"] == "decimal(38,0)"
    assert dict(metrics.as_longs(stats.where("dim = 1"), "sum_x2").dtypes)["sum_x2"] == "bigint"
    assert {r["dim"]: int(r["sum_x2"]) for r in shown.collect()} == {dim: sum(x * x for x in xs) for dim, xs in own.items()}
    assert all(r["sse"] >= 0 for r in metrics.bucket_sse(stats).collect())
    assert [(r["dim"], r["rank"]) for r in fit.rank_split_dims(metrics.bucket_sse(stats), 1).collect()] == [(0, 1)]


@pytest.mark.parametrize("n", [1, 7])
@pytest.mark.parametrize("kind", ["far", "near", "same"])
def test_errors_of_whole_numbers_in_any_number_of_parts(spark, parts, n, kind):
    """Large and negative numbers, many ties and a key of nulls: exact, whatever the parts."""
    parts(n)
    rng = np.random.default_rng(5)
    draw = {"far": lambda: int(rng.integers(-2_999_999_999, 2_999_999_999)), "near": lambda: int(rng.integers(-3, 4)), "same": lambda: 2_999_999_999}[kind]
    rows = [(None if k == 0 else k, i, draw()) for k, size in ((0, 30), (1, 1), (2, 400), (3, 70)) for i in range(size)]
    cells = spark.createDataFrame(rows, "node int, row_id long, x long")
    for tail in (False, True):
        got = {(r["node"], r["row_id"]): tuple(map(int, r[-2:])) for r in running.running_sse(cells, ["node"], ["x", "row_id"], tail=tail).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            own = sorted((x, i) for node, i, x in rows if node == k)
            for at, (_, i) in enumerate(own):
                xs = [x for x, _ in (own[at + 1 :] if tail else own[: at + 1])]
                want[k, i] = (len(xs), sum(x * x for x in xs) - -(-(sum(xs) ** 2) // len(xs)) if xs else 0)
        assert got == want
        # without the key of nulls, key and number are one word
        near = running.running_sse(cells.where("node IS NOT NULL"), ["node"], ["x", "row_id"], tail=tail, decimals=False)
        assert {(r["node"], r["row_id"]): tuple(r[-2:]) for r in near.collect()} == {k: (n, float(e)) for k, (n, e) in want.items() if k[0] is not None}


def test_errors_beyond_what_fits_go_by_windows(spark):
    cells = spark.createDataFrame([(1, i, x) for i, x in enumerate([-4_000_000_000, 0, 4_000_000_001])] + [(2, 0, 5)], "node int, row_id long, x long")
    got = {(r["node"], r["row_id"]): (r["n_tail"], int(r["sse_tail"])) for r in running.running_sse(cells, ["node"], ["x", "row_id"], tail=True).collect()}
    assert got == {(1, 0): (2, 8_000_000_004_000_000_000), (1, 1): (1, 0), (1, 2): (0, 0), (2, 0): (0, 0)}
    assert running.running_sse(cells.limit(0), ["node"], ["x", "row_id"]).count() == 0


def test_best_cuts_sort_values_not_rows(spark, parts, monkeypatch):
    """Whole numbers of few values: what is sorted and kept is a row a value, and cuts between equal values are tried as well."""
    parts(3)
    kept, plain = [], splits.scan.keep
    monkeypatch.setattr(splits.scan, "keep", lambda df: (kept.append(plain(df)), kept[-1])[1])
    rng = np.random.default_rng(23)
    values = {0: rng.integers(0, 3, 900), 1: np.full(400, 9), 2: np.repeat([-1, 0, 1], [50, 301, 50]), 3: np.array([4, 4, 4]), 4: np.repeat([1, 2], [2, 1]), **{5 + i: rng.integers(0, 2 + i % 3, 3 + i) for i in range(20)}}
    df = spark.createDataFrame([(k, i, int(v)) for k, x in values.items() for i, v in enumerate(x)] + [(0, None, 5), (0, 7000, None)], "node int, row_id long, x long")
    got = {r["node"]: (r["threshold"], r["loss"]) for r in splits.best_splits(df, ["node"]).collect()}
    for k, x in values.items():
        x = sorted(int(v) for v in x)
        floor = lambda v: sum(i * i for i in v) - (sum(v) ** 2 + len(v) - 1) // len(v) if v else 0
        cuts = [(floor(x[: i + 1]) + floor(x[i + 1 :]), v, i) for i, v in enumerate(x)]
        loss, v, i = min(cuts)
        assert got[k] == ((v + x[i + 1]) / 2 if i + 1 < len(x) else v, loss)
    assert kept[0].count() == sum(len(set(x.tolist())) for x in values.values())
