"""Queries that learn models, move them through storage, or run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, fit, lut, metrics
from ..plans import api, layout
from ..plans.model import Model, by_rule
from ..sources import tables
from ..streaming import streams
from .analytics import _METRICS
from .base import CELLS, C, D, GOLD, K, LAYOUT, OUTPUTS, cells, coded, codes, lut_table, matrix, query, r4, read, rounded

WEIGHTS = [list(r) for r in GOLD.weights]


def _tree(spark, model: Model):
    return spark.createDataFrame(model.tree_rows(), "c int, level int, node int, dim int, threshold double").withColumn("threshold", r4("threshold"))


@query("tree_fit_exact")
def tree_fit_exact(spark, d):
    return _tree(spark, fit.tree_fit(matrix(spark, d), D, C, exact=True))


def _levels_sql(depth: int) -> str:
    """Levels of exact trees, one after the other, over all cuts between values."""
    steps = ["x AS (SELECT row_id, dim // 8 AS c, dim, x FROM cells), n0 AS (SELECT DISTINCT row_id, c, 0 AS node FROM x)"]
    for l in range(depth):
        steps.append(f"""
r{l} AS (SELECT a.row_id, a.c, a.dim AS try, b.dim, n.node, a.x AS v, b.x AS x FROM x a JOIN x b ON b.row_id = a.row_id AND b.c = a.c JOIN n{l} n ON n.row_id = a.row_id AND n.c = a.c),
s{l} AS (SELECT row_id, c, try, node, v, count(*) OVER h AS n, sum(x) OVER h AS s, sum(x * x) OVER h AS q, count(*) OVER w AS nt, sum(x) OVER w AS st, sum(x * x) OVER w AS qt FROM r{l}
  WINDOW h AS (PARTITION BY c, try, dim, node ORDER BY v, row_id ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY c, try, dim, node)),
l{l} AS (SELECT row_id, c, try, node, v, round(sum(greatest(0, q - s * s / n) + CASE WHEN nt > n THEN greatest(0, qt - q - (st - s) * (st - s) / (nt - n)) ELSE 0 END), 9) AS loss FROM s{l} GROUP BY ALL),
c{l} AS (SELECT *, lead(v) OVER (PARTITION BY c, try, node ORDER BY v, row_id) AS following FROM l{l}),
b{l} AS (SELECT c, try, node, min(loss) AS loss, arg_min(CASE WHEN following IS NULL THEN v ELSE (v + following) / 2 END, (loss, v)) AS threshold FROM c{l} WHERE following IS NULL OR following > v GROUP BY ALL),
d{l} AS (SELECT c, arg_min(try, (loss, try)) AS dim FROM (SELECT c, try, sum(loss) AS loss FROM b{l} GROUP BY c, try) GROUP BY c),
t{l} AS (SELECT b.c, b.node, d.dim, b.threshold FROM b{l} b JOIN d{l} d ON d.c = b.c AND d.dim = b.try),
n{l + 1} AS (SELECT n.row_id, n.c, 2 * n.node + (x.x > t.threshold)::INT AS node FROM n{l} n JOIN t{l} t ON t.c = n.c AND t.node = n.node JOIN x ON x.row_id = n.row_id AND x.dim = t.dim)""")
    out = " UNION ALL ".join(f"SELECT c, {l} AS level, node, dim, round(threshold, 4) AS threshold FROM t{l}" for l in range(depth))
    return f"WITH {CELLS}, {', '.join(steps)} {out}"


@query("tree_fit_exact_levels", _levels_sql(2))
def tree_fit_exact_levels(spark, d):
    """The first two levels of the exact trees, whose every cut SQL can try as well."""
    return _tree(spark, fit.tree_fit(matrix(spark, d), D, C, depth=2, exact=True))


@query("tree_fit_binned")
def tree_fit_binned(spark, d):
    """Trees over all line items: four columns, two codebooks."""
    li = read(spark, d, "lineitem")
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    m = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("features"))
    return _tree(spark, fit.tree_fit(m, 4, 2, depth=3))


@query("tree_fit_wide")
def tree_fit_wide(spark, d):
    """Trees of two wide codebooks, whose first level tries the eight columns of largest squared error."""
    found = fit.tree_fit_many(matrix(spark, d).withColumn("layer", F.lit("")), D, {0: ("", 2)}, first=8)
    return _tree(spark, found[0])


@query("ridge_refine")
def ridge_refine(spark, d):
    """Mean squared error of the rule-made model's trees before and after refinement."""
    m = matrix(spark, d)
    model = Model(GOLD.dims, GOLD.thresholds, fit.bucket_prototypes(m.withColumn("codes", api.codes_of(GOLD)), GOLD, LAYOUT), GOLD.weights)
    out = None
    for name, own in (("means", model), ("ridge", fit.ridge_refine(m, model, D))):
        rebuilt = lut.reconstruct(codes(spark, d), own.prototype_table(spark))
        row = metrics.fit_report(lut.residual(cells(spark, d), rebuilt)).withColumn("prototypes", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("approx_matmul")
def approx_matmul(spark, d):
    """Products of all rows by look-up; learned on the same rows."""
    m = matrix(spark, d)
    y = api.approx_matmul(m, m, WEIGHTS, D, C)
    return rounded(y.select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("approx_matmul_quantized")
def approx_matmul_quantized(spark, d):
    """The same with 8-bit table entries."""
    m = matrix(spark, d)
    y = api.approx_matmul(m, m, WEIGHTS, D, C, quantize=True)
    return rounded(y.select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("approx_linear")
def approx_linear(spark, d):
    m = matrix(spark, d)
    y = api.approx_linear(m, m, WEIGHTS, [0.1 * i for i in range(len(WEIGHTS))], D, C, ridge=False)
    return rounded(y.select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("approx_linear_places")
def approx_linear_places(spark, d):
    """A layer over the quarters of each embedding: rows are numbered by (vec_id, place)."""
    m = matrix(spark, d)
    quarters = m.select(F.col("row_id").alias("vec_id"), F.posexplode(F.array(*(F.slice("features", 16 * i + 1, 16) for i in range(4)))).alias("place", "features"))
    train = quarters.select((F.col("vec_id") * 4 + F.col("place")).alias("row_id"), "features")
    y = api.approx_linear(train, quarters, [r[:16] for r in WEIGHTS], [0.1 * i for i in range(len(WEIGHTS))], 16, 4, lead=["vec_id", "place"], ridge=False)
    return rounded(y.select("vec_id", "place", F.posexplode("y").alias("m", "y")), "y")


_KERNELS = [[round(0.1 * (m + 1) * ((p % 3) - 1) + 0.03 * (p // 9), 3) for p in range(36)] for m in range(2)]


@query("approx_conv2d")
def approx_conv2d(spark, d):
    """Pictures of four channels, 4 x 4 each, with a bias per output."""
    m = matrix(spark, d)
    return rounded(api.approx_conv2d(m, m, _KERNELS, 4, 4, 3, 6, padding=1, channels=4, bias=[0.1, -0.1], ridge=False), "v")


@query("approx_conv2d_kn2col")
def approx_conv2d_kn2col(spark, d):
    """The same pictures, with one model for each place of the kernel."""
    m = matrix(spark, d)
    return rounded(api.approx_conv2d(m, m, _KERNELS, 4, 4, 3, 2, padding=1, channels=4, bias=[0.1, -0.1], loop="kn2col"), "v")


@query("approx_conv2d_dilated")
def approx_conv2d_dilated(spark, d):
    """The same pictures, with kernels whose values lie two apart, in both loop orders."""
    m, out = matrix(spark, d), None
    for loop, codebooks, more in (("im2col", 6, {"ridge": False}), ("kn2col", 2, {})):
        y = api.approx_conv2d(m, m, _KERNELS, 4, 4, 3, codebooks, padding=2, channels=4, loop=loop, dilation=2, **more).withColumn("loop", F.lit(loop))
        out = y if out is None else out.unionByName(y)
    return rounded(out, "v")


@query("fit_many")
def fit_many(spark, d):
    """Thresholds of two layers' trees, of those configurations that are not done."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).cast("string").alias("layer"))
    configs = spark.createDataFrame([("0", 8), ("1", 8), ("1", 4)], "layer string, c int")
    done = spark.createDataFrame([("1", 4)], "layer string, c int")
    found = [(layer, n, *row) for (layer, n), m in api.fit_many(rows, configs, D, done).items() for row in m.tree_rows()]
    return spark.createDataFrame(found, "layer string, n_codebooks int, c int, level int, node int, dim int, threshold double").withColumn("threshold", r4("threshold"))


@query("fit_many_ragged")
def fit_many_ragged(spark, d):
    """Trees of three layers of 16, 64 and 72 columns, with 4, 8 and 9 codebooks of 8 and 16 codes, in one job a level.

    The layers are the first quarter of each embedding, the whole, and the whole with the
    differences of its first nine values.
    """
    whole = F.col("features")
    more = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(whole, i + 1) - F.get(whole, i))
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), f.alias("features")) for n, f in (("quarter", F.slice(whole, 1, 16)), ("whole", whole), ("longer", F.concat(whole, more)))))
    rows = matrix(spark, d).select("row_id", F.explode(layers).alias("l")).select("row_id", "l.*")
    configs = [(layer, c, k) for layer, c in (("quarter", 4), ("whole", 8), ("longer", 9)) for k in (8, 16)]
    models = api.fit_many(rows, configs, {"quarter": 16, "whole": 64, "longer": 72})
    found = [(layer, n, k, *row) for (layer, n, k), m in models.items() for row in m.tree_rows()]
    return spark.createDataFrame(found, "layer string, n_codebooks int, n_codes int, c int, level int, node int, dim int, threshold double").withColumn("threshold", r4("threshold"))


@query("config_sweep")
def config_sweep(spark, d):
    """Errors by number of codebooks and width of the tables."""
    return rounded(api.config_sweep(matrix(spark, d), WEIGHTS, D, [8, 16], (0, 8, 4)), *metrics.METRICS)


@query("config_sweep_many")
def config_sweep_many(spark, d):
    """Errors up to a codebook for each column."""
    return rounded(api.config_sweep(matrix(spark, d), WEIGHTS, D, [8, 64], (0, 8)), *metrics.METRICS)


def _centroids(spark, rows):
    return spark.createDataFrame(rows, "c int, k int, dim int, value double")


@query("pq_kmeans_fit")
def pq_kmeans_fit(spark, d):
    m = matrix(spark, d)
    centroids, _ = fit.kmeans_fit(m, D, C, K, rounds=4, max_points=0)
    return rounded(_centroids(spark, fit.centroid_model(m, D, centroids)), "value")


@query("pq_kmeans_oversampled")
def pq_kmeans_oversampled(spark, d):
    """Inertia of three restarts, started by hash and by oversampling; each kind shares its scans."""
    m, out = matrix(spark, d), []
    for start in ("hash", "oversampled"):
        found = fit.kmeans_many(m, D, C, K, rounds=3, seeds=[1, 2, 3], start=start)
        out += [(start, seed, inertia) for seed, (_, inertia) in found.items()]
    return rounded(spark.createDataFrame(out, "start string, seed int, inertia double"), "inertia")


@query("pq_kmeans_bounded")
def pq_kmeans_bounded(spark, d):
    """Share of all distances that each round takes when rows carry bounds: two codebooks of 32 columns and 64 codes."""
    _, inertia, report = fit.kmeans_bounded(matrix(spark, d), D, 2, 64, rounds=5)
    out = [(step, n, taken, round(taken / (n * 2 * 64), 4), round(inertia, 4)) for step, n, taken in report]
    return spark.createDataFrame(out, "round int, n_rows long, distances long, share double, last_inertia double")


@query("pq_refit_codebook")
def pq_refit_codebook(spark, d):
    m = matrix(spark, d)
    start = [[[GOLD.prototypes[c, k, x] for x in range(a, b)] for k in range(K)] for c, (a, b) in enumerate(LAYOUT)]
    return rounded(_centroids(spark, fit.centroid_model(m, D, fit.refit_codebook(m, start, 3, D, rounds=3, max_points=0))), "value")


@query("best_of_restarts")
def best_of_restarts(spark, d):
    seed, _, inertia = api.best_of_restarts(matrix(spark, d), D, 2, [1, 2], rounds=2, max_points=0)
    return spark.createDataFrame([(seed, round(inertia, 4))], "seed int, inertia double")


@query("lut_refit")
def lut_refit(spark, d):
    """Errors of the rule-made tables and of tables fitted to the exact outputs."""
    exact = lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark))
    fitted = fit.lut_refit(coded(spark, d), exact, C, K)
    out = None
    for name, table in (("given", GOLD.lut()), ("fitted", fitted)):
        y = lut.decode_arrow(coded(spark, d), table).select("row_id", F.posexplode("y").alias("m", "y"))
        row = metrics.error_metrics(metrics.error_pairs(y, exact)).withColumn("tables", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return rounded(out, *metrics.METRICS)


@query("lut_refit_large")
def lut_refit_large(spark, d):
    """Errors of tables of 8 x 1024 codes fitted to the exact outputs, without the matrix of their equations."""
    model, m = by_rule(D, C, 10, 2), matrix(spark, d)
    with_codes = tables.keep(encode.encode_tree_arrow(m, model))
    exact = lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark))
    table = fit.lut_refit(with_codes, exact, C, model.codes, penalty=1.0, tolerance=1e-8)
    y = lut.decode_arrow(with_codes, table, model.codes).select("row_id", F.posexplode("y").alias("m", "y"))
    return rounded(metrics.error_metrics(metrics.error_pairs(y, exact)), *metrics.METRICS)


@query("distill_trees")
def distill_trees(spark, d):
    """Depth-4 classifiers that imitate the nearest codes of every codebook, by frequency level."""
    near = encode.assign_nearest(cells(spark, d), GOLD.prototype_table(spark))
    return api.distill_trees(matrix(spark, d), near, LAYOUT, K)


@query("evaluate", f"WITH {OUTPUTS} SELECT {_METRICS} FROM pairs")
def evaluate(spark, d):
    both = lambda m: metrics.error_metrics(api.both_products(m, GOLD).select(F.explode(F.arrays_zip("a", "d")).alias("p")).select("p.a", "p.d"))
    return rounded(api.evaluate(matrix(spark, d), both), *metrics.METRICS)


@query("model_round_trip", f"WITH {OUTPUTS} SELECT row_id, m, round(y, 4) AS y FROM approx")
def model_round_trip(spark, d):
    """Save, write back, load, and decode with what was loaded."""
    folder = tables.shared_folder(spark, "models")
    tables.model_save(spark, GOLD, folder, "layer1")
    tables.model_writeback(spark, GOLD, folder, "layer1")
    model = tables.model_load(spark, folder, "layer1", C, K)
    y = lut.decode_arrow(encode.encode_tree(matrix(spark, d), model), model.lut())
    return rounded(y.select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("write_and_scan_reports", f"WITH {OUTPUTS}, r AS (SELECT m, avg(abs(a - d)) AS mae FROM pairs GROUP BY m) SELECT m, 'layer' || m AS layer, round(mae, 4) AS mae FROM r WHERE m < 5")
def write_and_scan_reports(spark, d):
    approx = lut.decode_join(codes(spark, d), lut_table(spark))
    report = metrics.error_metrics(metrics.error_pairs(approx, lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark))), "m")
    folder = tables.shared_folder(spark, "reports")
    tables.write_reports(report.withColumn("layer", F.concat(F.lit("layer"), F.col("m").cast("string"))), folder)
    return rounded(tables.scan_run_reports(spark, folder, "layer[0-4]$").select(F.col("m").cast("int").alias("m"), "layer", "mae"), "mae")


@query("stream_encode_decode", f"WITH {OUTPUTS} SELECT row_id, m, round(y, 4) AS y FROM approx")
def stream_encode_decode(spark, d):
    y = streams.drain(streams.encode_decode(streams.stream_table(spark, d, "embeddings"), GOLD), "products")
    return rounded(y.select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("stream_capture", "SELECT label, least(count(*), 15) AS n FROM embeddings GROUP BY label")
def stream_capture(spark, d):
    rows = streams.stream_table(spark, d, "embeddings").select("vec_id", "label")
    return streams.capture(rows, tables.shared_folder(spark, "capture"), "label", "vec_id", 15).groupBy("label").agg(F.count("*").alias("n"))


@query("stream_error_report", f"WITH {OUTPUTS} SELECT label, count(*) AS n, round(avg(abs(a - d)), 4) AS mae, round(avg((a - d) * (a - d)), 4) AS mse, round(2 * avg(abs(a - d)) / (max(d) - min(d)), 4) AS scaled_error, round(2 * avg(a - d) / (max(d) - min(d)), 4) AS scaled_shift FROM pairs JOIN embeddings ON vec_id = row_id GROUP BY label")
def stream_error_report(spark, d):
    sums = streams.error_sums(streams.labelled_pairs(streams.stream_table(spark, d, "embeddings"), GOLD), "label")
    return rounded(streams.error_report(streams.drain(sums, "errors", "complete")), "mae", "mse", "scaled_error", "scaled_shift")


@query("stream_smoothed_metric", "WITH ev AS (SELECT event_type, event_id, round_even(value * 100, 0) AS value FROM events), w AS (SELECT event_type, event_id, avg(value) OVER l AS a, sum(value) OVER g AS s, count(*) OVER g AS n FROM ev WINDOW l AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_type, event_id, round(a, 4) AS avg, floor(s / n * 1000) / 1000 AS global_avg, n FROM w")
def stream_smoothed_metric(spark, d):
    """Files may come in any order: a row waits as long as the table's days, until the stream's end at most."""
    ev = streams.stream_table(spark, d, "events").withColumn("value", F.rint(F.col("value") * 100)).select("event_type", "event_id", "value", "ts")
    out = streams.drain_to_end(lambda e: streams.smoothed(e, "event_type", "event_id", "value", late="40 days"), ev, "smoothed")
    return rounded(out, "avg").withColumn("global_avg", F.floor(F.col("global_avg") * 1000) / 1000)


@query("stream_throughput", "SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def stream_throughput(spark, d):
    return streams.drain(streams.throughput(streams.stream_table(spark, d, "events")), "rates", "complete")
