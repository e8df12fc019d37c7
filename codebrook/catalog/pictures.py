"""Queries on pictures, run metrics, registries and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, metrics, runs
from ..sources import tables
from .base import CELLS, FEATURES, matrix, query, r4, read, rounded

_PX = f"{CELLS}, px AS (SELECT row_id AS img_id, 0 AS ch, (dim // 8)::INT AS y, (dim % 8)::INT AS x, x AS v FROM cells)"


def px(spark, d):
    return images.pixels(matrix(spark, d), 8)


_COLS = f"{FEATURES}, o AS (SELECT unnest(range(8)) AS oy), p AS (SELECT unnest(range(8)) AS ox), ky AS (SELECT unnest(range(3)) AS ky), kx AS (SELECT unnest(range(3)) AS kx), cols AS (SELECT row_id AS img_id, oy::INT AS oy, ox::INT AS ox, (ky * 3 + kx)::INT AS pos, CASE WHEN oy + ky - 1 BETWEEN 0 AND 7 AND ox + kx - 1 BETWEEN 0 AND 7 THEN f[(oy + ky - 1) * 8 + ox + kx] ELSE 0 END AS v FROM mat, o, p, ky, kx)"


@query("im2col", f"WITH {_COLS} SELECT img_id, oy, pos, round(sum(v * (ox + 1)), 4) AS v FROM cols GROUP BY img_id, oy, pos")
def im2col(spark, d):
    cols = images.im2col(matrix(spark, d), 8, 8, 3, padding=1)
    return cols.groupBy("img_id", "oy", "pos").agg(r4(F.sum(F.col("v") * (F.col("ox") + 1))).alias("v"))


_KERNEL = [(m, 0, y, x, round(0.1 * (m + 1) * (y - 1) + 0.05 * x, 3)) for m in range(3) for y in range(3) for x in range(3)]


@query("kn2col_slice", f"WITH {_COLS}, kern(m, ch, ky, kx, w) AS (SELECT * FROM (VALUES {', '.join(map(str, _KERNEL))}) t) SELECT img_id, m, oy, ox, round(sum(v * w::DOUBLE), 4) AS y FROM cols JOIN kern ON pos = ky * 3 + kx GROUP BY img_id, m, oy, ox")
def kn2col_slice(spark, d):
    kern = spark.createDataFrame(_KERNEL, "m int, ch int, ky int, kx int, w double")
    return rounded(images.kn2col(px(spark, d), kern, 8, 8, 3, padding=1), "y")


@query("max_pool", f"WITH {_PX} SELECT img_id, ch, (y // 2)::INT AS py, (x // 2)::INT AS px, round(max(v), 4) AS v FROM px GROUP BY ALL")
def max_pool(spark, d):
    return rounded(images.pool(px(spark, d), 2), "v")


@query("avg_pool", f"WITH {_PX} SELECT img_id, ch, round(avg(v), 4) AS v FROM px GROUP BY img_id, ch")
def avg_pool(spark, d):
    return rounded(images.global_avg_pool(px(spark, d)), "v")


@query("channel_moments", "SELECT l_linenumber, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_quantity), 4) AS var FROM lineitem GROUP BY l_linenumber")
def channel_moments(spark, d):
    li = read(spark, d, "lineitem")
    a, b = metrics.channel_moments(li, "l_linenumber", "l_extendedprice"), metrics.channel_moments(li, "l_linenumber", "l_quantity")
    return rounded(a.select("l_linenumber", "mean").join(b.select("l_linenumber", "var"), "l_linenumber"), "mean", "var")


_BN = "mo AS (SELECT l_linenumber, avg(l_quantity) AS mean, var_pop(l_quantity) AS var FROM lineitem GROUP BY l_linenumber)"


@query("batch_norm", f"WITH {_BN} SELECT l_orderkey, l_linenumber, round((l_quantity - mean) / sqrt(var + 1e-5), 4) AS bn FROM lineitem JOIN mo USING (l_linenumber)")
def batch_norm(spark, d):
    return rounded(images.batch_norm(read(spark, d, "lineitem"), "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "bn"), "bn")


@query("batch_norm_fused", "WITH q AS (SELECT l_orderkey, l_linenumber, round_even(l_quantity / 0.5, 0)::INT + 3 AS q FROM lineitem), mo AS (SELECT l_linenumber, avg((q - 3) * 0.5::DOUBLE) AS mean, var_pop((q - 3) * 0.5::DOUBLE) AS var FROM q GROUP BY l_linenumber) SELECT l_orderkey, l_linenumber, round(((q - 3) * 0.5::DOUBLE - mean) / sqrt(var + 1e-5), 4) AS bn FROM q JOIN mo USING (l_linenumber)")
def batch_norm_fused(spark, d):
    q = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.rint(F.col("l_quantity") / 0.5).cast("int") + 3).alias("q"))
    return rounded(images.batch_norm_fused(q, "l_linenumber", "q", 0.5, 3.0).select("l_orderkey", "l_linenumber", "bn"), "bn")


@query("fold_output", f"WITH {CELLS} SELECT row_id // 16 AS img_id, dim AS ch, ((row_id % 16) // 4)::INT AS y, ((row_id % 16) % 4)::INT AS x, round(x, 4) AS v FROM cells")
def fold_output(spark, d):
    from ..plans.layout import to_cells

    rows = to_cells(matrix(spark, d)).select("row_id", F.col("dim").alias("m"), F.col("x").alias("y"))
    return rounded(images.fold_output(rows, 4, 4), "v")


@query("normalize_pixels", f"WITH {_PX} SELECT img_id, ch, y, x, round((v - 0.02) / 0.25, 4) AS v FROM px")
def normalize_pixels(spark, d):
    return rounded(images.normalize(px(spark, d), [0.02], [0.25]), "v")


@query("crop_pad_flip", f"WITH {_PX}, mv AS (SELECT img_id, ch, y + 2 - (img_id % 5)::INT AS y, x + 2 - (img_id % 3)::INT AS x, v, img_id % 2 = 1 AS f FROM px), k AS (SELECT * FROM mv WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7) SELECT img_id, ch, y, CASE WHEN f THEN 7 - x ELSE x END AS x, round(v, 4) AS v FROM k")
def crop_pad_flip(spark, d):
    shift = F.struct((F.col("img_id") % 5).cast("int").alias("dy"), (F.col("img_id") % 3).cast("int").alias("dx"))
    return rounded(images.crop_pad_flip(px(spark, d), 8, 8, 2, shift, F.col("img_id") % 2 == 1), "v")


@query("center_crop", f"WITH {_PX} SELECT img_id, ch, y - 2 AS y, x - 2 AS x, round(v, 4) AS v FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def center_crop(spark, d):
    return rounded(images.center_crop(px(spark, d), 8, 8, 4), "v")


@query("stride_pad_channels", f"WITH {_PX} SELECT img_id, ch + 4 AS ch, (y // 2)::INT AS y, (x // 2)::INT AS x, round(v, 4) AS v FROM px WHERE y % 2 = 0 AND x % 2 = 0")
def stride_pad_channels(spark, d):
    return rounded(images.stride_pad_channels(px(spark, d), 4), "v")


# runs and registries


@query("smoothed_metric", "WITH ev AS (SELECT event_type, event_id, round_even(value * 100, 0) AS value FROM events), w AS (SELECT event_type, event_id, value, list(value) OVER l AS held, avg(value) OVER l AS a, max(value) OVER l AS mx, sum(value) OVER g AS s, count(*) OVER g AS n FROM ev WINDOW l AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_type, event_id, round(list_sort(held)[((len(held) - 1) // 2) + 1], 4) AS median, round(a, 4) AS avg, round(mx, 4) AS max, round(value, 4) AS last, floor(s / n * 1000) / 1000 AS global_avg FROM w")
def smoothed_metric(spark, d):
    """In whole cents, so that running sums are exact."""
    cents = read(spark, d, "events").withColumn("value", F.rint(F.col("value") * 100))
    s = runs.smoothed_metric(cents, ["event_type"], ["event_id"])
    return rounded(s, "median", "avg", "max", "last").withColumn("global_avg", F.floor(F.col("global_avg") * 1000) / 1000)


@query("ema", "WITH w AS (SELECT event_type, event_id, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events) SELECT event_type, event_id, round(list_reduce(held, lambda s, x: s * 0.9::DOUBLE + x * 0.1::DOUBLE), 4) AS ema FROM w")
def ema(spark, d):
    return rounded(runs.ema(read(spark, d, "events"), ["event_type"], ["event_id"]), "ema")


@query("progress_gates", "WITH ev AS (SELECT event_type, event_id, round_even(value * 100, 0) AS value FROM events), w AS (SELECT event_type, count(*) OVER g AS step, avg(value) OVER g AS mean, count(*) OVER p AS steps, avg(value) OVER p AS ended FROM ev WINDOW g AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY event_type)), e AS (SELECT event_type, any_value(steps) AS steps, any_value(ended) AS ended FROM w GROUP BY event_type), b AS (SELECT event_type, steps, max(ended) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM e), s AS (SELECT w.event_type, min(step) AS stopped_at FROM w JOIN b USING (event_type) WHERE prev_max > 0 AND ((step > b.steps * 0.25 AND mean < prev_max - 0.2) OR (step > b.steps * 0.1 AND mean < prev_max - 0.8)) GROUP BY w.event_type) SELECT event_type, steps, round(prev_max, 4) AS prev_max, stopped_at FROM b LEFT JOIN s USING (event_type)")
def progress_gates(spark, d):
    """Event types as trials: where one falls behind those before it."""
    cents = read(spark, d, "events").withColumn("value", F.rint(F.col("value") * 100))
    return rounded(runs.progress_gates(cents, "event_type", "event_id", "value"), "prev_max")


@query("best_so_far", "WITH w AS (SELECT o_orderpriority, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM orders) SELECT o_orderpriority, o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(best_before, 4) AS best_before FROM w WHERE best_before IS NULL OR o_totalprice >= best_before - 50000")
def best_so_far(spark, d):
    o = read(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rounded(runs.best_so_far(o, ["o_orderpriority"], ["o_orderkey"], "o_totalprice", 50000.0), "o_totalprice", "best_before")


@query("best_run_per_c", "WITH w AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_orderpriority, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM w WHERE r = 1")
def best_run_per_c(spark, d):
    o = read(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rounded(runs.best_run_per(o, "o_orderpriority", "o_totalprice", "o_orderkey"), "o_totalprice")


@query("best_trial", "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, round(max(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY o_orderpriority")
def best_trial(spark, d):
    return rounded(runs.best_trial(read(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey"), "o_totalprice")


@query("missing_models", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_models(spark, d):
    return runs.missing(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


@query("present_models", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def present_models(spark, d):
    return runs.present(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


@query("missing_captures", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def missing_captures(spark, d):
    return runs.missing(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("config_overlay", "SELECT coalesce(c.c_custkey, o.o_custkey) AS c_custkey, round(coalesce(o.v, c.c_acctbal), 4) AS v FROM customer c FULL JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def config_overlay(spark, d):
    base = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    new = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return rounded(runs.config_overlay(base, new, "c_custkey", "v"), "v")




@query("average_models", "WITH p AS (SELECT c_mktsegment AS model, c_nationkey AS idx, sum(c_acctbal) AS v FROM customer GROUP BY ALL), g AS (SELECT model, idx FROM (SELECT DISTINCT c_mktsegment AS model FROM customer), (SELECT DISTINCT c_nationkey AS idx FROM customer)) SELECT 'w' AS name, idx, round(avg(coalesce(v, 0)), 4) AS value FROM g LEFT JOIN p USING (model, idx) GROUP BY idx")
def average_models(spark, d):
    """One parameter set a market segment, with a value for every nation, 0 where it has none."""
    p = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("idx")).agg(F.sum("c_acctbal").alias("value"))
    every = p.groupBy("idx").pivot("model").agg(F.sum("value")).unpivot("idx", None, "model", "value")
    params = every.select("model", F.lit("w").alias("name"), "idx", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(False).alias("is_int"))
    return rounded(metrics.average_models(params), "value")


@query("union_results", "SELECT 'order' AS kind, o_orderkey AS id, o_orderpriority AS tag, NULL::INT AS size FROM orders UNION ALL SELECT 'part', p_partkey, NULL, p_size FROM part")
def union_results(spark, d):
    a = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"))
    b = read(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return runs.union_results(a, b)


@query("split_layers_old_new", "SELECT l_linenumber, l_linenumber = (SELECT max(l_linenumber) FROM lineitem) AS is_new, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def split_layers_old_new(spark, d):
    layers = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return runs.split_layers_old_new(layers, "l_linenumber")


_CAP = "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) AS r FROM embeddings) WHERE r <= 20"


@query("capture_sample", _CAP)
def capture_sample(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    return runs.capture_sample(e, "label", "vec_id", 20, (F.col("vec_id") * 7919) % 1009)


@query("merge_captures", "SELECT label % 3 AS worker, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS s FROM embeddings GROUP BY label % 3")
def merge_captures(spark, d):
    """Captures of three workers, each written by itself, one of them twice, and read back together."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.get(F.col("embedding").cast("array<double>"), F.lit(0)).alias("x"))
    folder = tables.shared_folder(spark, "captures")
    for worker in (0, 1, 2, 1):
        tables.write_capture(e.where(F.col("label") % 3 == worker), folder, worker)
    return tables.merge_captures(spark, folder).groupBy("worker").agg(F.count("*").alias("n"), r4(F.sum("x")).alias("s"))


@query("scan_labelled_images", "SELECT lang AS label, sum(strlen(text) + 1)::BIGINT AS length FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def scan_labelled_images(spark, d):
    """Bytes of the files in a folder a class; their content is not read, as nobody asks for it."""
    folder = tables.shared_folder(spark, "images")
    read(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").write.partitionBy("lang").text(folder)
    found = tables.scan_labelled_images(spark, folder).withColumn("label", F.regexp_replace("label", "^lang=", ""))
    return found.groupBy("label").agg(F.sum("length").alias("length"))


@query("strip_prefix", "SELECT o_orderstatus AS status, count(*) AS n, round(max(o_totalprice), 4) AS totalprice FROM orders GROUP BY o_orderstatus")
def strip_prefix(spark, d):
    plain = runs.strip_prefix(read(spark, d, "orders"), "o_order")
    plain = runs.strip_prefix(plain, "o_")
    return plain.groupBy("status").agg(F.count("*").alias("n"), r4(F.max("totalprice")).alias("totalprice"))


@query("parse_layer_name", "SELECT p_partkey, split_part(t, '.', 1) AS row_name, split_part(t, '.', 2) || CASE WHEN t LIKE '%conv%' THEN '(3x3)' WHEN t LIKE '%downsample%' THEN '(1x1)' ELSE '' END AS col_name FROM (SELECT p_partkey, 'layer' || p_size % 4 || '.' || CASE p_partkey % 3 WHEN 0 THEN 'conv' WHEN 1 THEN 'downsample' ELSE 'fc' END AS t FROM part)")
def parse_layer_name(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "conv").when(F.col("p_partkey") % 3 == 1, "downsample").otherwise("fc")
    names = read(spark, d, "part").select("p_partkey", F.concat(F.lit("layer"), (F.col("p_size") % 4).cast("string"), F.lit("."), kind).alias("layer"))
    return runs.parse_layer_name(names).drop("layer")


@query("derive_shape_columns", "SELECT p_partkey, p_size AS c, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 7 END, p_partkey * 640 // (4 * 16 * p_size)) AS m FROM part WHERE p_size <= 32")
def derive_shape_columns(spark, d):
    r = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("c"), F.lit(16).alias("k"), (F.col("p_partkey") * 640).alias("l_size"), F.when(F.col("p_partkey") % 2 == 0, F.lit(7).cast("bigint")).alias("m"))
    return runs.derive_shape_columns(r, 32).select("p_partkey", "c", "m")
