"""Queries on errors, code usage, split statistics, ranks and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, fit, lut, metrics, scan
from ..operators.running import running_sse
from ..operators.splits import best_splits
from ..plans import layout
from .base import C, CODES, GOLD, K, OUTPUTS, PROTO, RESID, cells, coded, codes, lut_table, query, r4, read, residuals, rounded


def pairs(spark, d):
    approx = lut.decode_join(codes(spark, d), lut_table(spark))
    return metrics.error_pairs(approx, lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark)))


def labels(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label")


@query("code_gram", f"WITH {CODES} SELECT a.c AS c1, a.k AS k1, b.c AS c2, b.k AS k2, count(*) AS n FROM codes a JOIN codes b USING (row_id) GROUP BY ALL")
def code_gram(spark, d):
    return metrics.code_gram(coded(spark, d))


@query("code_xty", f"WITH {CODES}, {PROTO}, resid AS (SELECT x.row_id, x.dim, x.x - p.value AS r FROM cells x JOIN codes c USING (row_id) JOIN proto p ON p.c = c.c AND p.k = c.k AND p.dim = x.dim) SELECT c, k, dim, round(sum(r), 4) AS s FROM codes JOIN resid USING (row_id) GROUP BY c, k, dim")
def code_xty(spark, d):
    return rounded(metrics.code_xty(codes(spark, d), residuals(spark, d)), "s")


@query("fit_report", f"WITH {RESID} SELECT round(avg(x * x), 4) AS msv_orig, round(avg(r * r), 4) AS mse_error, round(avg(r * r) / avg(x * x), 4) AS mse_ratio, round(avg(x), 4) AS mean_x, round(avg((x - r) * (x - r)), 4) AS msv_reconstructed FROM resid")
def fit_report(spark, d):
    return rounded(metrics.fit_report(residuals(spark, d)), "msv_orig", "mse_error", "mse_ratio", "mean_x", "msv_reconstructed")


_GRID = "grid AS (SELECT c::INT AS c, k::INT AS k FROM (SELECT unnest(range(8)) AS c), (SELECT unnest(range(16)) AS k))"


@query("code_histogram", f"WITH {CODES}, {_GRID} SELECT g.c, g.k, count(x.row_id) AS n FROM grid g LEFT JOIN codes x ON x.c = g.c AND x.k = g.k GROUP BY g.c, g.k")
def code_histogram(spark, d):
    return metrics.code_histogram(codes(spark, d), C, K)


@query("code_histogram_all", f"WITH {CODES} SELECT k, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM codes GROUP BY k")
def code_histogram_all(spark, d):
    return rounded(metrics.code_histogram_all(codes(spark, d)), "share")


@query("error_per_code", f"WITH {RESID}, {_GRID}, sub AS (SELECT row_id, c, k, avg(r * r) AS e FROM resid GROUP BY row_id, c, k), s AS (SELECT c, k, sum(e) AS err, count(*) AS n FROM sub GROUP BY c, k) SELECT g.c, g.k, round(coalesce(err, 0), 4) AS err, round(coalesce(err, 0) / (coalesce(n, 0) + 1), 4) AS err_scaled, round(100 * coalesce(err, 0) / sum(coalesce(err, 0)) OVER (), 4) AS err_share FROM grid g LEFT JOIN s ON s.c = g.c AND s.k = g.k")
def error_per_code(spark, d):
    r = residuals(spark, d).withColumn("c", F.floor(F.col("dim") / 8).cast("int"))
    return rounded(metrics.error_per_code(codes(spark, d), r, C, K), "err", "err_scaled", "err_share")


@query("error_per_dim", f"WITH {RESID} SELECT dim, round(avg(r * r), 4) AS mse FROM resid GROUP BY GROUPING SETS ((dim), ())")
def error_per_dim(spark, d):
    return rounded(metrics.error_per_dim(residuals(spark, d)), "mse")


@query("zero_fraction", "SELECT round(avg(CASE WHEN l_discount = 0 THEN 100.0 ELSE 0.0 END), 4) AS l_discount, round(avg(CASE WHEN l_tax = 0 THEN 100.0 ELSE 0.0 END), 4) AS l_tax FROM lineitem")
def zero_fraction(spark, d):
    return rounded(metrics.zero_fraction(read(spark, d, "lineitem"), ["l_discount", "l_tax"]), "l_discount", "l_tax")


@query("zero_scaled_error", "SELECT l_linenumber, round(avg((l_tax - 0.04) * (l_tax - 0.04)) / avg(CASE WHEN l_tax = 0 THEN 0.0 ELSE 1.0 END), 4) AS err FROM lineitem GROUP BY l_linenumber")
def zero_scaled_error(spark, d):
    """Error over the share of values that are not zero."""
    e = F.col("l_tax") - 0.04
    share = F.avg(F.when(F.col("l_tax") == 0, 0.0).otherwise(1.0))
    return read(spark, d, "lineitem").groupBy("l_linenumber").agg(r4(F.avg(e * e) / share).alias("err"))


_METRICS = "round(avg(abs(a - d)), 4) AS mae, round(avg((a - d) * (a - d)), 4) AS mse, round(avg(abs(a - d) / (1 + abs(d))), 4) AS mape, round(2 * avg(abs(a - d)) / (max(d) - min(d)), 4) AS scaled_error, round(2 * avg(a - d) / (max(d) - min(d)), 4) AS scaled_shift"


@query("error_metrics", f"WITH {OUTPUTS} SELECT m, {_METRICS} FROM pairs GROUP BY m")
def error_metrics(spark, d):
    return rounded(metrics.error_metrics(pairs(spark, d), "m"), *metrics.METRICS)


@query("approx_vs_exact_by_label", f"WITH {OUTPUTS}, ra AS (SELECT row_id, arg_max(m, (y, -m)) AS ma FROM approx GROUP BY row_id), re AS (SELECT row_id, arg_max(m, (y, -m)) AS me FROM exact GROUP BY row_id) SELECT label, round(100.0 * avg((ma = me)::INT), 4) AS agree, {_METRICS} FROM pairs JOIN embeddings ON vec_id = row_id JOIN ra USING (row_id) JOIN re USING (row_id) GROUP BY label")
def approx_vs_exact_by_label(spark, d):
    """Flagship: table look-ups against exact products, by label; the scores of a row never leave it."""
    from ..plans.api import both_products

    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    both = both_products(rows, GOLD)
    best = lambda c: F.array_position(F.col(c), F.array_max(c))
    long = both.select("label", (best("a") == best("d")).cast("int").alias("same"), F.explode(F.arrays_zip("a", "d")).alias("p")).select("label", "same", "p.a", "p.d")
    return rounded(metrics.error_metrics(long, "label", (100.0 * F.avg("same")).alias("agree")), "agree", *metrics.METRICS)


@query("merge_error_reports", f"WITH {OUTPUTS}, rep AS (SELECT row_id % 7 AS batch, m, avg(abs(a - d)) AS mae, count(*) AS n FROM pairs GROUP BY ALL) SELECT m, round(sum(mae * n) / sum(n), 4) AS mae, sum(n)::BIGINT AS n FROM rep GROUP BY m")
def merge_error_reports(spark, d):
    reports = pairs(spark, d).groupBy((F.col("row_id") % 7).alias("batch"), "m").agg(F.avg(F.abs(F.col("a") - F.col("d"))).alias("mae"), F.count("*").alias("n"))
    return rounded(metrics.merge_error_reports(reports, "m", metrics=("mae",)), "mae")


@query("loss_metrics", f"WITH {OUTPUTS}, e AS (SELECT abs(a - d) AS e FROM pairs) SELECT round(avg(e * e), 4) AS mse, round(avg(e), 4) AS l1, round(avg(CASE WHEN e <= 1 THEN e * e / 2 ELSE e - 0.5 END), 4) AS huber FROM e")
def loss_metrics(spark, d):
    return rounded(metrics.loss_metrics(pairs(spark, d)), "mse", "l1", "huber")


@query("relative_sq_error", f"WITH {OUTPUTS} SELECT round(sum((a - d) * (a - d)) / sum(d * d), 4) AS relative_sq_error FROM pairs")
def relative_sq_error(spark, d):
    return rounded(metrics.relative_sq_error(pairs(spark, d)), "relative_sq_error")


@query("rel_error_histogram", "WITH e AS (SELECT 100 * abs(o_totalprice - 150000.0) / o_totalprice AS e FROM orders WHERE o_totalprice <> 0), s AS (SELECT min(e) AS lo, max(e) AS hi FROM e), b AS (SELECT least(9, floor((e - lo) * 10 / (hi - lo)))::INT AS bin, lo, hi FROM e, s), h AS (SELECT bin, count(*) AS n, any_value(lo + (bin + 1) * (hi - lo) / 10) AS upper_edge FROM b GROUP BY bin) SELECT bin, n, round(upper_edge, 4) AS upper_edge, n = max(n) OVER () AS is_peak FROM h")
def rel_error_histogram(spark, d):
    o = read(spark, d, "orders").select(F.lit(150000.0).alias("a"), F.col("o_totalprice").alias("d"))
    return rounded(metrics.rel_error_histogram(o), "upper_edge")


_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("quantiles_by_key", f"WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, {_SHARES}) AS q FROM orders GROUP BY 1), v AS (SELECT o_orderpriority, unnest({_SHARES}::DOUBLE[]) AS share, unnest(q) AS value FROM q) SELECT o_orderpriority, share, round(value, 4) AS value FROM v")
def quantiles_by_key(spark, d):
    """Five exact quantiles of every order priority, narrowed down together."""
    return rounded(scan.quantiles_by(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", _SHARES, bins=64, most=500), "value")


@query("quantiles_of_lengths", f"WITH q AS (SELECT lang, quantile_cont(n_chars::DOUBLE, {_SHARES}) AS q FROM documents GROUP BY 1), v AS (SELECT lang, unnest({_SHARES}::DOUBLE[]) AS share, unnest(q) AS value FROM q) SELECT lang, share, round(value, 4) AS value FROM v")
def quantiles_of_lengths(spark, d):
    """The same of the documents' lengths by language, which hold many ties."""
    return rounded(scan.quantiles_by(read(spark, d, "documents"), ["lang"], "n_chars", _SHARES), "value")


@query("trimmed_range", "WITH p AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders) SELECT o_orderpriority, count(*) AS n, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high FROM orders, p WHERE o_totalprice BETWEEN lo AND hi GROUP BY o_orderpriority")
def trimmed_range(spark, d):
    kept = metrics.trimmed_range(read(spark, d, "orders"), "o_totalprice")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r4(F.min("o_totalprice")).alias("low"), r4(F.max("o_totalprice")).alias("high"))


_RANKED = "ranked AS (SELECT row_id, m, y, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, m) AS rank FROM exact)"


@query("topk_accuracy", f"WITH {OUTPUTS}, {_RANKED}, n AS (SELECT count(*) AS n FROM embeddings) SELECT round(100.0 * count(*) FILTER (rank <= 1) / any_value(n), 4) AS top1, round(100.0 * count(*) FILTER (rank <= 5) / any_value(n), 4) AS top5, any_value(n) AS n FROM ranked JOIN embeddings ON vec_id = row_id AND label = m, n")
def topk_accuracy(spark, d):
    exact = lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark))
    return rounded(metrics.topk_accuracy(exact, labels(spark, d)), "top1", "top5")


@query("topk_scores", f"WITH {OUTPUTS}, {_RANKED} SELECT row_id, m, rank, round(y, 4) AS y FROM ranked WHERE rank <= 3")
def topk_scores(spark, d):
    return rounded(metrics.topk_scores(lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark)), 3), "y")


@query("argmax_class", f"WITH {OUTPUTS} SELECT row_id, arg_max(m, (y, -m)) AS m FROM exact GROUP BY row_id")
def argmax_class(spark, d):
    return metrics.argmax_class(lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark)))


_NEAR = f"{CODES}, {PROTO}, dist AS (SELECT row_id, c, k, sum((x - value) * (x - value)) AS dist FROM cells JOIN proto USING (dim) GROUP BY row_id, c, k), near AS (SELECT row_id, c, arg_min(k, (dist, k)) AS k FROM dist GROUP BY row_id, c)"


@query("assignment_agreement", f"WITH {_NEAR} SELECT round(avg((a.k = b.k)::INT), 4) AS share, count(*) FILTER (a.k <> b.k) AS different FROM codes a JOIN near b USING (row_id, c)")
def assignment_agreement(spark, d):
    near = encode.assign_nearest(cells(spark, d), GOLD.prototype_table(spark))
    return rounded(metrics.assignment_agreement(codes(spark, d), near), "share")


@query("abs_error_ratio", f"WITH {_NEAR}, r1 AS (SELECT row_id, dim, x - value AS r FROM cells JOIN codes USING (row_id) JOIN proto USING (c, k, dim)), r2 AS (SELECT row_id, dim, x - value AS r FROM cells JOIN near USING (row_id) JOIN proto USING (c, k, dim)) SELECT round((SELECT sum(abs(r)) FROM r2) / (SELECT sum(abs(r)) FROM r1), 4) AS ratio")
def abs_error_ratio(spark, d):
    near = encode.assign_nearest(cells(spark, d), GOLD.prototype_table(spark))
    second = lut.residual(cells(spark, d), lut.reconstruct(near, GOLD.prototype_table(spark)))
    return rounded(metrics.abs_error_ratio(residuals(spark, d), second), "ratio")


@query("classes_by_level", f"WITH {CODES}, n AS (SELECT c, k, count(*) AS n FROM codes GROUP BY c, k), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, k) - 1 AS rank FROM n) SELECT c, k, n, rank, CASE WHEN rank < 3 THEN 0 WHEN rank < 9 THEN 1 ELSE 2 END AS level FROM r")
def classes_by_level(spark, d):
    return metrics.classes_by_level(codes(spark, d))


# split statistics on line items: four columns as fixed-point cells, one bucket per return flag
_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_FIXED = "li AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS node, " + ", ".join(f"round_even({c} * 100, 0)::BIGINT AS x{i}" for i, c in enumerate(_COLS)) + " FROM lineitem), fx AS (" + " UNION ALL ".join(f"SELECT row_id, 0 AS c, node, {i} AS dim, x{i} AS x FROM li" for i in range(4)) + ")"


def fixed(spark, d):
    li = read(spark, d, "lineitem")
    node = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    each = F.array(*(F.rint(F.col(c) * 100).cast("bigint") for c in _COLS))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.lit(0).alias("c"), node.alias("node"), F.posexplode(each).alias("dim", "x"))


_STATS = f"{_FIXED}, st AS (SELECT c, node, dim, count(*) AS n, sum(x)::BIGINT AS sum_x, sum(x * x)::BIGINT AS sum_x2 FROM fx GROUP BY c, node, dim)"


@query("bucket_stats", f"WITH {_STATS} SELECT * FROM st")
def bucket_stats(spark, d):
    """Sums are longs, as in SQL, as long as those of all buckets fit; beyond, where SQL's cast fails, decimals."""
    return metrics.as_longs(metrics.bucket_stats(fixed(spark, d)), "sum_x", "sum_x2")


@query("bucket_sse", f"WITH {_STATS} SELECT c, node, dim, n, round(greatest(0.0, sum_x2 - sum_x::DOUBLE * sum_x / n) / 1e6, 4) AS sse FROM st")
def bucket_sse(spark, d):
    sse = metrics.bucket_sse(metrics.bucket_stats(fixed(spark, d)))
    return sse.select("c", "node", "dim", "n", r4(F.col("sse") / 1e6).alias("sse"))


@query("bucket_means", f"WITH {_STATS}, g AS (SELECT 0 AS c, n::INT AS node, d::INT AS dim FROM (SELECT unnest(range(4)) AS n), (SELECT unnest(range(4)) AS d)) SELECT g.c, g.node, g.dim, round(coalesce(sum_x / n, 0), 4) AS mean FROM g LEFT JOIN st ON st.node = g.node AND st.dim = g.dim")
def bucket_means(spark, d):
    grid = spark.range(16).select(F.lit(0).alias("c"), F.floor(F.col("id") / 4).cast("int").alias("node"), (F.col("id") % 4).cast("int").alias("dim"))
    return rounded(metrics.bucket_means(metrics.bucket_stats(fixed(spark, d)), grid), "mean")


_KEYS, _ORDER = ["c", "node", "dim"], ["x", "row_id"]
# sums and squares are exact: wide integers there, wide decimals here
_OVER = "w AS (PARTITION BY c, node, dim ORDER BY x, row_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY c, node, dim)"
_FLOOR = lambda q, s, n: f"({q} - ({s} * {s} + {n} - 1) // {n})"
_HEAD = f"{_FIXED}, hd AS (SELECT *, (count(*) OVER w)::HUGEINT AS n_head, (sum(x::HUGEINT) OVER w) AS s_head, (sum(x::HUGEINT * x) OVER w) AS q_head, (count(*) OVER p)::HUGEINT AS n_all, (sum(x::HUGEINT) OVER p) AS s_all, (sum(x::HUGEINT * x) OVER p) AS q_all, lead(x) OVER (PARTITION BY c, node, dim ORDER BY x, row_id) AS next_x FROM fx WINDOW {_OVER}), lo AS (SELECT c, node, dim, row_id, x, n_head::BIGINT AS n_head, {_FLOOR('q_head', 's_head', 'n_head')} AS sse_head, CASE WHEN n_all > n_head THEN {_FLOOR('(q_all - q_head)', '(s_all - s_head)', '(n_all - n_head)')} ELSE 0 END AS sse_tail, coalesce((x + next_x) / 2.0, x::DOUBLE) AS threshold FROM hd)"


def errors(spark, d, tail):
    return running_sse(fixed(spark, d), _KEYS, _ORDER, tail=tail, decimals=False)


@query("cum_sse_head", f"WITH {_HEAD} SELECT row_id, node, dim, n_head, sse_head::DOUBLE AS sse_head FROM lo")
def cum_sse_head(spark, d):
    return errors(spark, d, False).select("row_id", "node", "dim", "n_head", "sse_head")


@query("cum_sse_tail", f"WITH {_HEAD} SELECT row_id, node, dim, sse_tail::DOUBLE AS sse_tail FROM lo")
def cum_sse_tail(spark, d):
    return errors(spark, d, True).select("row_id", "node", "dim", "sse_tail")


@query("split_candidates", f"WITH {_HEAD} SELECT row_id, node, dim, round(threshold, 4) AS threshold FROM lo")
def split_candidates(spark, d):
    return rounded(fit.split_candidates(fixed(spark, d), _KEYS, _ORDER).select("row_id", "node", "dim", "threshold"), "threshold")


@query("rank_split_dims", f"WITH {_STATS}, e AS (SELECT c, dim, sum(greatest(0.0, sum_x2 - sum_x::DOUBLE * sum_x / n)) AS sse FROM st GROUP BY c, dim), r AS (SELECT c, dim, row_number() OVER (PARTITION BY c ORDER BY sse DESC, dim)::INT AS rank FROM e) SELECT c, dim, rank FROM r WHERE rank <= 3")
def rank_split_dims(spark, d):
    stats = metrics.bucket_sse(metrics.bucket_stats(fixed(spark, d)))
    return fit.rank_split_dims(stats, 3).select("c", "dim", "rank")


def splits(spark, d):
    return best_splits(fixed(spark, d), _KEYS)


@query("best_split", f"WITH {_HEAD} SELECT c, node, dim, round(arg_min(threshold, (sse_head + sse_tail, x, row_id)), 4) AS threshold, min(sse_head + sse_tail)::DOUBLE AS loss FROM lo GROUP BY c, node, dim")
def best_split(spark, d):
    return rounded(splits(spark, d), "threshold").withColumn("loss", F.col("loss").cast("double"))


@query("best_split_dim", f"WITH {_HEAD}, b AS (SELECT c, node, dim, min(sse_head + sse_tail) AS loss FROM lo GROUP BY c, node, dim), t AS (SELECT c, dim, sum(loss) AS loss FROM b GROUP BY c, dim) SELECT c, arg_min(dim, (loss, dim)) AS dim, min(loss)::DOUBLE AS loss FROM t GROUP BY c")
def best_split_dim(spark, d):
    return fit.choose_dim(splits(spark, d)).withColumn("loss", F.col("loss").cast("double"))
