"""Queries on layout, products, encoding, tables and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, lut, runs
from ..plans import layout
from .base import C, CELLS, CODES, FEATURES, GOLD, K, LAYOUT, LEARNED, M, OUTPUTS, PROTO, RESID, TREE, WEIGHTS, cells, coded, codes, label_means, learned_lut, lut_table, matrix, query, r4, read, residuals, rounded


@query("scan_matrix", f"WITH {CELLS} SELECT row_id, dim, round(x, 4) AS x FROM cells")
def scan_matrix(spark, d):
    return rounded(cells(spark, d), "x")


@query("scan_weights", "SELECT label AS m, (i - 1)::INT AS dim, round(avg(embedding[i]::DOUBLE), 4) AS w FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")
def scan_weights(spark, d):
    """Class means as weights: what the embeddings of a label have in common."""
    e = read(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return e.groupBy(F.col("label").alias("m"), "dim").agg(r4(F.avg("x")).alias("w"))


def _layout_sql(n: int, rest: str) -> str:
    start, end = (f"least(c{x}, dims % {n})" if rest == "start" else f"greatest(c{x} - ({n} - dims % {n}), 0)" for x in ("", " + 1"))
    layout = f"lay AS (SELECT c::INT AS c, (c * (dims // {n}) + {start})::INT AS start_idx, ((c + 1) * (dims // {n}) + {end})::INT AS end_idx FROM (SELECT unnest(range({n})) AS c), (SELECT max(len(embedding)) AS dims FROM embeddings))"
    return f"WITH {CELLS}, {layout} SELECT c, start_idx, end_idx, count(*) AS n_values, round(avg(x * x), 4) AS msv FROM lay JOIN cells ON dim >= start_idx AND dim < end_idx GROUP BY c, start_idx, end_idx"


def _layout(spark, d, remainder):
    """The layout of as many dims as the embeddings have, with each block's values and their mean square."""
    m = matrix(spark, d)
    dims = m.agg(F.max(F.size("features")).alias("n")).first()["n"] or 1
    per = layout.to_cells(m).groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    blocks = layout.codebook_layout(spark, dims, 12, remainder).withColumn("dim", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)))
    return blocks.join(per, "dim").groupBy("c", "start_idx", "end_idx").agg(F.sum("n").alias("n_values"), r4(F.sum("q") / F.sum("n")).alias("msv"))


@query("codebook_layout", _layout_sql(12, "start"))
def codebook_layout(spark, d):
    return _layout(spark, d, "start")


@query("codebook_layout_end", _layout_sql(12, "end"))
def codebook_layout_end(spark, d):
    return _layout(spark, d, "end")


@query("subvectors", f"WITH {FEATURES} SELECT row_id, c::INT AS c, round(list_sum(f[c * 8 + 1 : c * 8 + 8]), 4) AS total, len(f[c * 8 + 1 : c * 8 + 8])::INT AS width FROM mat, (SELECT unnest(range(8)) AS c)")
def subvectors(spark, d):
    s = layout.subvectors(matrix(spark, d), LAYOUT)
    return s.select("row_id", "c", r4(F.aggregate("sub", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("sub").alias("width"))


@query("to_cells", f"WITH {CELLS} SELECT dim, count(*) AS n, round(sum(x), 4) AS s FROM cells GROUP BY dim")
def to_cells(spark, d):
    return cells(spark, d).groupBy("dim").agg(F.count("*").alias("n"), r4(F.sum("x")).alias("s"))


@query("gather_dims", f"WITH {FEATURES} SELECT row_id, round({' + '.join(f'{i + 1} * f[{x + 1}]' for i, x in enumerate(GOLD.dims[0] + GOLD.dims[3]))}, 4) AS mixed FROM mat")
def gather_dims(spark, d):
    g = layout.gather_dims(matrix(spark, d), list(GOLD.dims[0] + GOLD.dims[3]))
    return g.select("row_id", r4(F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)).alias("mixed"))


@query("train_test_split", "SELECT vec_id, (vec_id * 7919) % 100 < 80 AS is_train FROM embeddings")
def train_test_split(spark, d):
    return runs.hash_split(read(spark, d, "embeddings").select("vec_id"), "vec_id", 80)


@query("row_cap", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def row_cap(spark, d):
    return runs.row_cap(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 100)


@query("sufficiency_report", "SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_dims, round(count(*) / 128.0, 4)::DOUBLE AS rows_per_prototype, round(count(*) / max(len(embedding)), 4)::DOUBLE AS rows_per_dim, count(*) * max(len(embedding)) * 4 AS bytes_float32, count(*) > 10000000 AS too_large FROM embeddings")
def sufficiency_report(spark, d):
    return layout.sufficiency(matrix(spark, d), C, K)


@query("output_group_slice", f"WITH {LEARNED} SELECT m, c, k, round(value, 4) AS value FROM lut WHERE m BETWEEN 4 AND 7")
def output_group_slice(spark, d):
    return rounded(lut.output_group(learned_lut(spark, d), 1, 3, M), "value")


@query("flat_codes", f"WITH {CODES} SELECT row_id, c, k + c * 16 AS flat FROM codes")
def flat_codes(spark, d):
    return coded(spark, d).select("row_id", F.posexplode(encode.flat_codes(F.col("codes"), K)).alias("c", "flat"))


@query("rows_in_classes", f"WITH {CODES} SELECT row_id, k, round(f[1], 4) AS x0 FROM codes JOIN mat USING (row_id) WHERE c = 2 AND k IN (0, 3, 5, 9)")
def rows_in_classes(spark, d):
    kept = runs.rows_in_classes(matrix(spark, d), codes(spark, d), 2, [0, 3, 5, 9])
    return kept.select("row_id", "k", r4(F.get("features", F.lit(0))).alias("x0"))


@query("mask_not_in_classes", f"WITH {CODES} SELECT row_id, c, CASE WHEN k IN (0, 3, 5, 9) THEN k ELSE -1 END AS k FROM codes")
def mask_not_in_classes(spark, d):
    return runs.mask_not_in_classes(codes(spark, d), "k", [0, 3, 5, 9])


_EXACT = f"WITH {CELLS}, {WEIGHTS} SELECT row_id, m, round(sum(x * w), 4) AS y FROM cells JOIN weights USING (dim) GROUP BY row_id, m"


@query("matmul_exact", _EXACT)
def matmul_exact(spark, d):
    return rounded(lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark)), "y")


@query("matmul_exact_arrays", _EXACT)
def matmul_exact_arrays(spark, d):
    y = lut.matmul_arrays(matrix(spark, d), [list(r) for r in GOLD.weights])
    return rounded(y.select("row_id", F.posexplode("y").alias("m", "y")), "y")


_CODES = f"WITH {CODES} SELECT row_id, c, k FROM codes"


@query("encode_tree", _CODES)
def encode_tree(spark, d):
    return codes(spark, d)


@query("encode_tree_join", _CODES)
def encode_tree_join(spark, d):
    return encode.encode_tree_join(cells(spark, d), GOLD.tree(spark))


_NEAR = f"{CELLS}, {PROTO}, dist AS (SELECT row_id, c, k, sum((x - value) * (x - value)) AS dist FROM cells JOIN proto USING (dim) GROUP BY row_id, c, k)"


@query("assign_nearest", f"WITH {_NEAR} SELECT row_id, c, arg_min(k, (dist, k)) AS k FROM dist GROUP BY row_id, c")
def assign_nearest(spark, d):
    return encode.assign_nearest(cells(spark, d), GOLD.prototype_table(spark))


@query("assign_nearest_arrays", f"WITH {_NEAR} SELECT row_id, c, arg_min(k, (dist, k)) AS k FROM dist GROUP BY row_id, c")
def assign_nearest_arrays(spark, d):
    near = [encode.nearest_code(F.col("features"), [[GOLD.prototypes[c, k, x] for x in range(a, b)] for k in range(K)], list(range(a, b))) for c, (a, b) in enumerate(LAYOUT)]
    return matrix(spark, d).select("row_id", F.posexplode(F.array(*near)).alias("c", "k"))


_I8 = lambda v: f"greatest(-128, least(127, round_even({v} * 127.0, 0)::INT))"


@query("assign_l1_int8", f"WITH {CELLS}, {PROTO}, dist AS (SELECT row_id, c, k, sum(abs({_I8('x')} - {_I8('value')})) AS dist FROM cells JOIN proto USING (dim) GROUP BY row_id, c, k) SELECT row_id, c, arg_min(k, (dist, k)) AS k FROM dist GROUP BY row_id, c")
def assign_l1_int8(spark, d):
    return encode.assign_l1_int8(cells(spark, d), GOLD.prototype_table(spark))


@query("assign_hamming", f"WITH {CELLS}, {PROTO}, dist AS (SELECT row_id, c, k, sum(bit_count(xor({_I8('x')}, {_I8('value')}) & 240)) AS dist FROM cells JOIN proto USING (dim) GROUP BY row_id, c, k) SELECT row_id, c, arg_min(k, (dist, k)) AS k FROM dist GROUP BY row_id, c")
def assign_hamming(spark, d):
    return encode.assign_hamming(cells(spark, d), GOLD.prototype_table(spark))


@query("soft_assign", f"WITH {_NEAR}, e AS (SELECT row_id, c, k, exp(-dist - max(-dist) OVER (PARTITION BY row_id, c)) AS e FROM dist) SELECT row_id, c, k, round(e / sum(e) OVER (PARTITION BY row_id, c), 4) AS p FROM e")
def soft_assign(spark, d):
    return rounded(encode.soft_assign(encode.distances(cells(spark, d), GOLD.prototype_table(spark))), "p")


_PATHS = ", ".join(map(str, encode.leaf_paths(4)))
_SOFT = f"{CELLS}, {TREE}, paths(k, level, node, sign) AS (SELECT * FROM (VALUES {_PATHS}) t), score AS (SELECT row_id, c, p.k, sum(tanh(x - threshold) * sign) AS score FROM cells JOIN tree USING (dim) JOIN paths p USING (level, node) GROUP BY row_id, c, p.k)"


@query("tree_soft_score", f"WITH {_SOFT} SELECT row_id, c, k, round(score, 4) AS score FROM score")
def tree_soft_score(spark, d):
    return rounded(encode.tree_soft_score(cells(spark, d), GOLD.tree(spark)), "score")


_HEAP = (list(range(3, 18)), [round(0.05 * ((i * 7) % 5 - 2), 3) for i in range(15)], [(i * 5) % 16 for i in range(16)])


def _levels(f: str) -> str:
    return f"WITH {FEATURES}, n0 AS (SELECT row_id, f, 0 AS g FROM mat), n1 AS (SELECT row_id, f, {f} AS g FROM n0), n2 AS (SELECT row_id, f, {f} AS g FROM n1), n3 AS (SELECT row_id, f, {f} AS g FROM n2), n4 AS (SELECT row_id, {f} AS g FROM n3)"


_STEP = f"2 * g + 1 + (f[({_HEAP[0]})[g + 1] + 1] > ({_HEAP[1]})[g + 1])::INT"


@query("tree_apply", f"{_levels(_STEP)} SELECT row_id, ({_HEAP[2]})[g - 14] AS class FROM n4")
def tree_apply(spark, d):
    return encode.tree_apply(matrix(spark, d), *_HEAP)


@query("cascade_predict", f"WITH {CODES}, w AS (SELECT row_id, max(k) FILTER (c = 0) AS a, max(k) FILTER (c = 1) AS b, max(k) FILTER (c = 2) AS e FROM codes GROUP BY row_id) SELECT row_id, coalesce(CASE WHEN a < 3 THEN a END, CASE WHEN b < 9 THEN b END, e) AS class FROM w")
def cascade_predict(spark, d):
    k = coded(spark, d).select("row_id", *(F.get("codes", F.lit(c)).alias(f"t{c}") for c in range(3)))
    k = k.withColumns({"t0": F.when(F.col("t0") < 3, F.col("t0")).otherwise(-1), "t1": F.when(F.col("t1") < 9, F.col("t1")).otherwise(-1)})
    return encode.cascade_predict(k, ["t0", "t1", "t2"]).select("row_id", "class")


@query("lut_build", f"WITH {LEARNED} SELECT m, c, k, round(value, 4) AS value FROM lut")
def lut_build(spark, d):
    """Tables of the embeddings' bucket means for their labels' means."""
    return rounded(learned_lut(spark, d), "value")


_MEANS = "means AS (SELECT label AS m, (i - 1)::INT AS dim, avg(embedding[i]::DOUBLE) AS w FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i)"


@query("lut_build_block", f"WITH {PROTO}, {_MEANS} SELECT m, c, k, round(sum(w * value), 4) AS value FROM proto JOIN means USING (dim) GROUP BY m, c, k")
def lut_build_block(spark, d):
    """Tables for the class means, from block-local centroids."""
    local = GOLD.prototype_table(spark).withColumn("d", F.col("dim") % 8).drop("dim")
    return rounded(lut.lut_build_block(local, label_means(spark, d), 8), "value")


_APPROX = f"WITH {OUTPUTS} SELECT row_id, m, round(y, 4) AS y FROM approx"


@query("decode_join", _APPROX)
def decode_join(spark, d):
    return rounded(lut.decode_join(codes(spark, d), lut_table(spark)), "y")


@query("decode_lut", _APPROX)
def decode_lut(spark, d):
    return rounded(lut.decode_lut(coded(spark, d), GOLD.lut()).select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("decode_arrow", _APPROX)
def decode_arrow(spark, d):
    return rounded(lut.decode_arrow(coded(spark, d), GOLD.lut()).select("row_id", F.posexplode("y").alias("m", "y")), "y")


@query("reconstruct", f"WITH {CODES}, {PROTO} SELECT row_id, dim, round(value, 4) AS xhat FROM codes JOIN proto USING (c, k)")
def reconstruct(spark, d):
    return rounded(lut.reconstruct(codes(spark, d), GOLD.prototype_table(spark)), "xhat")


@query("residual", f"WITH {RESID} SELECT row_id, dim, round(x, 4) AS x, round(r, 4) AS r FROM resid")
def residual(spark, d):
    return rounded(residuals(spark, d), "x", "r")


@query("pair_outputs", f"WITH {OUTPUTS} SELECT row_id, m, round(a, 4) AS a, round(d, 4) AS d FROM pairs")
def pair_outputs(spark, d):
    """Looked-up and exact products, each made inside its row, paired on (row, output)."""
    m = matrix(spark, d)
    approx = lut.decode_lut(m.select("row_id", "features", F.array(*(encode.tree_code(F.col("features"), x, t) for x, t in zip(GOLD.dims, GOLD.thresholds))).alias("codes")), GOLD.lut())
    exact = lut.matmul_arrays(m, [list(r) for r in GOLD.weights])
    long = lambda df, name: df.select("row_id", F.posexplode("y").alias("m", name))
    return rounded(long(approx, "a").join(long(exact, "d"), ["row_id", "m"]), "a", "d")


_RANGE = "ranges AS (SELECT c, min(value) AS low, max(value) AS high, max(value) - min(value) AS gap FROM lut GROUP BY c), params AS (SELECT sum(low) AS shift, power(2.0, -ceil(log2(max(gap)))) * (255.5 - 1e-10) AS scale FROM ranges), lq AS (SELECT m, c, k, floor((value - low) * scale + 0.5)::INT AS q FROM lut JOIN ranges USING (c), params)"


@query("lut_ranges", f"WITH {LEARNED}, {_RANGE} SELECT c, round(low, 4) AS low, round(high, 4) AS high, round(gap, 4) AS gap FROM ranges")
def lut_ranges(spark, d):
    return rounded(lut.lut_ranges(learned_lut(spark, d)), "low", "high", "gap")


@query("lut_quantize_u8", f"WITH {LEARNED}, {_RANGE} SELECT m, c, k, q FROM lq")
def lut_quantize_u8(spark, d):
    return lut.quantize_u8(learned_lut(spark, d))


@query("decode_quantized", f"WITH {LEARNED}, {_RANGE} SELECT row_id, m, round(sum(q) / any_value(scale) + any_value(shift), 4) AS y FROM codes JOIN lq USING (c, k), params GROUP BY row_id, m")
def decode_quantized(spark, d):
    t = learned_lut(spark, d)
    return rounded(lut.decode_quantized(codes(spark, d), lut.quantize_u8(t), lut.lut_params(t)), "y")


_I8Q = "sc AS (SELECT (max(value) - min(value)) / 255.0 AS scale FROM lut), lq AS (SELECT m, c, k, greatest(-128.0, least(127.0, round_even(value / scale, 0)))::INT AS q FROM lut, sc)"


@query("lut_quantize_i8", f"WITH {LEARNED}, {_I8Q} SELECT m, c, k, q FROM lq")
def lut_quantize_i8(spark, d):
    return lut.quantize_i8(learned_lut(spark, d))


@query("decode_i8", f"WITH {LEARNED}, {_I8Q} SELECT row_id, m, round(sum(q) * any_value(scale), 4) AS y FROM codes JOIN lq USING (c, k), sc GROUP BY row_id, m")
def decode_i8(spark, d):
    t = learned_lut(spark, d)
    return rounded(lut.decode_i8(codes(spark, d), lut.quantize_i8(t), lut.i8_scale(t)), "y")


@query("lut_saturation", f"WITH {LEARNED}, {_I8Q} SELECT count(*) FILTER (round_even(value / scale, 0) NOT BETWEEN -128 AND 127) AS saturated, count(*) AS entries, round(max(scale), 6) AS scale FROM lut, sc")
def lut_saturation(spark, d):
    t = learned_lut(spark, d)
    return lut.saturation(t).crossJoin(lut.i8_scale(t)).withColumn("scale", F.round("scale", 6))


@query("split_quant_params", f"WITH {CELLS}, {TREE}, s AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM cells GROUP BY dim), t AS (SELECT c, dim, min(threshold)::DOUBLE AS least, max(threshold)::DOUBLE AS most FROM tree GROUP BY c, dim) SELECT c, dim, round((lo + least) / 2, 4) AS \"offset\", power(2.0, trunc(log2(254.0 / ((hi + most) / 2 - (lo + least) / 2)))) AS scale FROM t JOIN s USING (dim)")
def split_quant_params(spark, d):
    return rounded(lut.split_quant_params(cells(spark, d), GOLD.tree(spark)), "offset")


_PARAMS = "seen AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM cells GROUP BY dim), cuts AS (SELECT c, dim, min(threshold)::DOUBLE AS least, max(threshold)::DOUBLE AS most FROM tree GROUP BY c, dim), params AS (SELECT c, dim, (lo + least) / 2 AS off, power(2.0, trunc(log2(254.0 / ((hi + most) / 2 - (lo + least) / 2)))) AS scale FROM cuts JOIN seen USING (dim)), qtree AS (SELECT t.c, t.level, t.node, t.dim, trunc(greatest(0.0, least(255.0, (t.threshold::DOUBLE - off) * scale)))::INT AS threshold FROM tree t JOIN params p ON p.c = t.c AND p.dim = t.dim)"


@query("quantize_tree", f"WITH {CELLS}, {TREE}, {_PARAMS} SELECT * FROM qtree")
def quantize_tree(spark, d):
    tree = GOLD.tree(spark)
    return lut.quantize_tree(tree, lut.split_quant_params(cells(spark, d), tree))


_QSTEPS = ", ".join(["n0 AS (SELECT row_id, c, 0 AS g FROM (SELECT DISTINCT row_id, c FROM qx))"] + [f"n{l + 1} AS (SELECT n.row_id, n.c, 2 * n.g + (x.x > t.threshold)::INT AS g FROM n{l} n JOIN qtree t ON t.c = n.c AND t.level = {l} AND t.node = n.g JOIN qx x ON x.row_id = n.row_id AND x.c = n.c AND x.dim = t.dim)" for l in range(4)])


@query("encode_tree_u8", f"WITH {CELLS}, {TREE}, {_PARAMS}, qx AS (SELECT row_id, c, dim, greatest(0, least(255, floor((x - off) * scale + 0.5)))::INT AS x FROM cells JOIN params USING (dim)), {_QSTEPS} SELECT row_id, c, g AS k FROM n4")
def encode_tree_u8(spark, d):
    """Codes by whole numbers from 0 to 255 on both sides of every comparison."""
    x, tree = cells(spark, d), GOLD.tree(spark)
    params = lut.split_quant_params(x, tree)
    return encode.encode_tree_join(lut.quantize_cells(x, params), lut.quantize_tree(tree, params))


def _fake(bits: int, x: str) -> str:
    top = float(2 ** (bits - 1) - 1)
    return f"greatest({-top - 1}, least({top}, round_even({x} / s, 0))) * s"


_WIDTHS = (4, 6, 7, 8, 10, 16, 32)


@query("fake_quantize", " UNION ALL ".join(f"SELECT {b} AS bits, round(avg(abs({_fake(b, 'l_extendedprice')} - l_extendedprice)), 4) AS mae FROM lineitem, (SELECT max(abs(l_extendedprice)) / {float(2 ** (b - 1) - 1)} AS s FROM lineitem)" for b in _WIDTHS))
def fake_quantize(spark, d):
    """Error of quantizing prices to several widths, all in one scan after the range."""
    rows = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"))
    top = rows.agg(F.max(F.abs("x")).alias("top"))
    widths = F.array(*map(F.lit, _WIDTHS))
    each = rows.crossJoin(F.broadcast(top)).select("x", "top", F.explode(widths).alias("bits"))
    err = lambda b: F.abs(lut.fake_quantize(F.col("x"), F.col("top") / float(2 ** (b - 1) - 1), b) - F.col("x"))
    e = F.coalesce(*(F.when(F.col("bits") == b, err(b)) for b in _WIDTHS))
    return each.groupBy("bits").agg(r4(F.avg(e)).alias("mae"))


@query("fake_quantized_product", f"WITH {CELLS}, {WEIGHTS}, top AS (SELECT max(abs(x)) AS xt FROM cells), wt AS (SELECT max(abs(w)) AS wt FROM weights) " + " UNION ALL ".join(f"SELECT {b} AS bits, round(avg(abs(q - y)), 4) AS mae FROM (SELECT row_id, m, sum(x * w) AS y, sum((greatest({-2.0 ** (b - 1)}, least({2.0 ** (b - 1) - 1}, round_even(x / (xt / {2.0 ** (b - 1) - 1}), 0))) * (xt / {2.0 ** (b - 1) - 1})) * (greatest({-2.0 ** (b - 1)}, least({2.0 ** (b - 1) - 1}, round_even(w / (wt / {2.0 ** (b - 1) - 1}), 0))) * (wt / {2.0 ** (b - 1) - 1}))) AS q FROM cells JOIN weights USING (dim), top, wt GROUP BY row_id, m)" for b in (4, 7, 8, 32)))
def fake_quantized_product(spark, d):
    """Error of the product whose two sides are quantized, by width."""
    m = matrix(spark, d)
    top = m.agg(F.max(F.array_max(F.transform("features", F.abs))).alias("t")).first()["t"]
    weights = [list(r) for r in GOLD.weights]
    # both products are arrays of one row: each width's error is taken there
    y = lut.products(F.col("features"), weights)
    q = {bits: lut.fake_quantized(F.col("features"), weights, bits, top) for bits in (4, 7, 8, 32)}
    off = F.array(*(F.struct(F.lit(bits).alias("bits"), F.zip_with(v, "y", lambda a, b: F.abs(a - b)).alias("e")) for bits, v in q.items()))
    each = m.withColumn("y", y).select(F.explode(off).alias("o")).select("o.bits", F.explode("o.e").alias("e"))
    return each.groupBy("bits").agg(r4(F.avg("e")).alias("mae"))


@query("dequantize", "SELECT l_linenumber, round(avg((l_quantity - 25.0) / 0.5), 4) AS v FROM lineitem GROUP BY l_linenumber")
def dequantize(spark, d):
    v = lut.dequantize(F.col("l_quantity"), F.lit(25.0), F.lit(0.5))
    return read(spark, d, "lineitem").groupBy("l_linenumber").agg(r4(F.avg(v)).alias("v"))


@query("bias_relu_residual", f"WITH {OUTPUTS} SELECT a.row_id, a.m, round(greatest(0.0, a.y + 0.1 * a.m + e.y), 4) AS y FROM approx a JOIN exact e USING (row_id, m)")
def bias_relu_residual(spark, d):
    from ..operators.images import bias_relu_residual as apply

    y = lut.decode_join(codes(spark, d), lut_table(spark))
    return rounded(apply(y, F.col("m") * 0.1, lut.matmul_exact(cells(spark, d), GOLD.weight_table(spark))), "y")


@query("encode_histogram_check", f"WITH {CODES} SELECT c, count(DISTINCT k) AS used FROM codes GROUP BY c")
def encode_histogram_check(spark, d):
    return codes(spark, d).groupBy("c").agg(F.count_distinct("k").alias("used"))
