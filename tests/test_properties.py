"""Properties of the engine, and numpy twins where SQL has none."""

import numpy as np
from pyspark.sql import functions as F

from codebrook.operators import encode, fit, lut, metrics
from codebrook.plans import api, layout
from codebrook.plans.model import Model, by_rule
from codebrook.sources import tables

GOLD = by_rule()


def matrix(spark, data):
    return layout.matrix(spark.read.parquet(f"{data}/embeddings.parquet"))


def test_layout_deals_the_remainder():
    assert layout.bounds(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert layout.bounds(10, 4, "end") == [(0, 2), (2, 4), (4, 7), (7, 10)]
    assert layout.bounds(2, 5) == [(0, 1), (1, 2)]


def test_soft_score_peaks_at_the_tree_code(spark, data):
    m = matrix(spark, data)
    scores = encode.tree_soft_score(layout.to_cells(m), GOLD.tree(spark), temperature=1e-4)
    best = scores.groupBy("row_id", "c").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))
    hard = encode.long_codes(encode.encode_tree(m, GOLD))
    agree = metrics.assignment_agreement(hard, best).first()
    assert agree["share"] > 0.999


def test_decoders_agree_with_numpy(spark, data):
    m = matrix(spark, data)
    coded = encode.encode_tree(m, GOLD).orderBy("row_id").limit(50)
    table = np.array(GOLD.lut())
    for how in (lut.decode_lut, lut.decode_arrow):
        for r, c in zip(how(coded, GOLD.lut()).orderBy("row_id").collect(), coded.collect()):
            want = table[:, np.arange(8) * 16 + np.array(c["codes"])].sum(1)
            assert np.allclose(r["y"], want)


def test_ridge_never_raises_the_penalized_error(spark, data):
    m = matrix(spark, data)
    means = Model(GOLD.dims, GOLD.thresholds, fit.bucket_prototypes(m.withColumn("codes", api.codes_of(GOLD)), GOLD, layout.bounds(64, 8)))
    ridge = fit.ridge_refine(m, means, 64)

    def error(model):
        rebuilt = lut.reconstruct(encode.long_codes(encode.encode_tree(m, GOLD)), model.prototype_table(spark))
        return metrics.fit_report(lut.residual(layout.to_cells(m), rebuilt)).first()["mse_error"]

    assert error(ridge) <= error(means) + 1e-9


def test_binned_trees_are_nearly_as_good_as_exact_ones(spark, data):
    m = matrix(spark, data).select("row_id", F.slice("features", 1, 4).alias("features"))
    layers = layout.bounds(4, 1)

    def loss(model):
        x = np.array([r["features"] for r in m.orderBy("row_id").collect()])
        k = np.array([r["codes"][0] for r in encode.encode_tree(m, model).orderBy("row_id").collect()])
        return sum(((x[k == j] - x[k == j].mean(0)) ** 2).sum() for j in set(k))

    exact, binned = (fit.tree_fit(m, 4, 1, depth=2, exact=e) for e in (True, False))
    assert len(layers) == 1 and loss(binned) <= 1.05 * loss(exact)


def test_refitted_tables_are_better(spark, data):
    m = matrix(spark, data)
    coded = encode.encode_tree(m, GOLD)
    exact = lut.matmul_exact(layout.to_cells(m), GOLD.weight_table(spark))
    fitted = fit.lut_refit(coded, exact, 8, 16)

    def mse(table):
        y = lut.decode_arrow(coded, table).select("row_id", F.posexplode("y").alias("m", "y"))
        return metrics.error_metrics(metrics.error_pairs(y, exact)).first()["mse"]

    assert mse(fitted) < mse(GOLD.lut())


def test_model_round_trip(spark, tmp_path):
    tables.model_save(spark, GOLD, str(tmp_path), "a")
    assert tables.model_load(spark, str(tmp_path), "a", 8, 16) == GOLD


def test_labelled_images(spark, tmp_path):
    for label in ("cat", "dog"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "1.png").write_bytes(b"x" * 3)
    assert sorted((r["label"], r["length"]) for r in tables.scan_labelled_images(spark, str(tmp_path)).collect()) == [("cat", 3), ("dog", 3)]
