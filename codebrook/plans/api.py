"""End to end: learn from one matrix, answer products for another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify, fit, images, lut, metrics, runs
from ..operators.encode import encode_tree, tree_code
from .model import Model


def codes_of(model: Model):
    """The column of all codes of a row's features."""
    return F.array(*(tree_code(F.col("features"), d, t) for d, t in zip(model.dims, model.thresholds)))


def products(weights) -> Column:
    """The exact products of a row's features."""
    dot = lambda row: F.aggregate(F.zip_with("features", F.array(*(F.lit(float(v)) for v in row)), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return F.array(*map(dot, weights))


def both_products(m: DataFrame, model: Model) -> DataFrame:
    """All columns of m with `a`, the looked-up outputs, and `d`, the exact ones; no shuffle."""
    spots = [tree_code(F.col("features"), d, t) for d, t in zip(model.dims, model.thresholds)]
    return m.withColumns({"a": lut.look_up(spots, model.lut(), model.codes), "d": products(model.weights)}).drop("features")


def learn(train: DataFrame, weights: list[list[float]], dims: int, codebooks: int, exact: bool = False, ridge: bool = True, fitter=fit.tree_fit) -> Model:
    """Trees, prototypes and (with `ridge`) their refinement for a weight matrix."""
    model = fitter(train, dims, codebooks, exact=exact)
    if ridge:
        model = fit.ridge_refine(train, model, dims)
    return fit.with_weights(model, weights)


def approx_matmul(train: DataFrame, rows: DataFrame, weights: list[list[float]], dims: int, codebooks: int, encoder=encode_tree, quantize: bool = False, **options) -> DataFrame:
    """(row_id, y): products of rows with the weights by look-up, learned on `train`.

    With `quantize`, table entries are 8-bit whole numbers, and sums are led back at the end.
    """
    model = learn(train, weights, dims, codebooks, **options)
    decode = lut.decode_arrow_quantized if quantize else lut.decode_arrow
    return decode(encoder(rows, model), model.lut(), model.codes)


def with_bias(y: DataFrame, bias: list[float] | None) -> DataFrame:
    return y if bias is None else y.select("row_id", F.zip_with("y", F.array(*(F.lit(float(b)) for b in bias)), lambda v, b: v + b).alias("y"))


def approx_linear(train: DataFrame, rows: DataFrame, weights: list[list[float]], bias: list[float] | None, dims: int, codebooks: int, lead: list[str] | None = None, **options) -> DataFrame:
    """`approx_matmul` plus a bias per output.

    `lead` names the columns that number a row where it has several, as (batch, place); they
    take the place of row_id in `rows` and in the result.
    """
    if not lead:
        return with_bias(approx_matmul(train, rows, weights, dims, codebooks, **options), bias)
    numbered = rows.select(F.struct(*lead).alias("row_id"), "features")
    return with_bias(approx_matmul(train, numbered, weights, dims, codebooks, **options), bias).select("row_id.*", "y")


def approx_conv2d(train: DataFrame, rows: DataFrame, kernels: list[list[float]], height: int, width: int, kernel: int, codebooks: int, stride: int = 1, padding: int = 0, channels: int = 1, bias: list[float] | None = None, loop: str = "im2col", dilation: int = 1, **options) -> DataFrame:
    """(img_id, ch, y, x, v): a look-up convolution of pictures, folded back to pictures.

    A kernel is flat, channel by channel; its values lie `dilation` apart in the picture.
    With loop "im2col" one model answers whole patches; with "kn2col" each place of the
    kernel has a model of its own over the channels. These are learned together, and a patch
    looks all of them up in one sum: pictures are read once.
    """
    oh, ow = (images.out_size(s, kernel, stride, padding, dilation) for s in (height, width))
    patch = lambda m: images.patch_rows(m, height, width, kernel, stride, padding, channels, dilation)
    if loop == "im2col":
        y = approx_matmul(patch(train), patch(rows), kernels, channels * kernel * kernel, codebooks, **options)
    else:
        places = kernel * kernel
        shifted = F.array(*(F.struct(F.lit(str(p)).alias("layer"), F.array(*(F.get("features", F.lit(c * places + p)) for c in range(channels))).alias("features")) for p in range(places)))
        learned = patch(train).select("row_id", F.explode(shifted).alias("s")).select("row_id", "s.*")
        models = fit_many(learned, [(str(p), codebooks) for p in range(places)], channels)
        spots, table = [], [[] for _ in kernels]
        for p in range(places):
            model = fit.with_weights(models[str(p), codebooks], [[row[c * places + p] for c in range(channels)] for row in kernels])
            spots += [tree_code(F.col("features"), [d * places + p for d in dims], t) for dims, t in zip(model.dims, model.thresholds)]
            table = [held + more for held, more in zip(table, model.lut())]
        y = lut.decode_arrow(patch(rows).select("row_id", F.array(*spots).alias("codes")), table, model.codes)
    long = with_bias(y, bias).select("row_id", F.posexplode("y").alias("m", "y"))
    return images.fold_output(long, oh, ow)


def fit_many(layers: dict[str, DataFrame] | DataFrame, configs: DataFrame | list[tuple], dims: int | dict[str, int], done: DataFrame | None = None, **options) -> dict[tuple, Model]:
    """Models of all (layer, c) or (layer, c, k) configurations that are not done yet, learned together in one job a level.

    Layers are a table with a `layer` column, or tables by name; they may have different
    widths (`dims` by layer). `k`, a power of two, is the number of codes. Configurations are few.
    """
    if isinstance(layers, dict):
        layers = reduce(DataFrame.unionByName, (m.select("row_id", "features").withColumn("layer", F.lit(name)) for name, m in layers.items()))
    if isinstance(configs, DataFrame):
        key = [c for c in ("layer", "c", "k") if c in configs.columns]
        todo = configs if done is None else runs.missing(configs, done, key)
        configs = [tuple(r) for r in todo.select(*key).distinct().orderBy(*key).collect()]
    for _, _, *k in configs:
        if k and (k[0] < 2 or k[0] & (k[0] - 1)):
            raise ValueError(f"{k[0]} codes; a tree has a power of two of them")
    return fit.tree_fit_many(layers, dims, {(layer, c, *k): (layer, c, *(x.bit_length() - 1 for x in k)) for layer, c, *k in configs}, **options)


def config_sweep(m: DataFrame, weights: list[list[float]], dims: int, codebooks: list[int], bits: tuple[int, ...] = (0,)) -> DataFrame:
    """One report row for each number of codebooks and width of the tables' entries (0: not quantized).

    All models are learned together; a number of codebooks answers all its widths in one pass.
    """
    models = fit_many({"": m}, [("", c) for c in codebooks], dims)
    out = None
    for c in codebooks:
        model = fit.with_weights(models["", c], weights)
        rows = m.select(codes_of(model).alias("codes"), products(model.weights).alias("d"))
        spots = [F.get("codes", F.lit(i)) for i in range(model.codebooks)]
        each = F.array(*(F.struct(F.lit(b).alias("bits"), lut.look_up(spots, lut.table_at(model.lut(), b), model.codes).alias("a")) for b in bits))
        pairs = rows.select("d", F.explode(each).alias("e")).select("e.bits", F.explode(F.arrays_zip(F.col("e.a").alias("a"), "d")).alias("p")).select("bits", "p.a", "p.d")
        row = metrics.error_metrics(pairs, "bits").withColumn("c", F.lit(c))
        out = row if out is None else out.unionByName(row)
    return out


def best_of_restarts(m: DataFrame, dims: int, codebooks: int, seeds: list[int], **options) -> tuple[int, list, float]:
    """The seed whose k-means ends with the least inertia, its centroids, and that; all seeds share their scans."""
    tried = fit.kmeans_many(m, dims, codebooks, seeds=seeds, **options)
    return min(((seed, *found) for seed, found in tried.items()), key=lambda t: (t[2], t[0]))


def evaluate(rows: DataFrame, fn) -> DataFrame:
    """A pluggable evaluator: a function from DataFrame to DataFrame with its metrics."""
    out = fn(rows)
    if not isinstance(out, DataFrame):
        raise TypeError("an evaluator returns a DataFrame")
    return out


def distill_trees(m: DataFrame, near: DataFrame, layout: list[tuple[int, int]], codes: int, depth: int = 4) -> DataFrame:
    """(row_id, c, k, class): classifiers that imitate codes (row_id, c, k) of every codebook.

    The codes of a codebook are dealt to three levels by frequency; a level's tree knows its
    own codes, and passes the others on to the next one. All trees grow together.
    """
    return classify.distill(m, near.where(F.col("k") < codes), layout, depth)
