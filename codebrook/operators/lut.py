"""Look-up tables: building, quantizing, decoding, reconstructing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep

#: Largest table that is written into a plan; larger ones are broadcast as arrays.
UNROLL = 65536


def lut_build(prototypes: DataFrame, weights: DataFrame) -> DataFrame:
    """(m, c, k, value): products of prototypes with weights over their common dims."""
    return prototypes.join(weights, "dim").groupBy("m", "c", "k").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def lut_build_block(centroids: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """The same from block-local centroids (c, k, d, value) and weight slices."""
    sliced = weights.select("m", F.floor(F.col("dim") / width).cast("int").alias("c"), (F.col("dim") % width).alias("d"), "w")
    return centroids.join(sliced, ["c", "d"]).groupBy("m", "c", "k").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def look_up(spots: list[Column], lut: list[list[float]], codes: int = 16) -> Column:
    """Outputs as an array: for each codebook the code's row of all outputs, added up.

    Every code stands once in the expression, so that plans stay small.
    """
    rows = lambda c: F.array(*(F.array(*(F.lit(float(row[c * codes + k])) for row in lut)) for k in range(codes)))
    total = None
    for c, code in enumerate(spots):
        own = F.get(rows(c), code)
        total = own if total is None else F.zip_with(total, own, lambda s, v: s + v)
    return total


def decode_lut(coded: DataFrame, lut: list[list[float]], codes: int = 16) -> DataFrame:
    """(row_id, y): outputs of each row by looking up its codes, without a shuffle.

    Tables of more than `UNROLL` entries go through `decode_arrow`, which gives the same.
    """
    if len(lut) * len(lut[0]) > UNROLL:
        return decode_arrow(coded, lut, codes)
    many = len(lut[0]) // codes
    y = look_up([F.get("codes", F.lit(c)) for c in range(many)], lut, codes)
    return coded.select("row_id", F.when((F.size("codes") == many) & ~F.exists("codes", lambda k: k.isNull()), y).alias("y"))


def decode_arrow(coded: DataFrame, lut: list[list[float]], codes: int = 16) -> DataFrame:
    """The same for many outputs: numpy gathers over Arrow batches; the table is broadcast.

    Codebook by codebook, so that a batch needs room for its outputs only. A row without
    codes, with too few or too many of them, or with a null among them, has null outputs.
    """
    table = np.asarray(lut, np.float64)
    shared = coded.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))
    many = table.shape[1] // codes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        step = max(1, (1 << 21) // max(own.shape[1], 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                column = batch.column(1)
                sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
                good = np.flatnonzero(sizes == many)
                flat = pc.list_flatten(column.take(pa.array(good)))
                k = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), many)
                holes = np.isnan(k).any(1)
                good, k = good[~holes], k[~holes].astype(np.int64)
                y = np.zeros((len(good), own.shape[1]))
                for c in range(many):
                    y += own[k[:, c] + c * codes]
                have = np.zeros(batch.num_rows, bool)
                have[good] = True
                offsets = pa.array(np.append(0, np.cumsum(have)) * own.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()), mask=pa.array(~have))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row_id", "y"])

    return coded.select("row_id", "codes").mapInArrow(rows, f"row_id {coded.schema['row_id'].dataType.simpleString()}, y array<double>")


#: Rows up to which a model-sized side of a join is broadcast; beyond, both sides are shuffled.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A model-sized side of a join, made once and marked for broadcast if a count of its rows allows it."""
    kept = keep(df)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def decode_join(codes: DataFrame, lut: DataFrame) -> DataFrame:
    """(row_id, m, y) in relational form; a table too large to broadcast is shuffled on (c, k)."""
    return codes.join(small(lut), ["c", "k"]).groupBy("row_id", "m").agg(F.sum("value").alias("y"))


def output_group(lut: DataFrame, group: int, groups: int, outputs: int) -> DataFrame:
    """One contiguous block of outputs; the filter sits below any later join."""
    size = -(-outputs // groups)
    return lut.where(F.col("m").between(group * size, min(outputs, (group + 1) * size) - 1))


def reconstruct(codes: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(row_id, dim, xhat): the sum of the coded prototypes."""
    return codes.join(small(prototypes), ["c", "k"]).groupBy("row_id", "dim").agg(F.sum("value").alias("xhat"))


def residual(cells: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(row_id, dim, x, r) with r = x - xhat."""
    return cells.join(rebuilt, ["row_id", "dim"]).select("row_id", "dim", "x", (F.col("x") - F.col("xhat")).alias("r"))


def lut_ranges(lut: DataFrame) -> DataFrame:
    """Least and largest entry of each codebook and their gap."""
    return lut.groupBy("c").agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn("gap", F.col("high") - F.col("low"))


def lut_params(lut: DataFrame) -> DataFrame:
    """One row (shift, scale): sum of the least entries, and 2^-ceil(log2 gap) * 255.5."""
    gap = F.max("gap")
    scale = F.when(gap > 0, F.pow(F.lit(2.0), -F.ceil(F.log2(gap))) * F.lit(255.5 - 1e-10)).otherwise(F.lit(1.0))
    return lut_ranges(lut).agg(F.sum("low").alias("shift"), scale.alias("scale"))


def quantize_u8(lut: DataFrame) -> DataFrame:
    """(m, c, k, q): entries less their codebook's least one, scaled and rounded half up."""
    low = lut_ranges(lut).select("c", "low")
    return lut.join(F.broadcast(low), "c").crossJoin(F.broadcast(lut_params(lut).select("scale"))).select("m", "c", "k", F.floor((F.col("value") - F.col("low")) * F.col("scale") + 0.5).cast("int").alias("q"))


def decode_quantized(codes: DataFrame, q: DataFrame, params: DataFrame) -> DataFrame:
    """(row_id, m, y): integer sums, then the affine map back."""
    sums = codes.join(small(q), ["c", "k"]).groupBy("row_id", "m").agg(F.sum("q").alias("s"))
    return sums.crossJoin(F.broadcast(params)).select("row_id", "m", (F.col("s") / F.col("scale") + F.col("shift")).alias("y"))


def i8_scale(lut: DataFrame) -> DataFrame:
    return lut.agg(((F.max("value") - F.min("value")) / 255.0).alias("scale"))


def quantize_i8(lut: DataFrame) -> DataFrame:
    """(m, c, k, q): signed 8 bit, half-even, clamped."""
    v = F.rint(F.col("value") / F.col("scale"))
    return lut.crossJoin(F.broadcast(i8_scale(lut))).select("m", "c", "k", F.greatest(F.lit(-128.0), F.least(F.lit(127.0), v)).cast("int").alias("q"))


def saturation(lut: DataFrame) -> DataFrame:
    """Entries that the signed range clips."""
    v = F.rint(F.col("value") / F.col("scale"))
    return lut.crossJoin(F.broadcast(i8_scale(lut))).agg(F.count_if((v < -128) | (v > 127)).alias("saturated"), F.count("*").alias("entries"))


def decode_i8(codes: DataFrame, q: DataFrame, scale: DataFrame) -> DataFrame:
    sums = codes.join(small(q), ["c", "k"]).groupBy("row_id", "m").agg(F.sum("q").alias("s"))
    return sums.crossJoin(F.broadcast(scale)).select("row_id", "m", (F.col("s") * F.col("scale")).alias("y"))


def split_quant_params(cells: DataFrame, tree: DataFrame) -> DataFrame:
    """(c, dim, offset, scale) that bring split columns into 0..255 with room at the ends."""
    seen = cells.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cuts = tree.groupBy("c", "dim").agg(F.min("threshold").alias("least"), F.max("threshold").alias("most"))
    offset = (F.col("lo") + F.col("least")) / 2
    upper = (F.col("hi") + F.col("most")) / 2 - offset
    return cuts.join(seen, "dim").select("c", "dim", offset.alias("offset"), F.pow(F.lit(2.0), F.log2(254.0 / upper).cast("int")).alias("scale"))


def quantize_tree(tree: DataFrame, params: DataFrame) -> DataFrame:
    """The tree's thresholds brought into 0..255, as integers (c, level, node, dim, threshold)."""
    t = (F.col("threshold") - F.col("offset")) * F.col("scale")
    return tree.join(params, ["c", "dim"]).select("c", "level", "node", "dim", F.greatest(F.lit(0.0), F.least(F.lit(255.0), t)).cast("int").alias("threshold"))


def quantize_cells(cells: DataFrame, params: DataFrame) -> DataFrame:
    """(row_id, c, dim, x): split columns brought into 0..255 for each codebook, as integers."""
    x = F.floor((F.col("x") - F.col("offset")) * F.col("scale") + 0.5)
    return cells.join(small(params), "dim").select("row_id", "c", "dim", F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int").alias("x"))


def quantized_table(lut: list[list[float]], codes: int = 16) -> tuple[list[list[float]], float, float]:
    """A table's entries as whole numbers from 0 to 255, and (scale, shift) that lead sums back.

    The model-sized twin of `quantize_u8` and `lut_params`.
    """
    t = np.asarray(lut, np.float64).reshape(len(lut), -1, codes)
    low, high = t.min((0, 2)), t.max((0, 2))
    gap = float((high - low).max())
    scale = 2.0 ** -np.ceil(np.log2(gap)) * (255.5 - 1e-10) if gap > 0 else 1.0
    q = np.floor((t - low[None, :, None]) * scale + 0.5)
    return q.reshape(len(lut), -1).tolist(), float(scale), float(low.sum())


def table_at(lut: list[list[float]], bits: int) -> list[list[float]]:
    """A table whose entries are quantized to signed `bits` and led back; as it is for 0."""
    if not bits:
        return lut
    t = np.asarray(lut, np.float64)
    top = 2.0 ** (bits - 1) - 1
    scale = (np.abs(t).max() or 1.0) / top
    return (np.clip(np.rint(t / scale), -top - 1, top) * scale).tolist()


def decode_arrow_quantized(coded: DataFrame, lut: list[list[float]], codes: int = 16) -> DataFrame:
    """(row_id, y): sums of 8-bit entries, led back by one multiply-add."""
    q, scale, shift = quantized_table(lut, codes)
    return decode_arrow(coded, q, codes).select("row_id", F.transform("y", lambda s: s / scale + shift).alias("y"))


def fake_quantized(features: Column, weights: list[list[float]], bits: int, x_top: float) -> Column:
    """The products of a row's features and weights that are both quantized to `bits`."""
    top = 2.0 ** (bits - 1) - 1
    w_top = max(abs(v) for row in weights for v in row) or 1.0
    own = [[float(np.clip(np.rint(v / (w_top / top)), -top - 1, top) * (w_top / top)) for v in row] for row in weights]
    scale = F.lit((x_top or 1.0) / top)
    return products(F.transform(features, lambda x: fake_quantize(x, scale, bits)), own)


def fake_quantized_product(m: DataFrame, weights: list[list[float]], bits: int, x_top: float) -> DataFrame:
    """(row_id, y): the exact product of features and weights that are both quantized to `bits`."""
    return m.select("row_id", fake_quantized(F.col("features"), weights, bits, x_top).alias("y"))


def fake_quantize(x: Column, scale: Column, bits: int) -> Column:
    """Quantize to signed `bits` and back, half-even."""
    top = float(2 ** (bits - 1) - 1)
    return F.greatest(F.lit(-top - 1), F.least(F.lit(top), F.rint(x / scale))) * scale


def dequantize(q: Column, zero: Column, scale: Column) -> Column:
    return (q - zero) / scale


def matmul_exact(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(row_id, m, y): exact product; the weights are outputs x dims rows."""
    return cells.join(small(weights), "dim").groupBy("row_id", "m").agg(F.sum(F.col("x") * F.col("w")).alias("y"))


def products(features: Column | str, weights: list[list[float]]) -> Column:
    """The array of a row's products with each row of weights."""
    dot = lambda row: F.aggregate(F.zip_with(features, F.array(*(F.lit(float(v)) for v in row)), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return F.array(*map(dot, weights))


def matmul_arrays(m: DataFrame, weights: list[list[float]]) -> DataFrame:
    """(row_id, y): the exact product of each row in place, without a shuffle."""
    return m.select("row_id", products("features", weights).alias("y"))
