"""Pictures as tables: patches, shifted slices, pooling, normalization, augmentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lut import small

#: Values of patches that are made at a time.
PATCH_VALUES = 1 << 18


def pixels(m: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """(img_id, ch, y, x, v) of pictures stored channel by channel, row by row; one channel without a height."""
    at = F.col("i") % (width * height) if height else F.col("i")
    channel = F.floor(F.col("i") / (width * height)).cast("int") if height else F.lit(0)
    cells = m.select(F.col("row_id").alias("img_id"), F.posexplode("features").alias("i", "v"))
    return cells.select("img_id", channel.alias("ch"), F.floor(at / width).cast("int").alias("y"), (at % width).alias("x"), "v")


def out_size(size: int, kernel: int, stride: int = 1, padding: int = 0, dilation: int = 1) -> int:
    return (size + 2 * padding - dilation * (kernel - 1) - 1) // stride + 1


def _grid(rows: int, cols: int, a: str, b: str) -> Column:
    return F.array(*(F.struct(F.lit(i).alias(a), F.lit(j).alias(b)) for i in range(rows) for j in range(cols)))


def im2col(m: DataFrame, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0, dilation: int = 1, channels: int = 1) -> DataFrame:
    """(img_id, oy, ox, pos, v): every patch's values, 0 outside; made inside each row.

    Positions go channel by channel, as pictures do.
    """
    oh, ow = (out_size(s, kernel, stride, padding, dilation) for s in (height, width))
    spots = m.select("row_id", "features", F.explode(_grid(oh, ow, "oy", "ox")).alias("o")).withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    spots = spots.select("row_id", "features", "o.oy", "o.ox", "ch", F.explode(_grid(kernel, kernel, "ky", "kx")).alias("k"))
    y = F.col("oy") * stride + F.col("k.ky") * dilation - padding
    x = F.col("ox") * stride + F.col("k.kx") * dilation - padding
    inside = y.between(0, height - 1) & x.between(0, width - 1)
    pos = (F.col("ch") * kernel + F.col("k.ky")) * kernel + F.col("k.kx")
    return spots.select(F.col("row_id").alias("img_id"), "oy", "ox", pos.alias("pos"), F.when(inside, F.get("features", F.col("ch") * (height * width) + y * width + x)).otherwise(0.0).alias("v"))


def patch_rows(m: DataFrame, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0, channels: int = 1, dilation: int = 1) -> DataFrame:
    """(row_id, features): one row a patch, numbered img_id * places + place; cut from Arrow batches by one index, without a shuffle.

    Values that a picture lacks are null, those outside of it 0.
    """
    oh, ow = (out_size(s, kernel, stride, padding, dilation) for s in (height, width))
    # the place in the picture of each patch's values, -1 outside
    oy, ox, c, ky, kx = np.ogrid[:oh, :ow, :channels, :kernel, :kernel]
    y, x = oy * stride + ky * dilation - padding, ox * stride + kx * dilation - padding
    at = np.where((y >= 0) & (y < height) & (x >= 0) & (x < width), c * (height * width) + y * width + x, -1).reshape(oh * ow, -1)
    places, wide = at.shape
    step = max(1, PATCH_VALUES // max(at.size, 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                lengths = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy().astype(np.int64)[:, None, None]
                flat = part.column(1).flatten().cast(pa.float64())
                own = np.where(at < lengths, np.cumsum(lengths)[:, None, None] - lengths + at, len(flat) + 1)
                values = pa.concat_arrays([flat, pa.array([0.0, None], pa.float64())]).take(pa.array(np.where(at < 0, len(flat), own).reshape(-1)))
                features = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, wide, dtype=np.int32)), values)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), places)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(places, dtype=np.int32), part.num_rows)), features], ["row_id", "place", "features"])

    kinds = T.StructType([m.schema["row_id"], T.StructField("place", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return m.select("row_id", "features").mapInArrow(cut, kinds).select((F.col("row_id") * places + F.col("place")).alias("row_id"), "features")


def patches(cols: DataFrame) -> DataFrame:
    """(row_id, features): one row per patch, numbered img_id * 2**40 + place; sides up to 2**20."""
    key = F.col("img_id") * (1 << 40) + F.col("oy").cast("bigint") * (1 << 20) + F.col("ox")
    return cols.groupBy(key.alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("features"))


def kn2col(px: DataFrame, kernels: DataFrame, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """(img_id, m, oy, ox, y): convolution as a sum over kernel positions of shifted pictures.

    `kernels` (m, ch, ky, kx, w) is model-sized, and broadcast if its rows are few.
    """
    oh, ow = out_size(height, kernel, stride, padding), out_size(width, kernel, stride, padding)
    ty, tx = F.col("y") + padding - F.col("ky"), F.col("x") + padding - F.col("kx")
    shifted = px.join(small(kernels), "ch").where((ty % stride == 0) & (tx % stride == 0))
    shifted = shifted.select("img_id", "m", F.floor(ty / stride).cast("int").alias("oy"), F.floor(tx / stride).cast("int").alias("ox"), (F.col("v") * F.col("w")).alias("p"))
    return shifted.where(F.col("oy").between(0, oh - 1) & F.col("ox").between(0, ow - 1)).groupBy("img_id", "m", "oy", "ox").agg(F.sum("p").alias("y"))


def pool(px: DataFrame, k: int, how=F.max) -> DataFrame:
    """k x k pooling without overlap."""
    return px.groupBy("img_id", "ch", F.floor(F.col("y") / k).cast("int").alias("py"), F.floor(F.col("x") / k).cast("int").alias("px")).agg(how("v").alias("v"))


def global_avg_pool(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id", "ch").agg(F.avg("v").alias("v"))


def normalize(px: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    pick = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("ch"))
    return px.withColumn("v", (F.col("v") - pick(mean)) / pick(std))


def center_crop(px: DataFrame, height: int, width: int, size: int) -> DataFrame:
    y0, x0 = (height - size) // 2, (width - size) // 2
    return px.where(F.col("y").between(y0, y0 + size - 1) & F.col("x").between(x0, x0 + size - 1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def crop_pad_flip(px: DataFrame, height: int, width: int, pad: int, shift: Column, flip: Column) -> DataFrame:
    """Pad by zeros, crop to the old size at a shift, flip on demand; zeros are left out.

    `shift` has dy and dx in 0..2 pad; both are functions of the picture's id, so a
    lost task makes the same picture again.
    """
    y, x = F.col("y") + pad - shift["dy"], F.col("x") + pad - shift["dx"]
    moved = px.select("img_id", "ch", y.alias("y"), x.alias("x"), "v", flip.alias("_f")).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return moved.withColumn("x", F.when(F.col("_f"), width - 1 - F.col("x")).otherwise(F.col("x"))).drop("_f")


def stride_pad_channels(px: DataFrame, pad: int) -> DataFrame:
    """Every second pixel, channels moved up by `pad` (the channels around are zero)."""
    return px.where("y % 2 = 0 AND x % 2 = 0").select("img_id", (F.col("ch") + pad).alias("ch"), F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "v")


def batch_norm(values: DataFrame, channel: str, value: str, eps: float = 1e-5) -> DataFrame:
    """(x - mean) / sqrt(var + eps) with each channel's moments, which are broadcast."""
    moments = values.groupBy(channel).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    return values.join(F.broadcast(moments), channel).withColumn("bn", (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + eps)).drop("_mean", "_var")


def batch_norm_fused(q: DataFrame, channel: str, value: str, scale: float, zero: float, eps: float = 1e-5) -> DataFrame:
    """The same on quantized values as one multiply-add."""
    moments = q.groupBy(channel).agg(F.avg((F.col(value) - zero) * scale).alias("_mean"), F.var_pop((F.col(value) - zero) * scale).alias("_var"))
    by = F.lit(scale) / F.sqrt(F.col("_var") + eps)
    moments = moments.select(channel, by.alias("_a"), (-F.lit(zero) * by - F.col("_mean") / F.sqrt(F.col("_var") + eps)).alias("_b"))
    return q.join(F.broadcast(moments), channel).withColumn("bn", F.col(value) * F.col("_a") + F.col("_b")).drop("_a", "_b")


def fold_output(outputs: DataFrame, out_height: int, out_width: int) -> DataFrame:
    """Rows numbered img * (oh * ow) + place as (img_id, ch, y, x, v)."""
    n = out_height * out_width
    place = F.col("row_id") % n
    return outputs.select(F.floor(F.col("row_id") / n).alias("img_id"), F.col("m").alias("ch"), F.floor(place / out_width).cast("int").alias("y"), (place % out_width).cast("int").alias("x"), F.col("y").alias("v"))


def bias_relu_residual(values: DataFrame, bias: Column, skip: DataFrame | None = None, keys=("row_id", "m")) -> DataFrame:
    """max(0, y + bias [+ skip])."""
    y = F.col("y") + bias
    if skip is not None:
        values = values.join(skip.select(*keys, F.col("y").alias("_skip")), list(keys))
        y = y + F.col("_skip")
    return values.select(*keys, F.greatest(F.lit(0.0), y).alias("y"))
