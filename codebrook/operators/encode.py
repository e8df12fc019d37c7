"""Encoders: threshold trees, nearest centroids, soft assignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import Model
from .lut import small


def _doubles(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def tree_code(features: Column, dims, thresholds) -> Column:
    """Code of one codebook: at every level go right if the value exceeds the threshold.

    Built from plain comparisons and literal arrays, so it stays inside generated code.
    """
    code: Column | None = None
    for level, dim in enumerate(dims):
        at = thresholds[(1 << level) - 1 : (2 << level) - 1]
        limit = F.lit(float(at[0])) if code is None else F.get(_doubles(at), code)
        bit = (F.get(features, F.lit(dim)) > limit).cast("int")
        code = bit if code is None else code * 2 + bit
    return code


def encode_tree(m: DataFrame, model: Model) -> DataFrame:
    """(row_id, codes): codes of all codebooks of each row, without a shuffle."""
    codes = F.array(*(tree_code(F.col("features"), d, t) for d, t in zip(model.dims, model.thresholds)))
    return m.select("row_id", codes.alias("codes"))


def encode_tree_arrow(m: DataFrame, model: Model) -> DataFrame:
    """The same for deep trees: numpy over Arrow batches, the model broadcast instead of part of the plan.

    Rows without features, of another length than the first codes need, or with a null among them, have null codes.
    """
    shared = m.sparkSession.sparkContext.broadcast(model)
    width = 1 + max(d for dims in model.dims for d in dims)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cuts = [np.asarray(t) for t in own.thresholds]
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            codes, good = np.zeros((batch.num_rows, own.codebooks), np.int32), np.zeros(batch.num_rows, bool)
            for size in np.unique(sizes[sizes >= width]).tolist():
                at = np.flatnonzero(sizes == size)
                flat = pc.list_flatten(column.take(pa.array(at)))
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                node = np.zeros((len(at), own.codebooks), np.int64)
                for level in range(own.depth):
                    for c in range(own.codebooks):
                        node[:, c] = 2 * node[:, c] + (x[:, own.dims[c][level]] > cuts[c][(1 << level) - 1 : (2 << level) - 1][node[:, c]])
                codes[at], good[at] = node, ~np.isnan(x).any(1)
            offsets = pa.array(np.append(0, np.cumsum(good)) * own.codebooks, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes[good].ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row_id", "codes"])

    return m.select("row_id", "features").mapInArrow(rows, f"row_id {m.schema['row_id'].dataType.simpleString()}, codes array<int>")


def flat_codes(codes: Column, k: int = 16) -> Column:
    """codes + c * k, the places in a flat table."""
    return F.transform(codes, lambda x, c: x + c * k)


def long_codes(coded: DataFrame) -> DataFrame:
    """(row_id, c, k)."""
    return coded.select("row_id", F.posexplode("codes").alias("c", "k"))


def encode_tree_join(cells: DataFrame, tree: DataFrame, depth: int = 4) -> DataFrame:
    """Relational form: one equi-join with the tree a level; only split cells are kept.

    The tree has at most codebooks x (codes - 1) rows, and is broadcast if they are few.
    Cells may have a codebook of their own (`c`), as quantized ones do.
    """
    used = tree.select("c", "level", "dim").distinct()
    wide = cells.join(small(used), ["c", "dim"] if "c" in cells.columns else "dim").groupBy("row_id", "c").agg(F.map_from_entries(F.collect_list(F.struct("level", "x"))).alias("at"))
    state = wide.withColumn("node", F.lit(0))
    for level in range(depth):
        step = small(tree.where(F.col("level") == level).select("c", "node", "threshold"))
        state = state.join(step, ["c", "node"]).withColumn("node", F.col("node") * 2 + (F.element_at("at", F.lit(level)) > F.col("threshold")).cast("int")).drop("threshold")
    return state.select("row_id", "c", F.col("node").alias("k"))


def distances(cells: DataFrame, centroids: DataFrame, distance=lambda x, v: (x - v) * (x - v)) -> DataFrame:
    """(row_id, c, k, dist) over all codes; centroids (c, k, dim, value) are model-sized."""
    return cells.join(small(centroids), "dim").groupBy("row_id", "c", "k").agg(F.sum(distance(F.col("x"), F.col("value"))).alias("dist"))


def nearest(dist: DataFrame) -> DataFrame:
    """(row_id, c, k) of the least distance; ties go to the smaller code."""
    return dist.groupBy("row_id", "c").agg(F.min(F.struct("dist", "k")).alias("best")).select("row_id", "c", "best.k")


def assign_nearest(cells: DataFrame, centroids: DataFrame) -> DataFrame:
    return nearest(distances(cells, centroids))


def nearest_code(features: Column, centroids: list[list[float]], dims: list[int]) -> Column:
    """Array form of nearest-centroid assignment of one codebook, without a shuffle."""
    table = F.array(*(_doubles(row) for row in centroids))
    own = F.slice(features, dims[0] + 1, len(dims))
    scored = F.transform(table, lambda row, k: F.struct(F.aggregate(F.zip_with(own, row, lambda x, v: (x - v) * (x - v)), F.lit(0.0), lambda s, d: s + d).alias("d"), k.alias("k")))
    return F.array_min(scored)["k"]


def int8(value: Column, scale: float = 127.0) -> Column:
    """Half-even rounding to -128..127."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(value * scale).cast("int")))


def assign_l1_int8(cells: DataFrame, centroids: DataFrame, scale: float = 127.0) -> DataFrame:
    """Nearest by L1 on 8-bit values; differences are taken as integers."""
    return nearest(distances(cells.withColumn("x", int8(F.col("x"), scale)), centroids.withColumn("value", int8(F.col("value"), scale)), lambda x, v: F.abs(x - v)))


def assign_hamming(cells: DataFrame, centroids: DataFrame, scale: float = 127.0) -> DataFrame:
    """Nearest by Hamming distance of the high four bits of 8-bit values."""
    high = lambda x, v: F.bit_count(x.bitwiseXOR(v).bitwiseAND(F.lit(0xF0)))
    return nearest(distances(cells.withColumn("x", int8(F.col("x"), scale)), centroids.withColumn("value", int8(F.col("value"), scale)), high))


def softmax(scores: DataFrame, score: str, keys: list[str], name: str = "p") -> DataFrame:
    """exp(score - max) over its sum, within keys."""
    w = Window.partitionBy(*keys)
    e = scores.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def soft_assign(dist: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(row_id, c, k, p): softmax of -distance / temperature over codes."""
    return softmax(dist.withColumn("_s", -F.col("dist") / temperature), "_s", ["row_id", "c"]).select("row_id", "c", "k", "p")


def leaf_paths(depth: int) -> list[tuple[int, int, int, int]]:
    """(leaf, level, node, sign) along the way to each leaf; sign is 1 to the right."""
    return [(leaf, l, leaf >> (depth - l), 1 if (leaf >> (depth - l - 1)) & 1 else -1) for leaf in range(1 << depth) for l in range(depth)]


def tree_soft_score(cells: DataFrame, tree: DataFrame, depth: int = 4, temperature: float = 1.0) -> DataFrame:
    """(row_id, c, k, score): sum of signed tanh margins on the way to each leaf."""
    spark = cells.sparkSession
    paths = spark.createDataFrame(leaf_paths(depth), "k int, level int, node int, sign int")
    margins = cells.join(small(tree), "dim").select("row_id", "c", "level", "node", F.tanh((F.col("x") - F.col("threshold")) / temperature).alias("t"))
    return margins.join(F.broadcast(paths), ["level", "node"]).groupBy("row_id", "c", "k").agg(F.sum(F.col("t") * F.col("sign")).alias("score"))


def tree_apply(m: DataFrame, dims: list[int], thresholds: list[float], classes: list[int]) -> DataFrame:
    """A tree with its own dim at every node (heap order) and a class at every leaf."""
    depth = len(classes).bit_length() - 1
    node = F.lit(0)
    for _ in range(depth):
        value = F.get("features", F.get(F.array(*map(F.lit, dims)), node))
        node = node * 2 + 1 + (value > F.get(_doubles(thresholds), node)).cast("int")
    return m.select("row_id", F.get(F.array(*map(F.lit, classes)), node - (len(classes) - 1)).alias("class"))


def cascade_predict(levels: DataFrame, columns: list[str]) -> DataFrame:
    """The first level's answer that is not -1; the last one's as it is."""
    return levels.withColumn("class", F.coalesce(*(F.nullif(F.col(c), F.lit(-1)) for c in columns[:-1]), F.col(columns[-1])))
