"""Codebook layout and the two forms of a matrix: feature arrays and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounds(dims: int, codebooks: int, remainder: str = "start") -> list[tuple[int, int]]:
    """(start, end) of each codebook; the first (or last) ones take the remainder."""
    if dims < 1 or codebooks < 1:
        raise ValueError("a layout needs at least one dimension and one codebook")
    codebooks = min(codebooks, dims)
    base, extra = divmod(dims, codebooks)
    sizes = [base + (c < extra if remainder == "start" else c >= codebooks - extra) for c in range(codebooks)]
    ends = [sum(sizes[: c + 1]) for c in range(codebooks)]
    return [(e - s, e) for s, e in zip(sizes, ends)]


def codebook_layout(spark: SparkSession, dims: int, codebooks: int, remainder: str = "start") -> DataFrame:
    """Rows (c, start_idx, end_idx), computed from the codebook number alone."""
    n = min(codebooks, dims)
    base, extra = divmod(dims, n)
    c = F.col("id").cast("int")
    more = F.least(c, F.lit(extra)) if remainder == "start" else F.greatest(c - (n - extra), F.lit(0))
    own = (c < extra) if remainder == "start" else (c >= n - extra)
    start = c * base + more
    return spark.range(n).select(c.alias("c"), start.cast("int").alias("start_idx"), (start + base + own.cast("int")).cast("int").alias("end_idx"))


def matrix(table: DataFrame, row_id: str = "vec_id", features: str = "embedding") -> DataFrame:
    """(row_id, features) with features as doubles."""
    return table.select(F.col(row_id).alias("row_id"), F.col(features).cast("array<double>").alias("features"))


def to_cells(m: DataFrame) -> DataFrame:
    """Long form (row_id, dim, x)."""
    return m.select("row_id", F.posexplode("features").alias("dim", "x"))


def fixed_cells(cells: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Cells as integers: sums and comparisons do not depend on the order of rows."""
    return cells.withColumn("x", F.rint(F.col("x") * scale).cast("bigint"))


def subvectors(m: DataFrame, layout: list[tuple[int, int]]) -> DataFrame:
    """(row_id, c, sub): each row's slice for every codebook."""
    parts = F.array(*(F.struct(F.lit(c).alias("c"), F.slice("features", a + 1, b - a).alias("sub")) for c, (a, b) in enumerate(layout)))
    return m.select("row_id", F.explode(parts).alias("p")).select("row_id", "p.c", "p.sub")


def codebook_of(dim: Column, layout: list[tuple[int, int]]) -> Column:
    """The codebook that holds a dimension."""
    out = F.lit(len(layout) - 1)
    for c in range(len(layout) - 2, -1, -1):
        out = F.when(dim < layout[c][1], F.lit(c)).otherwise(out)
    return out


def gather_dims(m: DataFrame, dims: list[int]) -> DataFrame:
    """The features at the given places, in that order."""
    return m.select("row_id", F.array(*(F.get("features", F.lit(d)) for d in dims)).alias("features"))


def sufficiency(m: DataFrame, codebooks: int, codes: int, largest: int = 10_000_000) -> DataFrame:
    """Rows per prototype and per dimension, memory of float32 rows, and a size flag."""
    n, d = F.count("*"), F.max(F.size("features"))
    return m.agg(n.alias("n_rows"), d.alias("n_dims")).select(
        "n_rows", F.col("n_dims").cast("int").alias("n_dims"),
        F.round(F.col("n_rows") / (codebooks * codes), 4).alias("rows_per_prototype"), F.round(F.col("n_rows") / F.col("n_dims"), 4).alias("rows_per_dim"),
        (F.col("n_rows") * F.col("n_dims") * 4).cast("bigint").alias("bytes_float32"), (F.col("n_rows") > largest).alias("too_large"),
    )
