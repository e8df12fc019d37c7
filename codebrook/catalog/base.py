"""What the registered queries share: tables, the rule-made model, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode, lut
from ..plans import layout
from ..plans.model import Model, by_rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

D, C, K, M, DEPTH = 64, 8, 16, 10, 4
GOLD: Model = by_rule(D, C, DEPTH, M)
LAYOUT = layout.bounds(D, C)


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            # no negative zeros on either side
            SQL[name] = sql.replace(", 4) AS ", ", 4) + 0.0 AS ")
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.matrix(read(spark, sf_dir, "embeddings"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_cells(matrix(spark, sf_dir))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_tree(matrix(spark, sf_dir), GOLD)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.long_codes(coded(spark, sf_dir))


def lut_table(spark: SparkSession) -> DataFrame:
    return lut.lut_build(GOLD.prototype_table(spark), GOLD.weight_table(spark))


def learned_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, c, k, value) of the data: bucket means of the sub-vectors against the means of the labels."""
    m = matrix(spark, sf_dir)
    with_codes = m.withColumn("codes", F.array(*(encode.tree_code(F.col("features"), x, t) for x, t in zip(GOLD.dims, GOLD.thresholds))))
    per = F.array(*(F.struct(F.lit(c).alias("c"), F.get("codes", F.lit(c)).alias("k"), F.lit(a).alias("a"), F.slice("features", a + 1, b - a).alias("sub")) for c, (a, b) in enumerate(LAYOUT)))
    own = with_codes.select(F.explode(per).alias("p")).select("p.c", "p.k", "p.a", F.posexplode("p.sub").alias("j", "x"))
    means = own.groupBy("c", "k", (F.col("a") + F.col("j")).alias("dim")).agg(F.avg("x").alias("value"))
    return lut.lut_build(means, label_means(spark, sf_dir))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, dim, w): the mean embedding of each label as a row of weights."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return e.groupBy(F.col("label").alias("m"), "dim").agg(F.avg("x").alias("w"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, dim, x, r) of the rule-made model."""
    return lut.residual(cells(spark, sf_dir), lut.reconstruct(codes(spark, sf_dir), GOLD.prototype_table(spark)))


def r4(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 4) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r4(c) for c in columns})


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v + "'" for v in r) + ")" for r in rows)


# SQL fragments; each is a common table expression and uses those before it
CELLS = "cells AS (SELECT vec_id AS row_id, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
FEATURES = "mat AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS f FROM embeddings)"
TREE = f"tree(c, level, node, dim, threshold) AS (SELECT * FROM (VALUES {values(GOLD.tree_rows())}) t)"
PROTO = f"proto(c, k, dim, value) AS (SELECT c0, k0, d0, v0::DOUBLE FROM (VALUES {values(GOLD.prototype_rows())}) t(c0, k0, d0, v0))"
WEIGHTS = f"weights(m, dim, w) AS (SELECT m0, d0, w0::DOUBLE FROM (VALUES {values(GOLD.weight_rows())}) t(m0, d0, w0))"
_STEPS = "n0 AS (SELECT row_id, c, 0 AS g FROM mat, (SELECT unnest(range(8))::INT AS c))" + "".join(
    f", n{l + 1} AS (SELECT n.row_id, n.c, 2 * n.g + (x.x > t.threshold)::INT AS g FROM n{l} n JOIN tree t ON t.c = n.c AND t.level = {l} AND t.node = n.g JOIN cells x ON x.row_id = n.row_id AND x.dim = t.dim)" for l in range(DEPTH)
)
CODES = f"{CELLS}, {FEATURES}, {TREE}, {_STEPS}, codes AS (SELECT row_id, c, g AS k FROM n{DEPTH})"
LUT = f"{PROTO}, {WEIGHTS}, lut AS (SELECT m, c, k, sum(w * value) AS value FROM proto JOIN weights USING (dim) GROUP BY m, c, k)"
RESID = f"{CODES}, {PROTO}, resid AS (SELECT x.row_id, x.dim, x.x, x.x - p.value AS r, p.c, p.k FROM cells x JOIN codes c USING (row_id) JOIN proto p ON p.c = c.c AND p.k = c.k AND p.dim = x.dim)"
OUTPUTS = f"{CODES}, {LUT}, approx AS (SELECT row_id, m, sum(value) AS y FROM codes JOIN lut USING (c, k) GROUP BY row_id, m), exact AS (SELECT row_id, m, sum(x * w) AS y FROM cells JOIN weights USING (dim) GROUP BY row_id, m), pairs AS (SELECT a.row_id, a.m, a.y AS a, e.y AS d FROM approx a JOIN exact e USING (row_id, m))"
LEARNED = f"{CODES}, dmean AS (SELECT c, k, dim, avg(x) AS value FROM cells JOIN codes USING (row_id) WHERE c = dim // 8 GROUP BY c, k, dim), dweight AS (SELECT label AS m, dim, avg(x) AS w FROM cells JOIN embeddings ON vec_id = row_id GROUP BY label, dim), lut AS (SELECT m, c, k, sum(w * value) AS value FROM dmean JOIN dweight USING (dim) GROUP BY m, c, k)"
