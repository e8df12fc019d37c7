"""Error metrics, code usage and fit analytics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan


def bucket_stats(cells: DataFrame, keys=("c", "node", "dim")) -> DataFrame:
    """n, sum and sum of squares of each bucket; partial sums combine before the shuffle.

    Of integers both sums are exact, as decimals: squares soon add up to more than 64 bits hold.
    """
    x = F.col("x").cast("decimal(19,0)") if isinstance(cells.schema["x"].dataType, T.IntegralType) else F.col("x")
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_x2"))


def as_longs(stats: DataFrame, *columns: str) -> DataFrame:
    """Whole decimals of a table of few rows as longs, where a column's values all fit; else they stay decimals."""
    kept = scan.keep(stats)
    fit = kept.agg(*(F.coalesce(F.bool_and(F.col(c).between(-(2**63), 2**63 - 1)), F.lit(True)).alias(c) for c in columns)).first()
    return kept.withColumns({c: F.col(c).cast("bigint" if fit[c] else "decimal(38,0)") for c in columns})


def bucket_sse(stats: DataFrame) -> DataFrame:
    """Squared error around the mean, not below 0."""
    s, q = F.col("sum_x").cast("double"), F.col("sum_x2").cast("double")
    return stats.withColumn("sse", F.greatest(F.lit(0.0), q - s * s / F.col("n")))


def bucket_means(stats: DataFrame, grid: DataFrame, keys=("c", "node", "dim")) -> DataFrame:
    """Mean of each bucket of the grid; 0 where it is empty."""
    return grid.join(stats, list(keys), "left").select(*keys, F.coalesce(F.col("sum_x").cast("double") / F.col("n"), F.lit(0.0)).alias("mean"))


def code_gram(coded: DataFrame, codes: int = 16) -> DataFrame:
    """Co-occurrence counts (c1, k1, c2, k2, n) of codes; pairs are counted inside the tasks.

    Rows without codes, or with a null among them, count nothing.
    """
    wide = codes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for n, column in (p for batch in batches for p in _by_length(batch.column(0))):
            for at in range(0, len(column), 4096):
                part = column.slice(at, 4096)
                spot = np.asarray(pc.list_flatten(part), np.int64).reshape(len(part), n) + np.arange(n) * wide
                pairs, counts = np.unique(spot[:, :, None] * (n * wide) + spot[:, None, :], return_counts=True)
                size = n * wide
                if size * size <= 1 << 22:
                    np.add.at(total.setdefault(size, np.zeros(size * size, np.int64)), pairs.ravel(), counts)
                else:
                    yield _gram_rows(pairs.ravel(), counts, size, wide)
        for size, own in total.items():
            at = np.flatnonzero(own)
            yield _gram_rows(at, own[at], size, wide)

    whole = coded.select("codes").where(F.col("codes").isNotNull() & (F.size("codes") > 0) & ~F.exists("codes", lambda k: k.isNull()))
    counted = whole.mapInArrow(count, "c1 int, k1 int, c2 int, k2 int, n long")
    return counted.groupBy("c1", "k1", "c2", "k2").agg(F.sum("n").alias("n"))


def _by_length(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The arrays of a batch, those of one length together."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield int(n), column.take(pa.array(np.flatnonzero(sizes == n)))


def _gram_rows(pairs: np.ndarray, counts: np.ndarray, size: int, codes: int) -> pa.RecordBatch:
    i, j = np.divmod(pairs, size)
    columns = [*np.divmod(i, codes), *np.divmod(j, codes)]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(counts.astype(np.int64))], ["c1", "k1", "c2", "k2", "n"])


def code_xty(codes: DataFrame, residuals: DataFrame, value: str = "r") -> DataFrame:
    """(c, k, dim, s): sums of residual rows per code."""
    return codes.join(residuals, "row_id").groupBy("c", "k", "dim").agg(F.sum(value).alias("s"))


def fit_report(residuals: DataFrame) -> DataFrame:
    """Mean square of the data, of the residual, their ratio, and the mean."""
    msv, mse = F.avg(F.col("x") * F.col("x")), F.avg(F.col("r") * F.col("r"))
    xhat = F.col("x") - F.col("r")
    return residuals.agg(msv.alias("msv_orig"), mse.alias("mse_error"), (mse / msv).alias("mse_ratio"), F.avg("x").alias("mean_x"), F.avg(xhat * xhat).alias("msv_reconstructed"))


def code_grid(codes: DataFrame, codebooks: int, k: int) -> DataFrame:
    spark = codes.sparkSession
    return spark.range(codebooks * k).select(F.floor(F.col("id") / k).cast("int").alias("c"), (F.col("id") % k).cast("int").alias("k"))


def code_histogram(codes: DataFrame, codebooks: int, k: int) -> DataFrame:
    """Rows per code of each codebook, zeros included."""
    counts = codes.groupBy("c", "k").agg(F.count("*").alias("n"))
    return code_grid(codes, codebooks, k).join(counts, ["c", "k"], "left").select("c", "k", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def code_histogram_all(codes: DataFrame) -> DataFrame:
    """Rows per code over all codebooks, and the share in percent."""
    counts = codes.groupBy("k").agg(F.count("*").alias("n"))
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def error_per_code(codes: DataFrame, residuals_c: DataFrame, codebooks: int, k: int) -> DataFrame:
    """Sum of each sub-vector's mean squared error by code, by count + 1, and its share."""
    sub = residuals_c.groupBy("row_id", "c").agg(F.avg(F.col("r") * F.col("r")).alias("e"))
    sums = codes.join(sub, ["row_id", "c"]).groupBy("c", "k").agg(F.sum("e").alias("err"), F.count("*").alias("n"))
    full = code_grid(codes, codebooks, k).join(sums, ["c", "k"], "left").select("c", "k", F.coalesce("err", F.lit(0.0)).alias("err"), F.coalesce("n", F.lit(0)).alias("n"))
    return full.select("c", "k", "err", (F.col("err") / (F.col("n") + 1)).alias("err_scaled"), (100 * F.col("err") / F.sum("err").over(Window.partitionBy())).alias("err_share"))


def error_per_dim(residuals: DataFrame) -> DataFrame:
    """Mean squared error of each dim, and overall with dim null, in one pass."""
    return residuals.groupingSets([["dim"], []], "dim").agg(F.avg(F.col("r") * F.col("r")).alias("mse"))


def error_pairs(a: DataFrame, d: DataFrame) -> DataFrame:
    """(row_id, m, a, d): approximate beside desired outputs."""
    return a.select("row_id", "m", F.col("y").alias("a")).join(d.select("row_id", "m", F.col("y").alias("d")), ["row_id", "m"])


def error_metrics(pairs: DataFrame, *keys: str | Column) -> DataFrame:
    """mae, mse, mape, and errors scaled by the desired range, in one pass; range 0 gives null.

    Keys are names; aggregates among them are added to the same pass.
    """
    more = [k for k in keys if isinstance(k, Column)]
    keys = [k for k in keys if not isinstance(k, Column)]
    e = F.col("a") - F.col("d")
    span = F.max("d") - F.min("d")
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.abs(e) / (1 + F.abs("d"))).alias("mape"),
        F.when(span != 0, 2 * F.avg(F.abs(e)) / span).alias("scaled_error"), F.when(span != 0, 2 * F.avg(e) / span).alias("scaled_shift"), *more,
    )


METRICS = ("mae", "mse", "mape", "scaled_error", "scaled_shift")


def merge_error_reports(reports: DataFrame, *keys: str, metrics=METRICS) -> DataFrame:
    """Means of reports weighted by their batch size n."""
    return reports.groupBy(*keys).agg(*((F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in metrics), F.sum("n").alias("n"))


def loss_metrics(pairs: DataFrame, delta: float = 1.0) -> DataFrame:
    e = F.abs(F.col("a") - F.col("d"))
    return pairs.agg(F.avg(e * e).alias("mse"), F.avg(e).alias("l1"), F.avg(F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))).alias("huber"))


def relative_sq_error(pairs: DataFrame) -> DataFrame:
    e = F.col("a") - F.col("d")
    return pairs.agg((F.sum(e * e) / F.sum(F.col("d") * F.col("d"))).alias("relative_sq_error"))


def rel_error_histogram(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of the relative error in percent; desired zeros are left out."""
    rel = pairs.where("d <> 0").select((100 * F.abs(F.col("a") - F.col("d")) / F.abs("d")).alias("e"))
    span = rel.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    at = F.least(F.lit(bins - 1), F.when(F.col("hi") > F.col("lo"), F.floor((F.col("e") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).otherwise(0)).cast("int")
    counts = rel.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return counts.select("bin", "n", (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("upper_edge"), (F.col("n") == F.max("n").over(Window.partitionBy())).alias("is_peak"))


def trimmed_range(values: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The values between two exact percentiles, ends included."""
    lo, hi = scan.exact_quantiles(values, column, [low, high])
    return values.where(F.col(column).between(F.lit(lo), F.lit(hi)))


def ranked_scores(outputs: DataFrame) -> DataFrame:
    return outputs.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("y"), "m")))


def topk_scores(outputs: DataFrame, k: int) -> DataFrame:
    """The k largest outputs of each row; ties go to the smaller output."""
    return ranked_scores(outputs).where(F.col("rank") <= k)


def topk_accuracy(outputs: DataFrame, labels: DataFrame, ks=(1, 5)) -> DataFrame:
    """Percent of rows whose label is among the k best outputs."""
    own = ranked_scores(outputs).join(labels, "row_id").where(F.col("m") == F.col("label"))
    total = labels.agg(F.count("*").alias("n"))
    hits = own.agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    return hits.crossJoin(total).select(*((100.0 * F.col(f"h{k}") / F.col("n")).alias(f"top{k}") for k in ks), "n")


def argmax_class(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("row_id").agg(F.max(F.struct("y", (-F.col("m")).alias("_m"))).alias("best")).select("row_id", (-F.col("best._m")).alias("m"))


def assignment_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of equal codes and the number of different ones."""
    both = a.select("row_id", "c", F.col("k").alias("k1")).join(b.select("row_id", "c", F.col("k").alias("k2")), ["row_id", "c"])
    return both.agg(F.avg((F.col("k1") == F.col("k2")).cast("double")).alias("share"), F.count_if(F.col("k1") != F.col("k2")).alias("different"))


def abs_error_ratio(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sum of the second residuals' sizes over that of the first."""
    both = first.select("row_id", "dim", F.col("r").alias("r1")).join(second.select("row_id", "dim", F.col("r").alias("r2")), ["row_id", "dim"])
    return both.agg((F.sum(F.abs("r2")) / F.sum(F.abs("r1"))).alias("ratio"))


def zero_fraction(values: DataFrame, columns: list[str]) -> DataFrame:
    return values.agg(*(F.avg(F.when(F.col(c) == 0, 100.0).otherwise(0.0)).alias(c) for c in columns))


def classes_by_level(codes: DataFrame, edges=(3, 9, 16)) -> DataFrame:
    """Codes of each codebook ranked by frequency and dealt to levels."""
    counts = codes.groupBy("c", "k").agg(F.count("*").alias("n"))
    r = counts.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "k")) - 1)
    level: Column = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        level = F.when(F.col("rank") < edges[i], i).otherwise(level)
    return r.withColumn("level", level)


def average_models(params: DataFrame) -> DataFrame:
    """Element-wise mean of (model, name, idx, value, is_int); integers divide down.

    Every model must have the same (name, idx) keys.
    """
    models = params.agg(F.count_distinct("model").alias("models"))
    means = params.groupBy("name", "idx").agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.count_distinct("model").alias("have"), F.max("is_int").alias("is_int"))
    checked = means.crossJoin(F.broadcast(models)).select("*", F.assert_true(F.col("have") == F.col("models"), F.lit("models differ in their parameters")).alias("_ok"))
    value = F.when(F.col("is_int"), F.floor(F.col("s") / F.col("n")).cast("double")).otherwise(F.col("s") / F.col("n"))
    return checked.where(F.col("_ok").isNull()).select("name", "idx", value.alias("value"))


def channel_moments(values: DataFrame, channel: str, value: str) -> DataFrame:
    return values.groupBy(channel).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
