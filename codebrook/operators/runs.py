"""Metric series, trials, registries and small relational helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def smoothed_metric(series: DataFrame, keys: list[str], order: list[str], value: str = "value", window: int = 20, weight: str | None = None) -> DataFrame:
    """Median (lower of two), mean, max and last of a sliding window, and the running mean.

    A null value takes a place in the window, and is passed over by all but `last`.
    """
    rows = scan.parted(series, keys, order)
    n = F.when(F.col(value).isNotNull(), F.col(weight) if weight else F.lit(1))
    rows = scan.sums_before(scan.last_values(rows, keys, order, value, window, "_held"), keys, {"_s": F.col(value) * n, "_n": n})
    w, there = scan.local(keys, order), F.filter("_held", lambda v: v.isNotNull())
    held, zero = F.array_sort(there), F.lit(0).cast("double")
    so_far = lambda before, own: F.coalesce(F.col(before), F.lit(0)) + F.coalesce(F.sum(own).over(w), F.lit(0))
    return rows.select(
        *keys, *order, F.get(held, F.floor((F.size(held) - 1) / 2).cast("int")).alias("median"),
        F.when(F.size(there) > 0, F.aggregate(there, zero, lambda a, x: a + x) / F.size(there)).alias("avg"), F.array_max(there).alias("max"), F.col(value).alias("last"),
        F.try_divide(so_far("_s", F.col(value) * n), so_far("_n", n)).alias("global_avg"),
    )


def ema(series: DataFrame, keys: list[str], order: list[str], value: str = "value", decay: float = 0.9) -> DataFrame:
    """Exponential moving average of all values so far, started by the first one; a null leaves it as it is."""
    return scan.decayed(series, keys, order, value, decay, "ema")


def best_so_far(trials: DataFrame, keys: list[str], order: list[str], value: str, drop: float) -> DataFrame:
    """Trials that are within `drop` of the best before them."""
    rows = scan.parted(trials, keys, order)
    tops = rows.groupBy(*keys, scan.PART).agg(F.max(value).alias("_top"))
    tops = tops.select(*keys, scan.PART, F.max("_top").over(scan.parts_before(keys)).alias("_top"))
    inside = F.max(value).over(scan.local(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    before = scan.joined(rows.withColumn("_in", inside), tops, [*keys, scan.PART]).withColumn("best_before", F.greatest("_in", "_top")).drop("_in", "_top", scan.PART)
    return before.where(F.col("best_before").isNull() | (F.col(value) >= F.col("best_before") - drop))


def progress_gates(series: DataFrame, trial: str, order: str, value: str, gates=((0.25, 0.2), (0.1, 0.8))) -> DataFrame:
    """(trial, steps, prev_max, stopped_at): where a trial's running mean falls too far behind the best earlier trial.

    A gate (share, drop) holds from that share of the trial's steps on. Trials go in order
    of their names; only those after one with a mean over 0 are stopped.
    """
    rows = scan.parted(series, [trial], [order])
    rows = scan.sums_before(rows, [trial], {"_s": F.col(value), "_n": F.lit(1)})
    w = scan.local([trial], [order])
    rows = rows.select(trial, (F.col("_n") + F.count("*").over(w)).alias("step"), ((F.col("_s") + F.sum(value).over(w)) / (F.col("_n") + F.count("*").over(w))).alias("mean"))
    ends = rows.groupBy(trial).agg(F.max("step").alias("steps"), F.max_by("mean", "step").alias("end"))
    # one row a trial
    ends = ends.select(trial, "steps", F.max("end").over(Window.orderBy(trial).rowsBetween(Window.unboundedPreceding, -1)).alias("prev_max"))
    behind = reduce(lambda a, b: a | b, ((F.col("step") > F.col("steps") * share) & (F.col("mean") < F.col("prev_max") - drop) for share, drop in gates))
    stops = scan.joined(rows, ends, [trial]).where((F.col("prev_max") > 0) & behind).groupBy(trial).agg(F.min("step").alias("stopped_at"))
    return scan.joined(ends, stops, [trial])


def best_run_per(runs: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), tie))).where("_r = 1").drop("_r")


def best_trial(trials: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The trial with the best value of each key; ties go to the least `tie`."""
    return trials.groupBy(key).agg(F.max_by(F.struct(F.col(tie), F.col(value)), F.struct(F.col(value), -F.col(tie))).alias("t")).select(key, f"t.{tie}", f"t.{value}")


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have, keys, "left_anti")


def present(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have, keys, "left_semi")


def config_overlay(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Base entries overlaid with new ones; the new side wins."""
    return base.select(key, F.col(value).alias("_b")).join(new.select(key, F.col(value).alias("_n")), key, "full_outer").select(key, F.coalesce("_n", "_b").alias(value))


def union_results(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def split_layers_old_new(layers: DataFrame, index: str) -> DataFrame:
    """is_new marks rows of the newest layer; the newest index is one broadcast row."""
    newest = layers.agg(F.max(index).alias("_newest"))
    return layers.crossJoin(F.broadcast(newest)).withColumn("is_new", F.col(index) == F.col("_newest")).drop("_newest")


def mask_not_in_classes(codes: DataFrame, column: str, classes: list) -> DataFrame:
    return codes.withColumn(column, F.when(F.col(column).isin(classes), F.col(column)).otherwise(F.lit(-1)))


def rows_in_classes(rows: DataFrame, codes: DataFrame, c: int, classes: list) -> DataFrame:
    """The rows whose code of one codebook is among the classes, with that code."""
    own = codes.where((F.col("c") == c) & F.col("k").isin(classes)).select("row_id", "k")
    return rows.join(own, "row_id")


def capture_sample(rows: DataFrame, batch: str, row_id: str, quota: int, order: Column | None = None) -> DataFrame:
    """At most `quota` rows of each batch, those first in a pseudo-random order of the id.

    Ranks are taken within hashed parts of a batch first, so that no task sorts a whole
    batch; only the first `quota` rows of each part go on.
    """
    order = F.xxhash64(row_id) if order is None else order
    part = F.pmod(F.xxhash64(F.col(row_id), F.lit("part")), F.lit(32))
    keyed = rows.withColumn("_o", order).withColumn("_p", part)
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(batch, "_p").orderBy("_o", row_id))).where(F.col("_r") <= quota)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(batch).orderBy("_o", row_id))).where(F.col("_r") <= quota).drop("_o", "_p", "_r")


def hash_split(rows: DataFrame, row_id: str, percent: int) -> DataFrame:
    """is_train by remainder of the id, the same in every run."""
    return rows.withColumn("is_train", F.pmod(F.col(row_id) * 7919, F.lit(100)) < percent)


def row_cap(rows: DataFrame, row_id: str, most: int) -> DataFrame:
    """The `most` rows of least id (a sampling operator: the cap is its feature)."""
    return rows.orderBy(row_id).limit(most)


def parse_layer_name(names: DataFrame, column: str = "layer") -> DataFrame:
    """Row and column names and a kernel tag out of a dotted layer name."""
    parts = F.split(column, r"\.")
    tag = F.when(F.col(column).contains("conv"), "(3x3)").when(F.col(column).contains("downsample"), "(1x1)").otherwise("")
    return names.withColumn("row_name", F.element_at(parts, 1)).withColumn("col_name", F.concat(F.array_join(F.slice(parts, 2, 99), "."), tag))


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in df.columns})


def derive_shape_columns(runs: DataFrame, largest_c: int) -> DataFrame:
    """Fill in the outputs m = l_size / (4 K C) where missing; drop runs over the largest C."""
    return runs.withColumn("m", F.coalesce("m", (F.col("l_size") / (4 * F.col("k") * F.col("c"))).cast("bigint"))).where(F.col("c") <= largest_c)
