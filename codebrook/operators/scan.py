"""Running statistics over ordered rows, without one task for all rows of a key.

Rows are dealt by ranges of (keys, order): a part holds consecutive rows, and a key with
very many rows has several parts. What a part needs of the rows before it comes from one
summary row a key and part, so windows only ever run inside a part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import keep

PART = "_part"


def parted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with its part, written once, as later passes must see the same parts. No change if it has them."""
    if PART in df.columns:
        return df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()))


def local(keys: list[str], order: list[str]) -> Window:
    """All rows of a part up to each one."""
    return Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def parts_before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join that also matches null keys."""
    right = small.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in small.columns if c not in on))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return rows.join(right, same, "left").drop(*(f"_on_{c}" for c in on))


def sums_before(rows: DataFrame, keys: list[str], terms: dict[str, Column]) -> DataFrame:
    """Rows with, for each name, the sum of its term over all earlier parts of the key."""
    per = rows.groupBy(*keys, PART).agg(*(F.sum(t).alias(n) for n, t in terms.items()))
    w = parts_before(keys)
    return joined(rows, per.select(*keys, PART, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in terms)), [*keys, PART])


def next_value(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Rows with the value of the next row of the key; null at its last one."""
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    heads = rows.groupBy(*keys, PART).agg(F.min_by(value, F.struct(*order)).alias("_head"))
    heads = heads.select(*keys, PART, F.lead("_head").over(Window.partitionBy(*keys).orderBy(PART)).alias("_head"))
    out = joined(rows.withColumn(name, F.lead(value).over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull()), heads, [*keys, PART])
    return out.withColumn(name, F.when(F.col("_last"), F.col("_head")).otherwise(F.col(name))).drop("_last", "_head")


def last_values(rows: DataFrame, keys: list[str], order: list[str], value: str, window: int, name: str) -> DataFrame:
    """Rows with the array of the last `window` values, in order, nulls among them."""
    back = Window.partitionBy(*keys, PART).orderBy(*(F.desc(o) for o in order))
    tails = rows.select(*keys, PART, *order, value).withColumn("_r", F.row_number().over(back)).where(F.col("_r") < window)
    tails = tails.groupBy(*keys, PART).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_t"))
    near = Window.partitionBy(*keys).orderBy(PART).rowsBetween(-max(window - 1, 1), -1)
    held = F.flatten(F.collect_list(F.transform("_t", lambda t: t["_v"])).over(near))
    every = rows.select(*keys, PART).distinct()
    carried = joined(every, tails, [*keys, PART]).withColumn("_t", F.coalesce("_t", F.array())).select(*keys, PART, held.alias("_before"))
    # in structs, as a list of plain values would lose its nulls
    own = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(local(keys, order).rowsBetween(-(window - 1), 0)), lambda x: x["v"])
    both = F.concat(F.coalesce("_before", F.array()), F.col("_own"))
    return joined(rows.withColumn("_own", own), carried, [*keys, PART]).withColumn(name, F.slice(both, F.greatest(F.size(both) - window + 1, F.lit(1)), window)).drop("_own", "_before")


def recurrence(u: np.ndarray, decay: float) -> np.ndarray:
    """y[t] = decay * y[t - 1] + u[t], in blocks whose powers of the decay stay in range."""
    n = len(u)
    if n == 0 or decay == 0:
        return u.astype(np.float64)
    size = 64 if decay >= 1 else int(min(64, max(1, -200 / np.log10(decay))))
    if n <= size or size == 1:
        y, out = 0.0, np.empty(n)
        for i, x in enumerate(u):
            out[i] = y = decay * y + x
        return out
    rows = np.zeros(-(-n // size) * size)
    rows[:n] = u
    power = decay ** np.arange(size)
    inner = np.cumsum(rows.reshape(-1, size) / power, 1) * power
    before = np.append(0.0, recurrence(inner[:, -1], float(decay**size))[:-1])
    return (inner + before[:, None] * power * decay).ravel()[:n]


def decayed(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, name: str) -> DataFrame:
    """Exponential moving average of all values up to each row, started by the first one.

    A null value leaves the average as it is; before the first value it is null.
    """
    rows = parted(df.select(*keys, *order, F.col(value).cast("double").alias("_v")), keys, order)
    first = rows.where("_v IS NOT NULL").groupBy(*keys).agg(F.min(PART).alias("_first"))
    rows = joined(rows, first, keys)
    schema = T.StructType([*rows.schema.fields, T.StructField("_i", T.LongType()), T.StructField("_y", T.DoubleType())])

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        there = part["_v"].notna().to_numpy()
        u = part["_v"].to_numpy(np.float64)[there] * (1 - decay)
        if len(u) and part[PART].iloc[0] == part["_first"].iloc[0]:
            u[0] = part["_v"].to_numpy(np.float64)[there][0]
        # the average after so many values of the part
        seen = np.cumsum(there)
        return part.assign(_i=seen, _y=np.append(0.0, recurrence(u, decay))[seen])

    def chained(parts: pd.DataFrame) -> pd.DataFrame:
        parts, carry, held = parts.sort_values(PART), 0.0, []
        for n, y in zip(parts["_n"], parts["_end"]):
            held.append(carry)
            carry = carry * decay**n + y
        return parts.assign(_carry=held)[[*keys, PART, "_carry"]]

    # a part is what one task takes anyway, so a group is never larger than that
    own = rows.groupBy(*keys, PART).applyInPandas(inside, schema)
    ends = own.groupBy(*keys, PART).agg(F.max("_i").alias("_n"), F.max_by("_y", "_i").alias("_end"))
    fields = [f for f in rows.schema.fields if f.name in (*keys, PART)]
    carry = ends.groupBy(*keys).applyInPandas(chained, T.StructType([*fields, T.StructField("_carry", T.DoubleType())]))
    begun = (F.col(PART) > F.col("_first")) | ((F.col(PART) == F.col("_first")) & (F.col("_i") > 0))
    average = F.when(begun, F.col("_y") + F.col("_carry") * F.pow(F.lit(float(decay)), F.col("_i")))
    return joined(own, carry, [*keys, PART]).select(*keys, *order, average.alias(name))


def quantiles_by(df: DataFrame, keys: list[str], column: str, shares: list[float], bins: int = 256, most: int = 100_000) -> DataFrame:
    """(keys, share, value): exact interpolated quantiles of every key, all keys and ranks narrowed down together.

    Each rank has an interval that holds it. A step is one scan of the values, whatever the number of
    ranks: values are counted by (key, interval, bin), and each interval shrinks to the bin of
    its rank, until it holds one value or `most` rows; those are put in order by key and
    interval. Nulls and NaN are no values; a key without any has null. Infinite values are
    counted apart; between two different ones, or one and a number, the quantile is what the
    interpolation gives, without a number (NaN) for opposite infinities.
    """
    spark = df.sparkSession
    v = F.col("_v")
    values = df.select(*keys, F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double")).alias("_v"))
    infinity = float("inf")
    finite = v.isNotNull() & (F.abs(v) < infinity)
    stats = keep(values.groupBy(*keys).agg(F.count("_v").alias("_n"), F.count_if(v == -infinity).alias("_low"), F.count_if(finite).alias("_mid"), F.min(F.when(finite, v)).alias("_a"), F.max(F.when(finite, v)).alias("_b")))
    place = F.col("share") * (F.col("_n") - 1)
    asked = stats.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).select("*", F.floor(place).alias("_r0"), F.ceil(place).alias("_r1"), (place - F.floor(place)).alias("_part"))
    ranks = asked.select(*keys, "_n", "_low", "_mid", "_a", "_b", F.explode(F.array("_r0", "_r1")).alias("_rank")).where("_n > 0").distinct()
    rank = F.col("_rank")
    outside = F.when(rank < F.col("_low"), F.lit(-infinity)).when(rank >= F.col("_low") + F.col("_mid"), F.lit(infinity))
    found = ranks.select(*keys, "_rank", outside.alias("_x")).where("_x IS NOT NULL")
    open_ = ranks.where(outside.isNull()).select(*keys, "_rank", "_a", "_b", F.col("_low").alias("_before"), F.col("_mid").alias("_held"))
    closed = open_.where("_a = _b OR _held <= 0")
    wide = keep(open_.where("_a < _b"))
    last = None
    while True:
        # intervals that hold few rows are put in order at the end
        few = wide.where(F.col("_held") <= most)
        last = few if last is None else last.unionByName(few)
        wide = wide.where(F.col("_held") > most)
        n = wide.count()
        if not n:
            break
        spans = wide.select(*keys, "_a", "_b").distinct()
        inside = _meeting(values.where(finite), F.broadcast(spans) if n <= 100_000 else spans, keys)
        share = (v / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        at = F.when(v == F.col("_b"), bins - 1).otherwise(F.when(F.col("_b") / 2 > F.col("_a") / 2, F.least(F.lit(bins - 2), F.floor(share * (bins - 1)))).otherwise(0)).cast("int")
        counts = inside.groupBy(*keys, "_a", "_b", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*keys, "_a", "_b").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_upto", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        step = joined(wide, counts, [*keys, "_a", "_b"]).where((rank >= F.col("_before") + F.col("_upto")) & (rank < F.col("_before") + F.col("_upto") + F.col("_c")))
        step = keep(step.select(*keys, "_rank", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), (F.col("_before") + F.col("_upto")).alias("_before"), F.col("_c").alias("_held")))
        closed = closed.unionByName(step.where("_a = _b"))
        wide = step.where("_a < _b")
    found = found.unionByName(closed.select(*keys, "_rank", F.col("_a").alias("_x")))
    last = keep(last)
    spans = last.select(*keys, "_a", "_b", "_before").distinct()
    rows = _meeting(values.where(finite), F.broadcast(spans) if last.count() <= 100_000 else spans, keys)
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_a", "_b", "_before").orderBy("_v")) - 1 + F.col("_before"))
    ordered = joined(last.select(*keys, "_rank", "_a", "_b"), rows.select(*keys, "_rank", "_a", "_b", F.col("_v").alias("_x")), [*keys, "_rank", "_a", "_b"])
    found = keep(found.unionByName(ordered.select(*keys, "_rank", "_x")))
    low, high = (found.withColumnsRenamed({"_rank": r, "_x": x}) for r, x in (("_r0", "_x0"), ("_r1", "_x1")))
    both = joined(joined(asked.select(*keys, "share", "_r0", "_r1", "_part"), low, [*keys, "_r0"]), high, [*keys, "_r1"])
    between = F.when((F.col("_x0") == F.col("_x1")) | (F.col("_part") == 0), F.col("_x0")).otherwise(F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_part"))
    return both.select(*keys, "share", between.alias("value"))


def _meeting(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with each interval of their key that holds their value; keys may be null."""
    right = spans.select(*(F.col(c).alias(f"_on_{c}") for c in keys), *(c for c in spans.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in keys))
    return rows.join(right, same & F.col("_v").between(F.col("_a"), F.col("_b"))).drop(*(f"_on_{c}" for c in keys))


def exact_quantiles(df: DataFrame, column: str, shares: list[float], bins: int = 256, most: int = 100_000) -> list[float | None]:
    """Interpolated quantiles of a whole column, exact (`quantiles_by` with one key)."""
    found = quantiles_by(df.select(F.lit(0).alias("_k"), column), ["_k"], column, sorted(set(shares)), bins, most)
    by_share = {r["share"]: r["value"] for r in found.collect()}
    return [by_share.get(s) for s in shares]
