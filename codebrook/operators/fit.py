"""Learning codebooks: split statistics, trees, k-means, ridge refinement, table refits.

What comes to the driver is model-sized: split candidates (codebooks x dims x nodes),
centroid sums (codebooks x codes x dims), the Gram matrix (codes squared).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import bounds
from ..plans.model import Model
from . import kmeans, lists, scan, solve
from .encode import tree_code
from .metrics import bucket_sse, code_gram

#: Largest codebooks x codes whose normal equations are solved on the driver.
LARGEST_GRAM = 4096
#: Bytes of sums that a task of a tree's level holds.
SUMS_BYTES = 256 << 20


def _exact(cells: DataFrame, x: str) -> bool:
    return isinstance(cells.schema[x].dataType, T.IntegralType)


def _terms(cells: DataFrame, x: str) -> tuple[Column, Column]:
    """Values and squares; of integers as wide decimals, so that sums are exact."""
    v = F.col(x).cast("decimal(19,0)") if _exact(cells, x) else F.col(x)
    return v, v * v


def _squared_error(n: Column, s: Column, q: Column, exact: bool) -> Column:
    """q - s^2 / n; of integers rounded down, without any rounding on the way."""
    if not exact:
        return F.greatest(F.lit(0.0), q - s * s / n)
    s, q, n = s.cast("decimal(19,0)"), q.cast("decimal(38,0)"), n.cast("decimal(19,0)")
    rest = (s * s) % n
    return (q - ((s * s - rest) / n).cast("decimal(38,0)") - F.when(rest > 0, F.lit(1)).otherwise(0)).cast("decimal(38,0)")


def cum_sse_head(cells: DataFrame, keys: list[str], order: list[str], x: str = "x") -> DataFrame:
    """Count, sum, sum of squares and squared error of all rows up to each one."""
    rows = scan.parted(cells, keys, order)
    v, v2 = _terms(rows, x)
    rows = scan.sums_before(rows, keys, {"_n": F.lit(1), "_s": v, "_q": v2})
    w = scan.local(keys, order)
    out = rows.withColumns({"n_head": F.col("_n") + F.count("*").over(w), "s_head": F.col("_s") + F.sum(v).over(w), "q_head": F.col("_q") + F.sum(v2).over(w)}).drop("_n", "_s", "_q")
    return out.withColumn("sse_head", _squared_error(F.col("n_head"), F.col("s_head"), F.col("q_head"), _exact(cells, x)))


def cum_sse_tail(heads: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """The same of all rows after each one: the total less the head, without a second sort."""
    v, v2 = _terms(heads, x)
    totals = heads.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(v).alias("_s"), F.sum(v2).alias("_q"))
    n, s, q = F.col("_n") - F.col("n_head"), F.col("_s") - F.col("s_head"), F.col("_q") - F.col("q_head")
    tail = F.when(n > 0, _squared_error(n, s, q, _exact(heads, x))).otherwise(0)
    return scan.joined(heads, totals, keys).withColumn("sse_tail", tail).drop("_n", "_s", "_q")


def split_candidates(heads: DataFrame, keys: list[str], order: list[str], x: str = "x") -> DataFrame:
    """The midpoint between each row's value and the next one's."""
    rows = scan.next_value(scan.parted(heads, keys, order), keys, order, x, "_next")
    return rows.withColumn("threshold", F.coalesce((F.col(x) + F.col("_next")) / 2, F.col(x).cast("double"))).drop("_next")


def rank_split_dims(stats: DataFrame, most: int = 8) -> DataFrame:
    """The dims of each codebook with the largest squared error, all nodes together."""
    sse = stats.groupBy("c", "dim").agg(F.sum("sse").alias("sse"))
    return sse.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("sse"), "dim"))).where(F.col("rank") <= most)


def best_split(candidates: DataFrame, bucket: list[str]) -> DataFrame:
    """Least loss of each bucket and dim, with its threshold; ties go to the lower value and row."""
    loss = F.col("sse_head") + F.col("sse_tail")
    best = candidates.groupBy(*bucket).agg(F.min_by("threshold", F.struct(loss, F.col("x"), F.col("row_id"))).alias("threshold"), F.min(loss).alias("loss"))
    return best


def choose_dim(splits: DataFrame) -> DataFrame:
    """The dim of each codebook with the least loss over all nodes; ties go to the lower dim."""
    total = splits.groupBy("c", "dim").agg(F.sum("loss").alias("loss"))
    return total.groupBy("c").agg(F.min(F.struct("loss", "dim")).alias("b")).select("c", "b.dim", "b.loss")


@dataclass
class _Tree:
    """A tree forest while it grows: of one layer, with a number of codebooks."""

    layer: str | None
    layout: list[tuple[int, int]]
    chosen: list[list[int]]
    thresholds: list[list[float]]
    tries: list[list[int]]
    leaves: dict[tuple[int, int], np.ndarray]

    def nodes(self, x: np.ndarray, c: int) -> np.ndarray:
        """The node of each row in a codebook's tree so far."""
        node = np.zeros(len(x), np.int64)
        for level, dim in enumerate(self.chosen[c]):
            cuts = np.asarray(self.thresholds[c][(1 << level) - 1 : (2 << level) - 1])
            node = 2 * node + (x[:, dim] > cuts[node])
        return node


def _usable(m: DataFrame, dims: int) -> DataFrame:
    """Rows whose features are `dims` numbers."""
    return m.where((F.size("features") == dims) & ~F.exists("features", lambda v: v.isNull() | F.isnan(v)))


def _features(column: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _bin_edges(rows: DataFrame, dims: dict[str | None, int], bins: int) -> dict[str | None, list[np.ndarray]]:
    """Quantiles of every column of every layer; layers with fewer columns have nulls in the others."""
    shares = [i / bins for i in range(1, bins)]
    wide = max(dims.values())
    columns = [F.percentile_approx(F.get("features", F.lit(d)), shares, 10_000).alias(f"d{d}") for d in range(wide)]
    found = {}
    if dims.keys() - {None}:
        found = {r["layer"]: r for r in rows.groupBy("layer").agg(*columns).collect()}
    if None in dims:
        found[None] = rows.agg(*columns).first()
    return {layer: [np.unique(r[f"d{d}"] or [0.0]) for d in range(dims[layer])] for layer, r in found.items() if layer in dims}


def _column_errors(rows: DataFrame, dims: dict[str | None, int]) -> dict[str | None, np.ndarray]:
    """Squared error of every column of every layer: three sums a column from each task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            for layer, wide in dims.items():
                at = np.arange(len(names)) if layer is None else np.flatnonzero(names == layer)
                x = _features(batch.column(1).take(pa.array(at)), wide)
                total = held.setdefault(layer, np.zeros((3, wide)))
                total += np.array([np.full(wide, float(len(x))), x.sum(0), (x * x).sum(0)])
        for layer, total in held.items():
            wide = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([layer] * wide, pa.string()), pa.array(np.arange(wide, dtype=np.int32)), *map(pa.array, total)], ["layer", "dim", "n", "s", "q"])

    parts = rows.mapInArrow(sums, "layer string, dim int, n double, s double, q double")
    out = {layer: np.zeros(wide) for layer, wide in dims.items()}
    for r in parts.groupBy("layer", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        out[r["layer"]][r["dim"]] = max(r["q"] - r["s"] ** 2 / r["n"], 0.0) if r["n"] else 0.0
    return out


def _column_parts(trees: list[_Tree], cells: int) -> Iterator[list[dict[int, list[int]]]]:
    """The columns that each tree's codebooks try, in parts whose sums have at most `cells` values a bin and node."""
    part, held = [{} for _ in trees], 0
    for t, tree in enumerate(trees):
        for c, (a, b) in enumerate(tree.layout):
            for j in tree.tries[c]:
                need = 2 * (b - a) + 2
                if held and held + need > cells:
                    yield part
                    part, held = [{} for _ in trees], 0
                part[t].setdefault(c, []).append(j)
                held += need
    if held:
        yield part


def tree_fit_many(m: DataFrame, dims: int | dict[str, int], configs: dict[object, tuple], depth: int = 4, tried: int = 8, bins: int = 64, sums_bytes: int = SUMS_BYTES, first: int | None = None) -> dict[object, Model]:
    """Binned trees of many layers, widths and numbers of codebooks and codes, all in one job a level.

    `m` has (layer, features). `dims` is the width of all layers, or of each one by name:
    rows of a layer are as long as it is wide, others teach nothing. A config is its layer
    (None: all rows), its codebooks and, if it has other than `depth`, its levels, so 2 to
    that power codes. Each column of a layer is cut at that layer's quantiles once. A level is one
    scan: tasks find each row's node and add up counts, sums and squares by (tree, codebook,
    node, tried column, bin); partial sums are all that is shuffled. From these follow
    the splits, the columns to try at the next level (those of largest squared error), and
    after a tree's last level the prototypes, so rows are never joined with their codes. What
    comes to the driver is model-sized. A level whose sums would take more than `sums_bytes`
    in a task, as the first one of wide sub-vectors, is done in several scans, a part of the
    columns each; its splits are the same.

    The first level tries all columns, whose sums grow with the square of a sub-vector's
    width. With `first` it tries only so many columns of each codebook, those of largest
    squared error as at later levels, found by one more scan of three sums a column.
    """
    spark = m.sparkSession
    if not configs:
        return {}
    layers = {layer for layer, *_ in configs.values()}
    width = {layer: dims if isinstance(dims, int) else dims[layer] for layer in layers}
    size = F.coalesce(*(F.when(F.col("layer") == layer, F.lit(n)) for layer, n in width.items() if layer is not None), F.lit(width.get(None, -1)))
    rows = m.where((F.size("features") == size) & ~F.exists("features", lambda v: v.isNull() | F.isnan(v))).select("layer", "features")
    per_layer = _bin_edges(rows, width, bins)
    errors = _column_errors(rows, width) if first else {}
    trees: dict[object, _Tree] = {}
    levels = {key: config[2] if len(config) > 2 else depth for key, config in configs.items()}
    for key, (layer, codebooks, *_) in configs.items():
        layout = bounds(width[layer], codebooks)
        tries = [list(range(a, b)) for a, b in layout]
        if first:
            tries = [sorted(a + int(d) for d in np.argsort(-errors[layer][a:b], kind="stable")[:first]) for a, b in layout]
        trees[key] = _Tree(layer, layout, [[] for _ in layout], [[] for _ in layout], tries, {})
    for level in range(max(levels.values())):
        names = [key for key in trees if levels[key] > level]
        growing = [trees[key] for key in names]
        best: dict[tuple[int, int], tuple] = {}
        for part in _column_parts(growing, max(1, sums_bytes // (8 * (bins + 1) << level))):
            for r in _scanned(rows, per_layer, growing, part, width, level, bins):
                key, own = (r["t"], r["c"]), (r["loss"], r["j"])
                if key not in best or own < best[key][0]:
                    best[key] = (own, r)
        for t, tree in enumerate(growing):
            for c, (a, b) in enumerate(tree.layout):
                r = best[t, c][1] if (t, c) in best else None
                tree.chosen[c].append(r["j"] if r else a)
                tree.thresholds[c] += [float(v) for v in r["cuts"]] if r else [0.0] * (1 << level)
                sizes = 2 * (b - a) + 1
                kids = np.zeros((2 << level, sizes))
                if r:
                    kids[0::2], kids[1::2] = ([[v or 0.0 for v in x[:sizes]] for x in r[side]] for side in ("left", "right"))
                for node in range(2 << level):
                    tree.leaves[c, node] = kids[node]
                n, q = np.maximum(kids[:, :1], 1), kids[:, 1 + b - a :]
                error = np.maximum(q - kids[:, 1 : 1 + b - a] ** 2 / n, 0).sum(0)
                tree.tries[c] = sorted((a + int(d) for d in np.argsort(-error, kind="stable")[:tried]))
    out = {}
    for key, tree in trees.items():
        proto = {(c, k, a + d): float(tree.leaves[c, k][1 + d] / max(tree.leaves[c, k][0], 1)) for c, (a, b) in enumerate(tree.layout) for k in range(1 << levels[key]) for d in range(b - a)}
        out[key] = Model(tuple(map(tuple, tree.chosen)), tuple(map(tuple, tree.thresholds)), proto)
    return out


def _scanned(rows: DataFrame, per_layer: dict, trees: list[_Tree], part: list[dict[int, list[int]]], width: dict, level: int, bins: int) -> list:
    """Best cuts of a level for the tree's tried columns of one part: rows (t, c, j, loss, cuts, left, right), one scan."""
    state = rows.sparkSession.sparkContext.broadcast((per_layer, trees, part))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges_of, own_trees, tries = state.value
        total: dict[tuple[int, int, int], np.ndarray] = {}
        size = (bins + 1) << level
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            features: dict[str | None, np.ndarray] = {}
            cache: dict[tuple, np.ndarray] = {}
            for t, tree in enumerate(own_trees):
                if tree.layer not in edges_of or not tries[t]:
                    continue
                if tree.layer not in features:
                    at = np.arange(len(names)) if tree.layer is None else np.flatnonzero(names == tree.layer)
                    features[tree.layer] = _features(batch.column(1).take(pa.array(at)), width[tree.layer])
                own = features[tree.layer]
                if not len(own):
                    continue
                for c, js in tries[t].items():
                    a, b = tree.layout[c]
                    node, sub = tree.nodes(own, c), own[:, a:b]
                    values = [np.ones(len(own)), *sub.T, *(sub * sub).T]
                    for j in js:
                        edges = edges_of[tree.layer][j]
                        if (tree.layer, j) not in cache:
                            cache[tree.layer, j] = np.searchsorted(edges, own[:, j], "left")
                        bin_of = cache[tree.layer, j]
                        group = node * (bins + 1) + bin_of
                        cell = total.get((t, c, j))
                        if cell is None:
                            cell = total[t, c, j] = np.zeros((size, len(values) + 1))
                            # a bin's largest value is its edge; only the last one's is looked for
                            cell[:, -1] = np.tile(np.append(edges, np.full(bins + 1 - len(edges), -np.inf)), 1 << level)
                        for v, value in enumerate(values):
                            cell[:, v] += np.bincount(group, value, size)
                        last = np.flatnonzero(bin_of == len(edges))
                        np.maximum.at(cell[:, -1], group[last], own[last, j])
        keys = [(t, c, j, int(g)) for (t, c, j), cell in total.items() for g in np.flatnonzero(cell[:, 0])]
        rows_of = [total[t, c, j][g] for t, c, j, g in keys]
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[:-1].tolist() for r in rows_of], pa.list_(pa.float64())), pa.array([float(r[-1]) for r in rows_of], pa.float64())], ["t", "c", "j", "g", "v", "top"])

    parts = rows.mapInArrow(sums, "t int, c int, j int, g int, v array<double>, top double")
    widest = max(b - a for t, own in enumerate(part) for c in own for a, b in [trees[t].layout[c]])
    summed = parts.groupBy("t", "c", "j", "g").agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(1 + 2 * widest))).alias("v"), F.max("top").alias("top"))
    return summed.groupBy("t", "c", "j").applyInPandas(_best_cuts(bins, 1 << level), "t int, c int, j int, loss double, cuts array<double>, left array<array<double>>, right array<array<double>>").collect()


def _best_cuts(bins: int, nodes: int):
    """For one codebook and tried column: each node's best threshold, all nodes' loss, and what falls to either side."""

    def best(part: pd.DataFrame) -> pd.DataFrame:
        t, c, j = (int(part[k].iloc[0]) for k in ("t", "c", "j"))
        have = [[x for x in v if x is not None and not np.isnan(x)] for v in part["v"]]
        wide = len(have[0])
        d = (wide - 1) // 2
        cuts, left, right, loss = [0.0] * nodes, [[0.0] * wide] * nodes, [[0.0] * wide] * nodes, 0.0
        values, g, top = np.array(have), part["g"].to_numpy(), part["top"].to_numpy()
        order = np.argsort(g)
        values, g, top = values[order], g[order], top[order]
        for node in np.unique(g // (bins + 1)):
            own = np.flatnonzero(g // (bins + 1) == node)
            head = np.cumsum(values[own], 0)
            tail = head[-1] - head
            sse = lambda x: np.maximum(x[:, 1 + d :] - x[:, 1 : 1 + d] ** 2 / np.maximum(x[:, :1], 1), 0).sum(1)
            losses = sse(head) + sse(tail)
            at = int(losses.argmin())
            loss += float(losses[at])
            # a value of the data itself, the largest that goes left
            cuts[int(node)] = float(top[own[at]])
            left[int(node)], right[int(node)] = head[at].tolist(), tail[at].tolist()
        return pd.DataFrame({"t": [t], "c": [c], "j": [j], "loss": [loss], "cuts": [cuts], "left": [left], "right": [right]})

    return best


def tree_fit(m: DataFrame, dims: int, codebooks: int, depth: int = 4, tried: int = 8, bins: int = 64, exact: bool = False) -> Model:
    """Threshold trees of all codebooks, level by level, all codebooks in one job a level.

    Each level tries the `tried` columns of largest squared error (the first one all) and
    takes the one whose splits leave the least. By default thresholds come from `bins`
    quantile bins (`tree_fit_many`); `exact` tries all values, from sorted attribute lists
    (`lists`). Rows without features, or with a null among them,
    teach nothing; without rows all thresholds and prototypes are 0.
    """
    if not exact:
        return tree_fit_many(m.withColumn("layer", F.lit("")), dims, {0: ("", codebooks)}, depth, tried, bins)[0]
    m, layout = _usable(m, dims), bounds(dims, codebooks)
    chosen, thresholds = lists.tree_fit_exact(m, dims, codebooks, depth, tried)
    model = Model(tuple(map(tuple, chosen)), tuple(map(tuple, thresholds)), {})
    codes = F.array(*(tree_code(F.col("features"), d, t) for d, t in zip(model.dims, model.thresholds)))
    return Model(model.dims, model.thresholds, bucket_prototypes(m.withColumn("codes", codes), model, layout))


def bucket_prototypes(m: DataFrame, model: Model, layout: list[tuple[int, int]]) -> dict[tuple[int, int, int], float]:
    """Mean sub-vector of each bucket; 0 where it is empty."""
    coded = m if "codes" in m.columns else m.withColumn("codes", F.array(*(tree_code(F.col("features"), d, t) for d, t in zip(model.dims, model.thresholds))))
    per = F.array(*(F.struct(F.lit(c).alias("c"), F.get("codes", F.lit(c)).alias("k"), F.slice("features", a + 1, b - a).alias("sub"), F.lit(a).alias("a")) for c, (a, b) in enumerate(layout)))
    cells = coded.select(F.explode(per).alias("p")).select("p.c", "p.k", "p.a", F.posexplode("p.sub").alias("j", "x"))
    means = cells.groupBy("c", "k", (F.col("a") + F.col("j")).alias("dim")).agg(F.avg("x").alias("value")).collect()
    out = {(c, k, d): 0.0 for c, (a, b) in enumerate(layout) for k in range(model.codes) for d in range(a, b)}
    return out | {(r["c"], r["k"], r["dim"]): r["value"] for r in means}


def ridge_refine(m: DataFrame, model: Model, dims: int, penalty: float = 1.0, largest: int = LARGEST_GRAM) -> Model:
    """Prototypes plus the ridge solution of residuals on one-hot codes; dense afterwards.

    The Gram matrix and the right-hand side are sums over rows in Spark; only their
    (codebooks x codes)^2 and (codebooks x codes) x dims values come to the driver. Beyond
    `largest` codes the matrix is never made: `solve` finds the solution by products with it.
    """
    size = model.codebooks * model.codes
    with_codes = _usable(m, dims).withColumn("codes", F.array(*(tree_code(F.col("features"), d, t) for d, t in zip(model.dims, model.thresholds))))
    spots = with_codes.select("features", F.transform("codes", lambda k, c: k + c * model.codes).alias("flat"))
    right = np.zeros((size, dims))
    sums = [F.sum(F.get("features", F.lit(d))).alias(f"d{d}") for d in range(dims)]
    for r in spots.select("features", F.explode("flat").alias("i")).groupBy("i").agg(*sums).collect():
        right[r["i"]] = [r[f"d{d}"] for d in range(dims)]
    proto = np.zeros((size, dims))
    for (c, k, d), v in model.prototypes.items():
        proto[c * model.codes + k, d] = v
    if size <= largest:
        gram = _gram(with_codes, size, model.codes)
        solved = proto + np.linalg.solve(gram + penalty * np.eye(size), right - gram @ proto)
    else:
        held = scan.keep(with_codes.select("codes"))
        solved = proto + solve.solve(held, model.codebooks, model.codes, right - solve.gram_product(held, model.codebooks, model.codes, proto), penalty)
    dense = {(i // model.codes, i % model.codes, d): float(solved[i, d]) for i in range(size) for d in range(dims)}
    return Model(model.dims, model.thresholds, dense, model.weights)


def _gram(coded: DataFrame, size: int, codes: int) -> np.ndarray:
    gram = np.zeros((size, size))
    for r in code_gram(coded, codes).collect():
        gram[r["c1"] * codes + r["k1"], r["c2"] * codes + r["k2"]] = r["n"]
    return gram


def with_weights(model: Model, weights: list[list[float]]) -> Model:
    return Model(model.dims, model.thresholds, model.prototypes, tuple(map(tuple, weights)))


def kmeans_many(m: DataFrame, dims: int, codebooks: int, k: int = 16, rounds: int = 10, seeds: tuple[int, ...] | list[int] = (0,), max_points: int = 0, only: list[int] | None = None, start: str = "hash", steps: int = 4) -> dict[int, tuple[list[list[list[float]]], float]]:
    """Lloyd's algorithm for all codebooks and seeds at once: (centroids [c][k][d], inertia) by seed.

    Starts from rows chosen by hash, or (`start="oversampled"`) drawn in a few `steps` by
    their distance from those before, and fits on all rows; with `max_points`, on the `k *
    max_points` rows of least hash by the first seed. Each round is one scan for all seeds.
    `only` limits the work to some codebooks. Fewer rows than codes are taken again as
    starts; rows without features, or with a null among them, teach nothing; without rows
    all centroids are 0.
    """
    layout = bounds(dims, codebooks)
    rows = _usable(m, dims).select("row_id", "features")
    if max_points:
        rows = scan.keep(rows.orderBy(F.xxhash64("row_id", F.lit(seeds[0])), "row_id").limit(k * max_points).repartition(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return kmeans.kmeans_many(rows, layout, k, rounds, list(seeds), list(range(len(layout)) if only is None else only), start, steps)


def kmeans_fit(m: DataFrame, dims: int, codebooks: int, k: int = 16, rounds: int = 10, seed: int = 0, restarts: int = 1, **options) -> tuple[list[list[list[float]]], float]:
    """`kmeans_many` of one seed and those after it, as many as restarts: what ends with the least inertia."""
    found = kmeans_many(m, dims, codebooks, k, rounds, [seed + i for i in range(restarts)], **options)
    return min(found.items(), key=lambda x: (x[1][1], x[0]))[1]


def kmeans_bounded(m: DataFrame, dims: int, codebooks: int, k: int = 16, rounds: int = 10, seed: int = 0) -> tuple[list[list[list[float]]], float, list[tuple[int, int, int]]]:
    """`kmeans_fit` with distance bounds that rows carry between rounds, and (round, rows, distances taken): for many codes."""
    rows = _usable(m, dims).select(F.col("row_id").cast("long").alias("row_id"), "features")
    return kmeans.kmeans_bounded(rows, bounds(dims, codebooks), k, rounds, seed)


def refit_codebook(m: DataFrame, centroids: list, codebook: int, dims: int, **options) -> list:
    """One codebook learned anew, the others as they are."""
    fresh, _ = kmeans_fit(m, dims, len(centroids), len(centroids[0]), only=[codebook], **options)
    return [fresh[c] if c == codebook else own for c, own in enumerate(centroids)]


def centroid_model(m: DataFrame, dims: int, centroids: list) -> list[tuple]:
    """Rows (c, k, dim, value) of block-local centroids with global dims."""
    layout = bounds(dims, len(centroids))
    return [(c, j, a + d, float(v)) for c, (a, _) in enumerate(layout) for j, row in enumerate(centroids[c]) for d, v in enumerate(row)]


def lut_refit(coded: DataFrame, outputs: DataFrame, codebooks: int, codes: int, penalty: float = 1e-6, largest: int = LARGEST_GRAM, **options) -> list[list[float]]:
    """Tables [m][c * codes + k] that fit exact outputs best for fixed codes (normal equations).

    Beyond `largest` codes they are solved without their matrix (`solve`, with its options).
    """
    size = codebooks * codes
    flat = coded.select("row_id", F.transform("codes", lambda k, c: k + c * codes).alias("flat"))
    sums = flat.join(outputs, "row_id").select("m", "y", F.explode("flat").alias("i")).groupBy("m", "i").agg(F.sum("y").alias("s")).collect()
    right = np.zeros((size, 1 + max((r["m"] for r in sums), default=-1)))
    for r in sums:
        right[r["i"], r["m"]] = r["s"]
    if size > largest:
        return solve.solve(coded, codebooks, codes, right, penalty, **options).T.tolist()
    gram = _gram(coded, size, codes)
    return np.linalg.solve(gram + penalty * np.eye(size), right).T.tolist()
