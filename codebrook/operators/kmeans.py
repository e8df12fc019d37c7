"""k-means of all codebooks and restarts together.

Restarts and codebooks are group keys: a round is one scan for all of them. Tasks find each
row's nearest centroid and add up counts, sums and squares; what is shuffled and comes to
the driver is one row a restart, codebook and code.

Starts are rows of least hash, or are oversampled: in each of a few steps tasks draw rows
with a chance in proportion to their squared distance from what was drawn before, as the
first ones in a race of exponential times, which needs no total first. The candidates of all
steps, weighted by the rows nearest to them, are clustered on the driver: they are
2 x steps x codes a restart and codebook.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import forget
from . import scan

Centroids = list[list[np.ndarray]]  # [restart][codebook], each codes x width
_CELLS = 1 << 22


def nearest(sub: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the first of equals, and its squared distance."""
    code, best = np.empty(len(sub), np.int64), np.empty(len(sub))
    step = max(1, _CELLS // max(centroids.size, 1))
    for at in range(0, len(sub), step):
        d = ((sub[at : at + step, None] - centroids[None]) ** 2).sum(2)
        code[at : at + step] = d.argmin(1)
        best[at : at + step] = d.min(1)
    return code, best


def _features(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(rows: DataFrame, layout: list, dims: int, own: list[int], state: Centroids) -> list:
    """(r, c, k, n, q, s): rows, sum of squares and sums of each code, in one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = _features(batch, dims)
            for r, books in enumerate(shared.value):
                for c in own:
                    sub = x[:, slice(*layout[c])]
                    k, size = nearest(sub, books[c])[0], len(books[c])
                    values = [np.ones(len(sub)), (sub * sub).sum(1), *sub.T]
                    got = np.stack([np.bincount(k, v, size) for v in values], 1)
                    total[r, c] = total[r, c] + got if (r, c) in total else got
        out = [(r, c, k, *v[:2].tolist(), v[2:].tolist()) for (r, c), table in total.items() for k, v in enumerate(table) if v[0]]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*zip(*out)] or [()] * 6, kinds)], ["r", "c", "k", "n", "q", "s"])

    parts = rows.mapInArrow(count, "r int, c int, k int, n double, q double, s array<double>")
    wide = max(b - a for a, b in layout)
    return parts.groupBy("r", "c", "k").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(wide))).alias("s")).collect()


def hashed_starts(rows: DataFrame, layout: list, k: int, seeds: list[int]) -> Centroids:
    """The k rows of least hash by each seed, taken again where there are fewer; empty without rows."""
    out = []
    for seed in seeds:
        first = rows.orderBy(F.xxhash64("row_id", F.lit(seed + 1)), "row_id").limit(k).collect()
        if not first:
            return []
        x = np.array([first[i % len(first)]["features"] for i in range(k)])
        out.append([x[:, a:b].copy() for a, b in layout])
    return out


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1 from 64-bit hashes and a salt."""
    for s in salt:
        h = (h ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def race(h: np.ndarray, weight: np.ndarray, *salt: int) -> np.ndarray:
    """Exponential times with rates `weight`; the least ones are a weighted sample without replacement."""
    with np.errstate(divide="ignore"):
        return -np.log(_uniform(h, *salt)) / weight


def _drawn(rows: DataFrame, layout: list, dims: int, own: list[int], seeds: list[int], state: Centroids, many: int, step: int) -> list:
    """(r, c, sub): the `many` first rows of each restart's and codebook's race."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x, h = _features(batch, dims), batch.column(2).to_numpy().view(np.uint64)
            for r, books in enumerate(shared.value):
                for c in own:
                    sub = x[:, slice(*layout[c])]
                    time = race(h, nearest(sub, books[c])[1], seeds[r], c, step)
                    old = held.get((r, c), (np.zeros(0), sub[:0]))
                    time, sub = np.append(old[0], time), np.concatenate([old[1], sub])
                    first = np.argsort(time, kind="stable")[:many]
                    held[r, c] = time[first], sub[first]
        out = [(r, c, t, s.tolist()) for (r, c), (time, sub) in held.items() for t, s in zip(time.tolist(), sub) if t < np.inf]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*zip(*out)] or [()] * 4, kinds)], ["r", "c", "time", "sub"])

    parts = rows.select("row_id", "features", F.xxhash64("row_id").alias("h")).mapInArrow(draw, "r int, c int, time double, sub array<double>")
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("r", "c").orderBy("time", "sub"))).where(F.col("rank") <= many).orderBy("r", "c", "rank").collect()


def reclustered(points: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k centroids of few weighted points: drawn by weighted distance, then moved to their means."""
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    d = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        share = d * weight
        if share.sum() <= 0:
            # fewer different points than codes: some are taken again
            chosen.append(chosen[len(chosen) % len(set(chosen))])
            continue
        chosen.append(int(np.searchsorted(np.cumsum(share), rng.random() * share.sum(), "right")))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(1))
    centroids = points[chosen].copy()
    for _ in range(rounds):
        code, _ = nearest(points, centroids)
        mass = np.bincount(code, weight, k)
        for j in np.flatnonzero(mass):
            centroids[j] = (points[code == j] * weight[code == j, None]).sum(0) / mass[j]
    return centroids


def oversampled_starts(rows: DataFrame, layout: list, dims: int, own: list[int], k: int, seeds: list[int], steps: int) -> Centroids:
    first = hashed_starts(rows, layout, 1, seeds)
    if not first:
        return []
    for step in range(steps):
        fresh: dict[tuple[int, int], list] = {}
        for row in _drawn(rows, layout, dims, own, seeds, first, 2 * k, step):
            fresh.setdefault((row["r"], row["c"]), []).append(row["sub"])
        for (r, c), more in fresh.items():
            first[r][c] = np.concatenate([first[r][c], np.array(more)])
    weight = {(row["r"], row["c"], row["k"]): row["n"] for row in _sums(rows, layout, dims, own, first)}
    return [[reclustered(first[r][c], np.array([weight.get((r, c, j), 0.0) for j in range(len(first[r][c]))]), k, seed) if c in own else np.repeat(first[r][c][:1], k, 0) for c in range(len(layout))] for r, seed in enumerate(seeds)]


def kmeans_many(rows: DataFrame, layout: list[tuple[int, int]], k: int, rounds: int, seeds: list[int], own: list[int], start: str = "hash", steps: int = 4) -> dict[int, tuple[list, float]]:
    """Centroids [c][k][d] and inertia by seed, fitted on all (row_id, features).

    An empty code takes the centroid of the largest one, moved a little. Without rows all
    centroids are 0.
    """
    dims = layout[-1][1]
    make: dict[str, Callable[[], Centroids]] = {"hash": lambda: hashed_starts(rows, layout, k, seeds), "oversampled": lambda: oversampled_starts(rows, layout, dims, own, k, seeds, steps)}
    state, inertia = make[start](), [0.0] * len(seeds)
    if not state:
        return {seed: ([[[0.0] * (b - a) for _ in range(k)] for a, b in layout], 0.0) for seed in seeds}
    for _ in range(rounds):
        inertia, filled = [0.0] * len(seeds), {}
        for row in sorted(_sums(rows, layout, dims, own, state), key=lambda x: (x["r"], x["c"], x["k"])):
            mean = np.array(row["s"][: np.diff(layout[row["c"]])[0]]) / row["n"]
            inertia[row["r"]] += row["q"] - row["n"] * float(mean @ mean)
            filled.setdefault((row["r"], row["c"]), {})[row["k"]] = (row["n"], mean)
        for (r, c), found in filled.items():
            most = max(found, key=lambda j: (found[j][0], -j))
            state[r][c] = np.array([found[j][1] if j in found else found[most][1] * (1 + 1e-3 * (1 + j)) for j in range(k)])
    return {seed: ([book.tolist() for book in state[r]], inertia[r]) for r, seed in enumerate(seeds)}


def _half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    d = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d.min(1) / 2


def pruned_nearest(sub: np.ndarray, centroids: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New codes, bounds and how many distances each row took.

    `upper` bounds the distance to the row's own centroid, `lower` that to all others; both
    held before the centroids moved by `moved`. A row keeps its code where its upper
    bound is under its lower one, or under half the way to the next centroid; else its own
    distance is taken, and all others only if that does not settle it.
    """
    far = np.sort(moved)[::-1]
    largest = np.where(moved[code] == far[0], far[min(1, len(far) - 1)], far[0]) if (moved == far[0]).sum() == 1 else np.full(len(code), far[0])
    upper, lower = upper + moved[code], lower - largest
    gap = _half_gaps(centroids)
    # a little apart, so that rounding and equal distances are settled by the distances
    settled = lambda at: upper[at] < np.maximum(gap[code[at]], lower[at]) * (1 - 1e-9) - 1e-12
    taken = np.zeros(len(sub), np.int64)
    at = np.flatnonzero(~settled(slice(None)))
    upper[at] = np.sqrt(((sub[at] - centroids[code[at]]) ** 2).sum(1))
    taken[at] = 1
    at = at[~settled(at)]
    code = code.copy()
    code[at], upper[at], lower[at] = two_nearest(sub[at], centroids)
    taken[at] += len(centroids)
    return code, upper, lower, taken


def two_nearest(sub: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest centroid, its distance and that of the next one."""
    code, upper, lower = np.empty(len(sub), np.int64), np.empty(len(sub)), np.full(len(sub), np.inf)
    step = max(1, _CELLS // max(centroids.size, 1))
    for at in range(0, len(sub), step):
        d = ((sub[at : at + step, None] - centroids[None]) ** 2).sum(2)
        code[at : at + step] = d.argmin(1)
        if d.shape[1] > 1:
            d = np.partition(d, 1, axis=1)
            lower[at : at + step] = np.sqrt(d[:, 1])
        upper[at : at + step] = np.sqrt(d[:, 0] if d.shape[1] > 1 else d.min(1))
    return code, upper, lower


_BOUNDED = "row_id long, features array<double>, code array<int>, upper array<double>, lower array<double>, distances long"


def bounded_codes(rows: DataFrame, layout: list[tuple[int, int]], centroids: list[np.ndarray], before: list[np.ndarray] | None = None) -> DataFrame:
    """Rows with their nearest codes, bounds, and the distances taken for them.

    Without `before`, `rows` has (row_id, features) and all distances are taken. Else it is the result for
    the centroids `before`, whose bounds spare most of them where centroids move little.
    """
    dims, size = layout[-1][1], len(layout)
    shared = rows.sparkSession.sparkContext.broadcast((centroids, before))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = shared.value
        for batch in batches:
            x = _features(batch, dims)
            if old is not None:
                code, upper, lower = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False).reshape(-1, size) for i in (2, 3, 4))
            out, taken = [], np.zeros(len(x), np.int64)
            for c, (a, b) in enumerate(layout):
                sub = x[:, a:b]
                if old is None:
                    own, many = two_nearest(sub, now[c]), np.full(len(x), len(now[c]))
                else:
                    moved = np.sqrt(((now[c] - old[c]) ** 2).sum(1))
                    *own, many = pruned_nearest(sub, now[c], code[:, c].astype(np.int64), upper[:, c].copy(), lower[:, c].copy(), moved)
                out.append(own)
                taken += many
            ends = pa.array(np.arange(len(x) + 1) * size, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.stack([o[i] for o in out], 1).ravel(), t)) for i, t in ((0, pa.int32()), (1, pa.float64()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(taken)], [f.split()[0] for f in _BOUNDED.split(", ")])

    return rows.mapInArrow(assign, _BOUNDED)


def kmeans_bounded(rows: DataFrame, layout: list[tuple[int, int]], k: int, rounds: int, seed: int) -> tuple[list, float, list[tuple[int, int, int]]]:
    """One seed's centroids and inertia as `kmeans_many` finds them, and (round, rows, distances taken).

    For many codes a codebook: rows carry their codes and bounds from round to round in
    the shared folder, so a round reads and writes them, and takes few distances.
    """
    start = hashed_starts(rows, layout, k, [seed])
    if not start:
        return [[[0.0] * (b - a) for _ in range(k)] for a, b in layout], 0.0, []
    now, before, state, inertia, report = start[0], None, rows, 0.0, []
    per = F.array(*(F.struct(F.lit(c).alias("c"), F.get("code", F.lit(c)).alias("k"), F.slice("features", a + 1, b - a).alias("s")) for c, (a, b) in enumerate(layout)))
    wide = max(b - a for a, b in layout)
    for step in range(rounds):
        last, state = state, scan.keep(bounded_codes(state, layout, now, before))
        if step:
            forget(last)
        count, taken = state.agg(F.count("*"), F.coalesce(F.sum("distances"), F.lit(0))).first()
        report.append((step, count, taken))
        square = F.aggregate("s", F.lit(0.0), lambda t, v: t + v * v)
        sums = state.select(F.explode(per).alias("p")).select("p.*").groupBy("c", "k").agg(F.count("*").alias("n"), F.sum(square).alias("q"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(wide))).alias("s")).collect()
        before, now, inertia = now, [], 0.0
        for c, (a, b) in enumerate(layout):
            found = {r["k"]: (r["n"], np.array(r["s"][: b - a]) / r["n"]) for r in sums if r["c"] == c}
            inertia += sum(r["q"] - r["n"] * float(found[r["k"]][1] @ found[r["k"]][1]) for r in sorted(sums, key=lambda r: r["k"]) if r["c"] == c)
            most = max(found, key=lambda j: (found[j][0], -j))
            now.append(np.array([found[j][1] if j in found else found[most][1] * (1 + 1e-3 * (1 + j)) for j in range(k)]))
    return [book.tolist() for book in now], inertia, report
