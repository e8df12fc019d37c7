"""Normal equations of one-hot codes without their matrix.

The matrix counts how often two codes meet in a row, codes squared values. Conjugate
gradients only ask for its products with a few vectors, one an output, and these are sums
over rows: a row adds up the entries of its codes, and its codes get that sum. An iteration
is one scan of the codes; what tasks add up, shuffle and send to the driver has the size
of the solution, codes x outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

_CELLS = 1 << 22


def _whole(coded: DataFrame, codebooks: int) -> DataFrame:
    return coded.select("codes").where((F.size("codes") == codebooks) & ~F.exists("codes", lambda k: k.isNull()))


def gram_product(coded: DataFrame, codebooks: int, codes: int, v: np.ndarray) -> np.ndarray:
    """The products of the codes' co-occurrence counts with the columns of v (codebooks x codes, outputs)."""
    shared = coded.sparkSession.sparkContext.broadcast(v)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        out, seen = np.zeros_like(v), np.zeros(len(v), bool)
        step = max(1, _CELLS // (codebooks * v.shape[1]))
        for batch in batches:
            flat = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, codebooks) + np.arange(codebooks) * codes
            for at in range(0, len(flat), step):
                part = flat[at : at + step]
                y = v[part].sum(1)
                for own in part.T:
                    order = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
                    spots = own[order[first]]
                    out[spots] += np.add.reduceat(y[order], first, axis=0)
                    seen[spots] = True
        spots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int64()), pa.array(out[spots].tolist(), pa.list_(pa.float64()))], ["i", "y"])

    sums = F.array(*(F.sum(F.get("y", F.lit(j))) for j in range(v.shape[1])))
    out = np.zeros_like(v)
    for r in _whole(coded, codebooks).mapInArrow(add, "i long, y array<double>").groupBy("i").agg(sums.alias("y")).collect():
        out[r["i"]] = r["y"]
    return out


def counts(coded: DataFrame, codebooks: int, codes: int) -> np.ndarray:
    """How many rows each code has: the diagonal of the matrix."""
    out = np.zeros(codebooks * codes)
    spots = _whole(coded, codebooks).select(F.explode(F.transform("codes", lambda k, c: k + c * codes)).alias("i"))
    for r in spots.groupBy("i").agg(F.count("*").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def solve(coded: DataFrame, codebooks: int, codes: int, right: np.ndarray, penalty: float, start: np.ndarray | None = None, tolerance: float = 1e-12, rounds: int = 1000) -> np.ndarray:
    """x with (counts of meetings + penalty) x = right, for every column of `right`.

    Preconditioned with the diagonal; columns have steps of their own and rest once their
    residual is below `tolerance` times their right side. Raises where `rounds` scans aren't
    enough.
    """
    coded = scan.keep(coded.select("codes"))
    diagonal = (counts(coded, codebooks, codes) + penalty)[:, None]
    product = lambda v: gram_product(coded, codebooks, codes, v) + penalty * v
    x = np.zeros_like(right) if start is None else start.copy()
    rest = right - (product(x) if start is not None else 0)
    goal = tolerance * np.maximum(np.linalg.norm(right, axis=0), np.linalg.norm(rest, axis=0))
    z = rest / diagonal
    way, old = z.copy(), (rest * z).sum(0)
    for _ in range(rounds):
        open_ = np.linalg.norm(rest, axis=0) > goal
        if not open_.any():
            return x
        moved = product(way[:, open_])
        step = old[open_] / (way[:, open_] * moved).sum(0)
        x[:, open_] += step * way[:, open_]
        rest[:, open_] -= step * moved
        z = rest / diagonal
        new = (rest * z).sum(0)
        way = np.where(open_, z + np.where(old > 0, new / np.where(old > 0, old, 1), 0) * way, way)
        old = new
    raise RuntimeError(f"no solution after {rounds} rounds")
