"""A product-quantization model: trees, prototypes, weights, and its tables.

The parts are bounded by codebooks x codes x (dims + outputs), never by rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .layout import bounds

TREE = "c int, level int, node int, dim int, threshold double"
PROTOTYPES = "c int, k int, dim int, value double"
WEIGHTS = "m int, dim int, w double"


@dataclass(frozen=True)
class Model:
    """Split dims by (codebook, level), thresholds by (codebook, node), prototypes, weights."""

    dims: tuple[tuple[int, ...], ...]
    thresholds: tuple[tuple[float, ...], ...]
    prototypes: dict[tuple[int, int, int], float]
    weights: tuple[tuple[float, ...], ...] = ()

    @property
    def codebooks(self) -> int:
        return len(self.dims)

    @property
    def depth(self) -> int:
        return len(self.dims[0])

    @property
    def codes(self) -> int:
        return 1 << self.depth

    def tree_rows(self) -> list[tuple]:
        return [(c, l, n, self.dims[c][l], self.thresholds[c][(1 << l) - 1 + n]) for c in range(self.codebooks) for l in range(self.depth) for n in range(1 << l)]

    def prototype_rows(self) -> list[tuple]:
        return [(c, k, d, v) for (c, k, d), v in sorted(self.prototypes.items())]

    def weight_rows(self) -> list[tuple]:
        return [(m, d, w) for m, row in enumerate(self.weights) for d, w in enumerate(row)]

    def tree(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.tree_rows(), TREE)

    def prototype_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.prototype_rows(), PROTOTYPES)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.weight_rows(), WEIGHTS)

    def lut(self) -> list[list[float]]:
        """Per output, the products of all prototypes with its weights, flat by c * codes + k."""
        table = [[0.0] * (self.codebooks * self.codes) for _ in self.weights]
        for (c, k, d), v in self.prototypes.items():
            for m, row in enumerate(self.weights):
                table[m][c * self.codes + k] += row[d] * v
        return table


def by_rule(dims: int = 64, codebooks: int = 8, depth: int = 4, outputs: int = 10) -> Model:
    """A model made by a rule, so that checks need no stored constants; six digits each."""
    layout = bounds(dims, codebooks)
    split = tuple(tuple(a + (3 * l + c) % (b - a) for l in range(depth)) for c, (a, b) in enumerate(layout))
    thr = tuple(tuple(round(0.08 * math.sin(1.7 * (c * 15 + n) + 0.3), 6) for n in range((1 << depth) - 1)) for c in range(codebooks))
    proto = {(c, k, d): round(0.25 * math.cos(0.7 * (c * 16 + k) + 1.3 * d), 6) for c, (a, b) in enumerate(layout) for k in range(1 << depth) for d in range(a, b)}
    weights = tuple(tuple(round(math.sin(0.9 * m + 0.37 * d), 6) for d in range(dims)) for m in range(outputs))
    return Model(split, thr, proto, weights)
