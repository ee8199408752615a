"""Boosted trees over binned features: rows stay in Spark, the driver sees one histogram for each level of a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]
# Gradients are added as whole numbers of this part of one, so that sums do not depend on how rows are dealt.
UNIT = 2**24
# Up to so many different rows a table's counts are themselves the histogram, and no job for each level is worth its start.
FEW_ROWS = 20_000


class BoostedTrees:
    """Logistic gradient boosting over binned features; ``predict`` works on arrays and travels to the tasks."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[Tree] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def _grid(self) -> np.ndarray:
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = self._grid()
        # half of the cuts are quantiles of the distinct values, or a rare value would share a bin with the usual one
        columns = [x[:, i] for i in range(x.shape[1])]
        self.cuts = [np.unique([*np.quantile(c, grid[::2]), *np.quantile(np.unique(c), grid[1::2])]) for c in columns]
        binned = self._binned(x)
        ones = np.ones(len(y))
        return self._boost(y.mean(), lambda tree, level: self._sums(binned, y, ones, tree, level))

    def fit_cuts(self, rows: DataFrame, width: int) -> BoostedTrees:
        """Cuts as in ``fit`` from a table of ``row`` (an array whose first ``width`` numbers are the features) and ``n``,
        how many rows it stands for. Each feature's values are counted first."""
        grid = self._grid()
        values = rows.select(F.posexplode(F.slice("row", 1, width)).alias("i", "v"), "n").groupBy("i", "v").agg(F.sum("n").alias("n"))
        usual = F.percentile("v", [float(q) for q in grid[::2]], F.col("n"))
        distinct = F.percentile("v", [float(q) for q in grid[1::2]])
        found = values.groupBy("i").agg(F.concat(usual, distinct).alias("cuts")).collect()
        self.cuts = [np.unique(r["cuts"]) for r in sorted(found, key=lambda r: r["i"])]
        return self

    def packed(self, x: np.ndarray) -> list[bytes]:
        """The bins of each row, one byte a feature."""
        return [row.tobytes() for row in self._binned(x).astype(np.uint8)]

    def _unpacked(self, bins: Iterable[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(bins), np.uint8).reshape(-1, len(self.cuts))

    def fit_counted(self, counted: DataFrame) -> BoostedTrees:
        """Trees from all rows of a table of ``bins`` (see ``packed``), ``y`` and ``n``, how many rows are alike.

        A table of more than FEW_ROWS stays in Spark: one job for each level of a tree, one histogram from each core.
        """
        counted = counted.select("bins", F.col("y").cast("double"), F.col("n").cast("double"))
        true, total, rows = counted.agg(F.sum(F.col("y") * F.col("n")), F.sum("n"), F.count("*")).first()
        if rows <= FEW_ROWS:
            bins, y, n = zip(*counted.collect(), strict=True)
            binned, y, n = self._unpacked(bins), np.array(y), np.array(n)
            return self._boost(true / total, lambda tree, level: self._sums(binned, y, n, tree, level))
        shared = counted.coalesce(counted.sparkSession.sparkContext.defaultParallelism)
        return self._boost(true / total, lambda tree, level: self._table_sums(shared, tree, level))

    def _boost(self, rate: float, sums: Callable[[Tree, int], np.ndarray]) -> BoostedTrees:
        rate = np.clip(rate, 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        for _ in range(self.rounds):
            self.trees.append(self._grow(sums))
        return self

    def _margin(self, binned: np.ndarray) -> np.ndarray:
        margin = np.full(len(binned), self.start)
        for tree in self.trees:
            margin += tree[2][self._nodes(tree, binned, self.depth)]
        return margin

    def _sums(self, binned: np.ndarray, y: np.ndarray, n: np.ndarray, tree: Tree, level: int) -> np.ndarray:
        """Sums of the gradient and the curvature for each node of a level, feature and bin, in units of 1 / UNIT."""
        p = 1 / (1 + np.exp(-self._margin(binned)))
        node = self._nodes(tree, binned, level) - (2**level - 1)
        there = np.flatnonzero(node >= 0)
        weights = [np.rint(w * UNIT)[there] * n[there] for w in (p - y, p * (1 - p))]
        out = np.zeros((2**level, len(self.cuts), self.bins, 2))
        for f in range(len(self.cuts)):
            place = node[there] * self.bins + binned[there, f]
            for i, w in enumerate(weights):
                out[:, f, :, i] = np.bincount(place, w, 2**level * self.bins).reshape(2**level, self.bins)
        return out

    def _table_sums(self, counted: DataFrame, tree: Tree, level: int) -> np.ndarray:
        shape = (2**level, len(self.cuts), self.bins, 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += self._sums(self._unpacked(batch.column(0).to_pylist()), *(batch.column(i).to_numpy() for i in (1, 2)), tree, level)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = counted.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(bytes(r["sums"])).reshape(shape) for r in found)

    def _grow(self, sums: Callable[[Tree, int], np.ndarray]) -> Tree:
        size = 2 ** (self.depth + 1) - 1
        tree = feature, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
        for level in range(self.depth):
            for i, own in enumerate(sums(tree, level) / UNIT):
                k = 2**level - 1 + i
                g, h = own[0].sum(axis=0)
                value[k] = -self.rate * g / (h + self.ridge)
                left_g, left_h = np.moveaxis(own.cumsum(axis=1)[:, :-1], 2, 0)
                gain = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g**2 / (h + self.ridge)
                gain[(left_h < 0.5) | (h - left_h < 0.5)] = 0
                if gain.max() > 1e-6:
                    feature[k], cut[k] = f, c = np.unravel_index(gain.argmax(), gain.shape)
                    for child, (a, b) in enumerate(((left_g[f, c], left_h[f, c]), (g - left_g[f, c], h - left_h[f, c]))):
                        value[2 * k + 1 + child] = -self.rate * a / (b + self.ridge)
            if (feature[2**level - 1 : 2 ** (level + 1) - 1] < 0).all():
                break
        return tree

    def _nodes(self, tree: Tree, binned: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; rows of a leaf above stay there."""
        feature, cut, _ = tree
        node = np.zeros(len(binned), dtype=int)
        for _ in range(levels):
            split = feature[node] >= 0
            right = binned[np.arange(len(binned)), np.maximum(feature[node], 0)] > cut[node]
            node = np.where(split, 2 * node + 1 + right, node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._margin(self._binned(x)))) if len(x) else np.zeros(0)

    def predict_packed(self, bins: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self._margin(self._unpacked(bins))))
