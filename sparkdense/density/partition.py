"""Balanced KD partitioning, halo copies and the join of points with boxes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.session import metadata_table

# Candidate boundaries lie at mean + f * standard deviation.
BOUNDARY_FACTORS = (-0.9, -0.6, -0.3, 0.0, 0.3, 0.6, 0.9)

# Leaves are metadata: their number is a parameter, checked against this limit.
MAX_LEAVES = 16_384


@dataclass(frozen=True)
class Split:
    part_id: int
    axis: int
    bound: float
    right_id: int


@dataclass
class Leaf:
    lower: list[float]
    upper: list[float]
    n: int


@dataclass
class KDTree:
    """Splits by level and the boxes of the leaves. A point left of the bound keeps its part, others move right."""

    coords: tuple[str, ...]
    leaves: dict[int, Leaf]
    levels: list[list[Split]] = field(default_factory=list)

    def leaf_table(self, spark: SparkSession) -> DataFrame:
        """One row per leaf: ``part_id``, ``lower``, ``upper`` and the point count ``n``."""
        parts = sorted(self.leaves)
        columns = {
            "part_id": parts,
            "lower": [self.leaves[p].lower for p in parts],
            "upper": [self.leaves[p].upper for p in parts],
            "n": [self.leaves[p].n for p in parts],
        }
        kinds = {"part_id": "int", "lower": "array<double>", "upper": "array<double>", "n": "bigint"}
        return metadata_table(spark, columns, kinds)

    def assign(self, points: DataFrame) -> DataFrame:
        """Add ``part_id``: one broadcast lookup per level, no shuffle."""
        placed = points.withColumn("part_id", F.lit(0))
        for splits in self.levels:
            moved = F.when(self._value() >= F.col("_bound"), F.col("_right")).otherwise(F.col("part_id"))
            table = F.broadcast(_split_table(points.sparkSession, splits))  # at most MAX_LEAVES rows
            placed = placed.join(table, "part_id", "left").select(*points.columns, moved.alias("part_id"))
        return placed

    def with_halo(self, points: DataFrame, radii: dict[int, float]) -> DataFrame:
        """A copy of each point for every leaf whose box, grown by the leaf's radius, contains it (ends included).

        Adds ``part_id``, ``is_home`` and ``radius``. Copies are made level by level on the way down the tree, so a
        point is only compared with the boxes on its own paths and not with every leaf.
        """
        spark = points.sparkSession
        reach = [dict(radii)]  # greatest radius below each part, from the leaves up to the root
        for splits in reversed(self.levels):
            above = dict(reach[0])
            for s in splits:
                above[s.part_id] = max(reach[0][s.part_id], reach[0][s.right_id])
                above.pop(s.right_id)
            reach.insert(0, above)
        copies = points.withColumns({"part_id": F.lit(0), "is_home": F.lit(True)})
        for splits, below in zip(self.levels, reach[1:]):
            table = F.broadcast(_split_table(spark, splits, below))  # at most MAX_LEAVES rows
            value, bound = self._value(), F.col("_bound")
            stay = F.struct(F.col("part_id").alias("p"), F.col("is_home").alias("h"))
            left = F.struct(F.col("part_id").alias("p"), (F.col("is_home") & (value < bound)).alias("h"))
            right = F.struct(F.col("_right").alias("p"), (F.col("is_home") & (value >= bound)).alias("h"))
            goes_left, goes_right = value <= bound + F.col("_rl"), value >= bound - F.col("_rr")
            targets = (
                F.when(bound.isNull(), F.array(stay))
                .when(goes_left & goes_right, F.array(left, right))
                .when(goes_left, F.array(left))
                .otherwise(F.array(right))
            )
            copies = copies.join(table, "part_id", "left").select(*points.columns, F.explode(targets).alias("_t"))
            copies = copies.select(*points.columns, F.col("_t.p").alias("part_id"), F.col("_t.h").alias("is_home"))
        parts = sorted(radii)
        widths = metadata_table(
            spark, {"part_id": parts, "radius": [radii[p] for p in parts]}, {"part_id": "int", "radius": "double"}
        )
        boxes = self.leaf_table(spark).drop("n").join(widths, "part_id")
        inside = F.lit(True)
        for i, c in enumerate(self.coords):
            inside = inside & (F.col(c) >= F.col("lower")[i] - F.col("radius"))
            inside = inside & (F.col(c) <= F.col("upper")[i] + F.col("radius"))
        return copies.join(F.broadcast(boxes), "part_id").where(inside).drop("lower", "upper")

    def _value(self) -> Column:
        value = F.col(self.coords[-1])
        for axis in reversed(range(len(self.coords) - 1)):
            value = F.when(F.col("_axis") == axis, F.col(self.coords[axis])).otherwise(value)
        return value


def _split_table(spark: SparkSession, splits: list[Split], radii: dict[int, float] | None = None) -> DataFrame:
    columns = {
        "part_id": [s.part_id for s in splits],
        "_axis": [s.axis for s in splits],
        "_bound": [s.bound for s in splits],
        "_right": [s.right_id for s in splits],
    }
    kinds = {"part_id": "int", "_axis": "int", "_bound": "double", "_right": "int"}
    if radii is not None:
        columns |= {"_rl": [radii[s.part_id] for s in splits], "_rr": [radii[s.right_id] for s in splits]}
        kinds |= {"_rl": "double", "_rr": "double"}
    return metadata_table(spark, columns, kinds)


def split_statistics(placed: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Count, means and population variances per part."""
    return placed.groupBy("part_id").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(coords)],
        *[F.var_pop(c).alias(f"var{i}") for i, c in enumerate(coords)],
    )


def balance(value: Column, bounds: Sequence[Column]) -> list[Column]:
    """For each candidate boundary: points left of it minus points right of it."""
    return [F.sum(F.when(value < b, 1).otherwise(-1)).alias(f"b{i}") for i, b in enumerate(bounds)]


def build_kdtree(
    points: DataFrame,
    coords: Sequence[str] = ("x", "y"),
    max_partitions: int | None = None,
    split_method: str = "min_var",
    max_leaf_points: int | None = None,
) -> KDTree:
    """Binary splits, breadth first, until there are ``max_partitions`` leaves (4^k by default).

    ``min_var`` splits a part on its axis of greatest variance, ``rotation`` takes the axes in turn. The boundary is
    the candidate around the mean that balances the two sides best. Parts without spread are not split. With
    ``max_leaf_points`` only fuller parts are split, until none is left. All parts of a level share two aggregate
    jobs; only their statistics, one row per part, come to the driver.
    """
    if split_method not in ("min_var", "rotation"):
        raise ValueError("split_method must be 'min_var' or 'rotation'")
    coords = tuple(coords)
    k = len(coords)
    limit = MAX_LEAVES if max_leaf_points else (max_partitions or 4**k)
    if limit > MAX_LEAVES:
        raise ValueError(f"at most {MAX_LEAVES} partitions")
    cached = points.select(*coords).persist()
    try:
        total = cached.agg(
            F.count("*").alias("n"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(coords)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(coords)],
        ).first()
        root = Leaf([total[f"lo{i}"] for i in range(k)], [total[f"hi{i}"] for i in range(k)], total["n"])
        tree = KDTree(coords, {0: root})
        if total["n"] == 0:
            return tree
        todo, next_label = [0], 1
        while todo and next_label < limit:
            splits = _level_splits(cached, tree, todo, next_label, limit, split_method, max_leaf_points)
            if not splits:
                break
            tree.levels.append(splits)
            next_label += len(splits)
            todo = [part for s in splits for part in (s.part_id, s.right_id)]
        if max_leaf_points and any(leaf.n > max_leaf_points for leaf in tree.leaves.values()) and next_label >= limit:
            raise ValueError(f"more than {MAX_LEAVES} leaves are needed: raise max_leaf_points")
        return tree
    finally:
        cached.unpersist()


def _level_splits(cached, tree, todo, next_label, limit, split_method, max_leaf_points) -> list[Split]:
    k, spark = len(tree.coords), cached.sparkSession
    placed = tree.assign(cached)
    stats = {row["part_id"]: row for row in split_statistics(placed, tree.coords).collect()}  # one row per part
    wanted = []
    for part in todo:
        row = stats.get(part)
        if row is None or row["n"] < 2 or (max_leaf_points and row["n"] <= max_leaf_points):
            continue
        variances = [row[f"var{i}"] for i in range(k)]
        axis = len(tree.levels) % k if split_method == "rotation" else int(np.argmax(variances))
        if variances[axis] <= 0:
            axis = int(np.argmax(variances))
        lower, upper = tree.leaves[part].lower[axis], tree.leaves[part].upper[axis]
        if variances[axis] > 0 and lower < upper:
            deviation = variances[axis] ** 0.5
            wanted.append((part, axis, [row[f"mean{axis}"] + f * deviation for f in BOUNDARY_FACTORS]))
        if next_label + len(wanted) >= limit:
            break
    if not wanted:
        return []
    columns = {name: [w[i] for w in wanted] for i, name in enumerate(("part_id", "_axis", "_bounds"))}
    table = metadata_table(spark, columns, {"part_id": "int", "_axis": "int", "_bounds": "array<double>"})
    candidates = placed.join(F.broadcast(table), "part_id")  # at most MAX_LEAVES rows
    bounds = [F.col("_bounds")[i] for i in range(len(BOUNDARY_FACTORS))]
    counts = candidates.groupBy("part_id").agg(*balance(tree._value(), bounds)).collect()  # one row per part
    by_part = {row["part_id"]: [row[f"b{i}"] for i in range(len(bounds))] for row in counts}
    splits = []
    for part, axis, bounds in wanted:
        n, balances = stats[part]["n"], by_part[part]
        best = int(np.argmin(np.abs(balances)))
        if abs(balances[best]) == n:  # rounding put every point on one side
            continue
        split = Split(part, axis, float(bounds[best]), next_label + len(splits))
        leaf = tree.leaves[part]
        left_n = (n + balances[best]) // 2
        right = Leaf(list(leaf.lower), list(leaf.upper), n - left_n)
        right.lower[axis] = split.bound
        leaf.upper[axis], leaf.n = split.bound, left_n
        tree.leaves[split.right_id] = right
        splits.append(split)
    return splits


def box_range_join(
    points: DataFrame, boxes: DataFrame, coords: Sequence[str], eps: float, max_broadcast: int = 1000
) -> DataFrame:
    """Copy each point to every box (``lower``, ``upper`` arrays) that contains it once grown by ``eps`` on each side.

    A few boxes are broadcast and tested in one pass over the points. More boxes are laid over a grid as wide as
    their average extent, and points meet only the boxes of their own grid cell.
    """
    inside = F.lit(True)
    for i, c in enumerate(coords):
        inside = inside & (F.col(c) >= F.col("lower")[i] - eps) & (F.col(c) <= F.col("upper")[i] + eps)
    if boxes.limit(max_broadcast + 1).count() <= max_broadcast:
        return points.join(F.broadcast(boxes), inside)
    extents = boxes.agg(
        *[F.avg(F.col("upper")[i] - F.col("lower")[i] + 2 * eps).alias(f"w{i}") for i in range(len(coords))]
    ).first()
    keys = [f"_k{i}" for i in range(len(coords))]
    left, right = points, boxes
    for i, c in enumerate(coords):
        width = F.lit(extents[f"w{i}"] or 1.0)
        left = left.withColumn(keys[i], F.floor(F.col(c) / width))
        low = F.floor((F.col("lower")[i] - eps) / width)
        high = F.floor((F.col("upper")[i] + eps) / width)
        right = right.withColumn(keys[i], F.explode(F.sequence(low, high)))
    return left.join(right, keys).where(inside).drop(*keys)
