"""Neighbour counts and core distances for any density of points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdense.density.grid import (
    LAST_LEVEL,
    Grid,
    finer_cell_pairs,
    first_cell_pairs,
    join_on_cell,
    leaf_point_pairs,
    prefixed,
)
from sparkdense.operators.relational import smallest_per_key
from sparkdense.session import cut_lineage

# Grid levels that one pass over the points decides.
LEVELS_PER_PASS = 4


def neighbour_counts(points: DataFrame, eps: float, coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """(id, n_near): the points within ``eps`` of each point, itself included.

    Cells that lie wholly within reach of each other are counted as wholes; undecided pairs of crowded cells are
    cut finer, round by round; only pairs of small cells are compared point by point, each comparison reduced to
    a count before it is shuffled.
    """
    grid = Grid(tuple(coords), float(eps))
    points = points.select("id", *coords)
    cells = cut_lineage(grid.cells(points, 0))
    pairs = cut_lineage(first_cell_pairs(grid, cells, ordered=False))
    level = 0
    parts: list[DataFrame] = []
    while True:
        whole = pairs.where("kind = 'full'").groupBy(F.col("a_cell").alias("cell")).agg(F.sum("b_n").alias("n"))
        parts.append(points.withColumn("cell", grid.cell(level)).join(whole, "cell").select("id", "n"))
        single = leaf_point_pairs(grid, points, pairs.where("kind = 'leaf'"), level)
        parts.append(single.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n")))
        rest = pairs.where("kind = 'split'").drop("kind")
        if level >= LAST_LEVEL or rest.isEmpty():
            break
        level += 1
        pairs = cut_lineage(finer_cell_pairs(grid, points, rest, level))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("n").alias("n_near"))


def core_distances(
    points: DataFrame, min_pts: int, eps: float, coords: Sequence[str] = ("x", "y")
) -> DataFrame:
    """The points with ``core_dist``: the distance to the ``min_pts``-th nearest other point, NULL beyond ``eps``.

    Each point is searched at the first grid level where its cell holds at most ``min_pts`` points. The cell above
    holds more, so the answer lies within that cell's diagonal, and the search is a fixed number of cells wide.
    As such cells hold few searching points, the pairs are linear in the number of points; the nearest ones are
    selected in each task before the shuffle and again after it.
    """
    if min_pts < 1:
        raise ValueError("min_pts must be at least 1")
    grid = Grid(tuple(coords), float(eps))
    everything = pending = points.select("id", *coords)
    found: list[DataFrame] = []
    first = 0
    while True:
        cells = cut_lineage(_cell_levels(grid, pending, first, min_pts))
        located = pending.withColumn("cell", grid.cell(first + LEVELS_PER_PASS - 1))
        placed = cut_lineage(located.join(cells.select("cell", "level", "same_place"), "cell").drop("cell"))
        found.append(placed.where("same_place").select("id", F.lit(0.0).alias("core_dist")))
        sizes = _level_sizes(cells, first)
        found.append(_nearest(grid, placed.where("level is not null"), everything, sizes, first, min_pts))
        pending = placed.where("level is null and not same_place").select("id", *coords)
        first += LEVELS_PER_PASS
        if pending.isEmpty():
            break
        if first > LAST_LEVEL:  # closer than cell numbers can tell: search the last level
            rest = pending.withColumn("level", F.lit(first - 1))
            found.append(_nearest(grid, rest, everything, sizes, first - LEVELS_PER_PASS, min_pts))
            break
    cores = reduce(DataFrame.unionByName, found)
    return points.join(cores, "id", "left")


def _cell_levels(grid: Grid, pending: DataFrame, first: int, min_pts: int) -> DataFrame:
    """The cells of the pass's last level with the counts ``_n`` of the cells above them and two decisions.

    ``level`` is the first level whose cell holds at most ``min_pts`` points, NULL while all are fuller;
    ``same_place`` marks piles of more than ``min_pts`` equal points.
    """
    last = first + LEVELS_PER_PASS - 1
    names = [f"_c{i}" for i in range(LEVELS_PER_PASS)]
    fine = grid.cells(pending, last).withColumns(
        {name: grid.parent(F.col("cell"), LEVELS_PER_PASS - 1 - i) for i, name in enumerate(names)}
    )
    # A cell has at most 2^(k * (LEVELS_PER_PASS - 1)) cells of the last level: these windows are small.
    fine = fine.withColumns(
        {f"_n{i}": F.sum("n").over(Window.partitionBy(*names[: i + 1])) for i in range(LEVELS_PER_PASS)}
    )
    level = F.lit(None).cast("int")
    for i in reversed(range(LEVELS_PER_PASS)):
        level = F.when(F.col(f"_n{i}") <= min_pts, first + i).otherwise(level)
    same = F.expr(" AND ".join(f"lo{i} = hi{i}" for i in range(len(grid.coords))))
    return fine.withColumns({"level": level, "same_place": same & (F.col("n") > min_pts)})


def _level_sizes(cells: DataFrame, first: int) -> DataFrame:
    """(level, cell, n) of all cells of the pass. Points that earlier passes settled lie in cells too small to matter."""
    stacked = F.array(
        *[
            F.struct(F.lit(first + i).alias("level"), F.col(f"_c{i}").alias("cell"), F.col(f"_n{i}").alias("n"))
            for i in range(LEVELS_PER_PASS)
        ]
    )
    return cells.select(F.explode(stacked).alias("s")).select("s.*").distinct()


def _nearest(
    grid: Grid, searching: DataFrame, points: DataFrame, sizes: DataFrame, first: int, min_pts: int
) -> DataFrame:
    """(id, core_dist) of the searching points that have enough others within their search radius.

    The radius is eps at level 0 and the width limit of the cell above at finer levels.
    """
    widths = grid.eps / grid.side
    radius = F.when(F.col("level") == 0, F.lit(grid.eps)).otherwise(F.lit(2 * grid.eps) / F.pow(F.lit(2.0), "level"))
    offsets = grid.offsets(2 * widths)
    if first == 0:
        offsets = F.when(F.col("level") == 0, grid.offsets(widths)).otherwise(offsets)
    named = [F.col(c).alias("q_" + c) for c in ("id", *grid.coords)]
    left = searching.select(*named, "level", radius.alias("radius"), F.explode(offsets).alias("_offset"))
    left = left.withColumn("_home", grid.cell(F.col("level"), ["q_" + c for c in grid.coords]))
    left = left.withColumn("cell", grid.shifted("_home")).drop("_home", "_offset")
    levels = F.sequence(F.lit(first), F.lit(first + LEVELS_PER_PASS - 1))
    right = prefixed(points, "p_").withColumn("level", F.explode(levels))
    right = right.withColumn("cell", grid.cell(F.col("level"), ["p_" + c for c in grid.coords]))
    pairs = join_on_cell(left, right, ["level", "cell"], sizes).where("q_id <> p_id")
    near = pairs.withColumn("dist", grid.distance("q_", "p_")).where("dist <= radius").select("q_id", "dist", "p_id")
    nearest = smallest_per_key(near, ["q_id"], ["dist", "p_id"], min_pts)
    return nearest.where(F.col("rank") == min_pts).select(F.col("q_id").alias("id"), F.col("dist").alias("core_dist"))
