"""Grid cells of nested levels, and range joins over them that survive dense spots.

Level-0 cells are a little narrower than ``eps / sqrt(k)``, so any two points of one cell are within ``eps``. Level
l cells have half the width of level l-1 cells and nest in them exactly. Decisions on whole cells use the tight
bounds of the points inside; floating-point subtraction, squaring and square roots are monotone, so such a
decision never differs from the one that a direct distance test would make.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdense.functions.columns import distance
from sparkdense.session import broadcast_if_small, cut_lineage

MAX_AXES = 4
# Side of a level-0 cell as a share of eps / sqrt(k); the margin covers rounding of cell numbers.
SIDE = 0.999
# Cells with more points than this are split instead of compared point by point.
LEAF_POINTS = 32
# From this level on cell numbers would leave 64 bits; remaining pairs are compared point by point.
LAST_LEVEL = 40
# Rows of one cell that go to one join task.
CELL_ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class Grid:
    coords: tuple[str, ...]
    eps: float

    def __post_init__(self) -> None:
        if not 1 <= len(self.coords) <= MAX_AXES:
            raise ValueError(f"the grid takes 1 to {MAX_AXES} coordinates: pass the leading ones or a projection")
        if not self.eps > 0:
            raise ValueError("eps must be positive")

    @property
    def side(self) -> float:
        return SIDE * self.eps / math.sqrt(len(self.coords))

    def cell(self, level: int | Column, coords: Sequence[str] | None = None) -> Column:
        """The cell of a point as a struct of cell numbers."""
        scale = F.lit(2.0**level) if isinstance(level, int) else F.pow(F.lit(2.0), level)
        return F.struct(
            *[
                F.floor(F.col(c) / F.lit(self.side) * scale).cast("bigint").alias(f"g{i}")
                for i, c in enumerate(coords or self.coords)
            ]
        )

    def parent(self, cell: Column, levels: int = 1) -> Column:
        return F.struct(*[F.shiftright(cell[f"g{i}"], levels).alias(f"g{i}") for i in range(len(self.coords))])

    def offsets(self, radius_in_sides: float) -> Column:
        """Offsets of all cells that can hold a point within the radius of a point in cell 0: a constant array."""
        reach = math.ceil(radius_in_sides)
        near = [
            offset
            for offset in itertools.product(range(-reach, reach + 1), repeat=len(self.coords))
            if sum(max(abs(o) - 1, 0) ** 2 for o in offset) <= radius_in_sides**2 * (1 + 1e-9)
        ]
        structs = ", ".join(
            "named_struct(" + ", ".join(f"'g{i}', {o}L" for i, o in enumerate(offset)) + ")" for offset in near
        )
        return F.expr(f"array({structs})")

    def shifted(self, cell: str, offset: str = "_offset") -> Column:
        return F.expr("struct(" + ", ".join(f"{cell}.g{i} + {offset}.g{i} AS g{i}" for i in range(len(self.coords))) + ")")

    def cells(self, points: DataFrame, level: int) -> DataFrame:
        """One row per occupied cell: ``cell``, the count ``n``, the least ``id`` and the bounds of its points."""
        return points.groupBy(self.cell(level).alias("cell")).agg(
            F.count("*").alias("n"),
            F.min("id").alias("id"),
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(self.coords)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(self.coords)],
        )

    def distance(self, left: str, right: str) -> Column:
        """Distance of two points whose coordinates carry the given prefixes."""
        return distance([F.col(left + c) for c in self.coords], [F.col(right + c) for c in self.coords])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def join_on_cell(left: DataFrame, right: DataFrame, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Inner join on cells where single cells of ``right`` may hold a large share of all rows.

    ``sizes`` has the row count ``n`` of the cells of ``right`` (small cells may be missing). Crowded cells are cut
    into slices by a hash of the row, and the matching rows of ``left`` are repeated once per slice.
    """
    slices = F.ceil(F.col("n") / F.lit(CELL_ROWS_PER_TASK)).cast("int")
    crowded = sizes.where(F.col("n") > CELL_ROWS_PER_TASK).select(*keys, slices.alias("_slices"))
    if crowded.isEmpty():
        return left.join(right, list(keys))
    crowded = broadcast_if_small(crowded)
    count = F.coalesce("_slices", F.lit(1))
    row = F.xxhash64(*[c for c in right.columns if c not in keys])
    cut = right.join(crowded, list(keys), "left").withColumn("_slice", F.pmod(row, count).cast("int")).drop("_slices")
    repeated = left.join(crowded, list(keys), "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), count - 1)))
    return repeated.drop("_slices").join(cut, [*keys, "_slice"]).drop("_slice")


def near_points(grid: Grid, queries: DataFrame, points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (query, point) within ``eps``, columns prefixed ``q_`` and ``p_``, plus ``dist``.

    Only for queries that share their cells with at most a fixed number of others: then the pairs stay linear in
    the number of points, however crowded a neighbouring cell is. ``sizes`` holds the level-0 cells of ``points``.
    """
    left = prefixed(queries.withColumn("home", grid.cell(0)), "q_")
    left = left.withColumn("_offset", F.explode(grid.offsets(grid.eps / grid.side)))
    left = left.withColumn("cell", grid.shifted("q_home")).drop("_offset", "q_home")
    right = prefixed(points.withColumn("cell", grid.cell(0)), "p_").withColumnRenamed("p_cell", "cell")
    pairs = join_on_cell(left, right, ["cell"], sizes).drop("cell")
    return pairs.withColumn("dist", grid.distance("q_", "p_")).where(F.col("dist") <= grid.eps)


# --- pairs of cells ---------------------------------------------------------------------------------------


def _bounds(grid: Grid) -> tuple[Column, Column]:
    """Least and largest distance that a point of cell a and one of cell b can have."""
    gaps, spans = [], []
    for i in range(len(grid.coords)):
        after, before = F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")
        gaps.append(F.greatest(after, before, F.lit(0.0)))
        spans.append(F.greatest(F.col(f"a_hi{i}") - F.col(f"b_lo{i}"), F.col(f"b_hi{i}") - F.col(f"a_lo{i}")))
    zero = [F.lit(0.0)] * len(gaps)
    return distance(gaps, zero), distance(spans, zero)


def _classified(grid: Grid, pairs: DataFrame, level: int) -> DataFrame:
    """Add ``kind``: 'full' (all points within eps), 'leaf' (compare points) or 'split'; far pairs are dropped."""
    least, largest = _bounds(grid)
    small = F.lit(level >= LAST_LEVEL) | ((F.col("a_n") <= LEAF_POINTS) & (F.col("b_n") <= LEAF_POINTS))
    kind = F.when(F.col("_largest") <= grid.eps, "full").when(small, "leaf").otherwise("split")
    bounded = pairs.withColumns({"_least": least, "_largest": largest}).where(F.col("_least") <= grid.eps)
    return bounded.withColumn("kind", kind).drop("_least", "_largest")


def first_cell_pairs(grid: Grid, cells: DataFrame, ordered: bool) -> DataFrame:
    """Pairs of neighbouring level-0 cells, classified; ``ordered`` keeps one of (a, b), (b, a) and no (a, a).

    ``a_root`` and ``b_root`` name the level-0 cells by the least id inside; finer pairs inherit them.
    """
    left = prefixed(cells, "a_").withColumn("_offset", F.explode(grid.offsets(grid.eps / grid.side)))
    left = left.withColumn("b_cell", grid.shifted("a_cell")).drop("_offset")
    if ordered:
        left = left.where("a_cell < b_cell")
    pairs = left.join(prefixed(cells, "b_"), "b_cell")
    return _classified(grid, pairs.withColumnsRenamed({"a_id": "a_root", "b_id": "b_root"}), 0)


def finer_cell_pairs(grid: Grid, points: DataFrame, pairs: DataFrame, level: int) -> DataFrame:
    """Replace each pair of level ``level - 1`` cells by the pairs of their level ``level`` cells, classified.

    Only cells of the given pairs are cut; a cell has at most 2^k parts, however many points it holds.
    """
    wanted = pairs.select(F.explode(F.array("a_cell", "b_cell")).alias("_up")).distinct()
    inside = points.withColumn("_up", grid.cell(level - 1)).join(broadcast_if_small(wanted), "_up", "left_semi")
    parts = cut_lineage(grid.cells(inside, level)).withColumn("_up", grid.parent(F.col("cell"))).drop("id")
    coarse = pairs.select(F.col("a_cell").alias("a__up"), F.col("b_cell").alias("b__up"), "a_root", "b_root")
    finer = coarse.join(prefixed(parts, "a_"), "a__up").join(prefixed(parts, "b_"), "b__up")
    return _classified(grid, finer.drop("a__up", "b__up"), level)


def leaf_point_pairs(grid: Grid, points: DataFrame, pairs: DataFrame, level: int) -> DataFrame:
    """Point pairs within ``eps`` of the given cell pairs: ``a_``/``b_`` columns, roots and ``dist``.

    Leaf cells hold at most ``LEAF_POINTS`` points, so the pairs are a fixed multiple of the cell pairs.
    """
    located = points.withColumn("cell", grid.cell(level))
    cells = pairs.select("a_cell", "b_cell", "a_root", "b_root")
    joined = cells.join(prefixed(located, "a_"), "a_cell").join(prefixed(located, "b_"), "b_cell")
    return joined.withColumn("dist", grid.distance("a_", "b_")).where(F.col("dist") <= grid.eps)
