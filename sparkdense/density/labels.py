"""Exact density clusters by cell connectivity: no ordering, no per-cluster task, no size limit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdense.density.grid import (
    LAST_LEVEL,
    Grid,
    finer_cell_pairs,
    first_cell_pairs,
    leaf_point_pairs,
    near_points,
)
from sparkdense.density.neighbours import core_distances
from sparkdense.graph.components import connected_components
from sparkdense.session import cut_lineage

NOISE = -1


def density_labels(points: DataFrame, min_pts: int, eps: float, coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """(id, core_dist, is_core, cluster_id) of every point.

    A point is core when ``min_pts`` other points lie within ``eps``. Core points within ``eps`` of each other share
    a cluster, named after its least core id. Any other point joins the cluster of the core point that reaches it
    at the least (reach, id), or is noise (-1).
    """
    cores = cut_lineage(core_distances(points.select("id", *coords), min_pts, eps, coords))
    return labels_at(cores, eps, coords)


def labels_at(cores: DataFrame, radius: float, coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """The clusters at ``radius``, from points with core distances measured at that radius or a larger one."""
    grid = Grid(tuple(coords), float(radius))
    cores = cores.select("id", *coords, F.when(F.col("core_dist") <= radius, F.col("core_dist")).alias("core_dist"))
    core = cores.where("core_dist is not null")
    cells = cut_lineage(grid.cells(core, 0))
    clusters = core_components(grid, core, cells)
    border = border_clusters(grid, cores.where("core_dist is null"), clusters, cells)
    assigned = clusters.select("id", "cluster_id").unionByName(border.select("id", "cluster_id"))
    return cores.join(assigned, "id", "left").select(
        "id",
        "core_dist",
        F.col("core_dist").isNotNull().alias("is_core"),
        F.coalesce("cluster_id", F.lit(NOISE)).cast("bigint").alias("cluster_id"),
    )


def core_components(grid: Grid, core: DataFrame, cells: DataFrame) -> DataFrame:
    """The core points with ``cluster_id``: connected components of the level-0 ``cells`` that hold them.

    All core points of a level-0 cell are within eps of each other, so only cells need to be connected. Two cells
    are linked as soon as one pair of points within eps is certain; undecided pairs are cut finer.
    """
    located = core.select("id", *grid.coords)
    pairs = cut_lineage(first_cell_pairs(grid, cells, ordered=True))
    level, links, roots = 0, [], ["a_root", "b_root"]
    while True:
        linked = pairs.where("kind = 'full'").select(*roots).distinct()
        close = pairs.where("kind = 'leaf'")
        if level > 0:
            close = close.join(linked, roots, "left_anti")
        linked = linked.unionByName(leaf_point_pairs(grid, located, close, level).select(*roots).distinct())
        links.append(linked)
        rest = pairs.where("kind = 'split'").drop("kind")
        if level >= LAST_LEVEL or rest.isEmpty():
            break
        links[-1] = linked = cut_lineage(linked)
        rest = rest.join(linked, roots, "left_anti")
        level += 1
        pairs = cut_lineage(finer_cell_pairs(grid, located, rest, level))
    edges = reduce(DataFrame.unionByName, links).toDF("src", "dst")
    components = connected_components(edges, cells.select("id"))  # cells go by the least core id inside
    by_cell = cells.select("cell", "id").join(components, "id").select("cell", F.col("component").alias("cluster_id"))
    return core.withColumn("cell", grid.cell(0)).join(by_cell, "cell").drop("cell")


def border_clusters(grid: Grid, others: DataFrame, core: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, reach_dist, core_id, cluster_id) of the non-core points that a core point reaches.

    A cell with more points than ``min_pts`` holds core points only, so few non-core points share a cell.
    """
    pairs = near_points(grid, others.select("id", *grid.coords), core, cells)
    reach = F.greatest("p_core_dist", "dist")
    best = F.struct(reach.alias("reach_dist"), F.col("p_id").alias("core_id"), F.col("p_cluster_id").alias("cluster_id"))
    return pairs.groupBy(F.col("q_id").alias("id")).agg(F.min(best).alias("b")).select("id", "b.*")
