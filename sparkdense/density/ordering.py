"""Density-reachability orderings (Ankerst et al., 1999), computed group by group, and what is read off them."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdense.density.bands import order_by_bands
from sparkdense.density.grid import Grid, near_points
from sparkdense.density.labels import NOISE, border_clusters, core_components
from sparkdense.density.neighbours import core_distances
from sparkdense.density.partition import KDTree, build_kdtree
from sparkdense.graph.components import connected_components
from sparkdense.operators.sequence import prefix_sum
from sparkdense.session import cut_lineage

# Points, halo included, that one task orders; more are ordered in bands.
MAX_LOCAL_POINTS = 100_000


def order_group(pdf: pd.DataFrame, coords: Sequence[str]) -> pd.DataFrame:
    """Order the points of one group; columns ``order_id`` and ``reach_dist`` are added, NULL where unreached.

    Unprocessed core points start in order of id; a core point offers max(its core distance, distance) to its
    unprocessed neighbours within ``radius``, and the least offer, then the least id, comes next. Points that are
    not core never start and never expand. ``weight`` equal points stand behind one row and take as many places.
    """
    pdf = pdf.sort_values("id", ignore_index=True)
    xy, core = pdf[list(coords)].to_numpy(float), pdf["core_dist"].to_numpy(float)
    weight, radius = pdf["weight"].to_numpy(), float(pdf["radius"].iloc[0])
    n, is_core = len(pdf), ~np.isnan(core)
    width = radius * (1 + 1e-9) if radius > 0 else np.inf  # the margin covers rounding of cell numbers
    cells = np.floor(xy / width).astype(np.int64)
    occupied, owner = np.unique(cells, axis=0, return_inverse=True)
    rows = np.split(np.argsort(owner.ravel(), kind="stable"), np.cumsum(np.bincount(owner.ravel()))[:-1])
    members = dict(zip(map(tuple, occupied.tolist()), rows))
    offsets = list(itertools.product((-1, 0, 1), repeat=len(coords)))
    reach, order, place = np.full(n, np.inf), np.full(n, -1, np.int64), 0
    for start in np.flatnonzero(is_core):
        pending = [(np.inf, start)]
        while pending:
            _, p = heapq.heappop(pending)
            if order[p] >= 0:
                continue
            order[p], place = place, place + weight[p]
            if not is_core[p]:
                continue
            around = [members.get(tuple((cells[p] + o).tolist())) for o in offsets]
            near = np.concatenate([found for found in around if found is not None])
            near = near[order[near] < 0]
            delta = xy[near] - xy[p]
            dist = np.sqrt((delta * delta).sum(axis=1))
            offer = np.maximum(dist, core[p])
            better = (dist <= radius) & (offer < reach[near])
            reach[near[better]] = offer[better]
            for q, r in zip(near[better], offer[better]):
                heapq.heappush(pending, (r, q))
    pdf["order_id"] = pd.arrays.IntegerArray(order, order < 0)
    pdf["reach_dist"] = np.where(np.isfinite(reach), reach, np.nan)
    return pdf


def order_groups(df: DataFrame, group: str, coords: Sequence[str]) -> DataFrame:
    """Run ``order_group`` on each group; needs ``id``, ``core_dist``, ``radius`` and ``weight``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = tuple(coords)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return order_group(pdf, names)

    ordered = df.groupBy(group).applyInPandas(run, f"{schema}, order_id bigint, reach_dist double")
    nan_to_null = {c: F.when(~F.isnan(c), F.col(c)) for c in ("core_dist", "reach_dist")}
    return ordered.withColumns(nan_to_null)


def gather_piles(cores: DataFrame, coords: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Replace points with core distance 0, which share their place with enough others, by their least id.

    Returns the remaining points with a ``weight`` and the table (id, pile_id) of those that were replaced. Once the
    first point of a pile is ordered, all others follow at reach 0, so nothing is lost and a pile is never one task.
    """
    piled = cores.where("core_dist = 0")
    first = piled.groupBy(*coords).agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    single = cores.where("core_dist is null or core_dist > 0").withColumn("weight", F.lit(1).cast("bigint"))
    kept = single.unionByName(first.withColumn("core_dist", F.lit(0.0)).select(*single.columns))
    members = piled.select("id", *coords).join(first.select(*coords, F.col("id").alias("pile_id")), list(coords))
    return kept, members.where("id <> pile_id").select("id", "pile_id")


def spread_piles(ordered: DataFrame, members: DataFrame) -> DataFrame:
    """Give the replaced points the order of their pile, at reach 0; (order_id, id) is the full order."""
    columns = [c for c in ordered.columns if c not in ("id", "reach_dist")]
    copies = ordered.withColumnRenamed("id", "pile_id").join(members, "pile_id")
    copies = copies.select("id", *columns, F.lit(0.0).alias("reach_dist"))
    return ordered.unionByName(copies.select(*ordered.columns))


@dataclass(frozen=True)
class DensityOrdering:
    """Result of the partitioned ordering.

    ``copies`` has one row per point and leaf that sees it: ``id``, coordinates, ``core_dist``, ``part_id``,
    ``is_home``, ``radius`` (the width of the halo), ``order_id``, ``reach_dist``.
    """

    copies: DataFrame
    tree: KDTree
    eps: float
    coords: tuple[str, ...]

    def boxes(self, eps: float = 0.0) -> DataFrame:
        """Leaf boxes, grown by ``eps`` on each side."""
        leaves = self.tree.leaf_table(self.copies.sparkSession)
        grow = {"lower": F.transform("lower", lambda v: v - eps), "upper": F.transform("upper", lambda v: v + eps)}
        return leaves.withColumns(grow)

    def local_labels(self, radius: float) -> DataFrame:
        """The copies with ``local_cluster``, NULL for noise: clusters read off each leaf's ordering at ``radius``."""
        return extract(self.copies.where("order_id is not null"), radius, ["part_id"]).unionByName(
            self.copies.where("order_id is null").withColumn("local_cluster", F.lit(None).cast("bigint"))
        )

    def labels(self, radius: float | None = None) -> DataFrame:
        """The best copy of each point with its global ``cluster_id`` (-1 for noise) at ``radius``.

        Two local clusters are one when they share a core point: the home leaf of a core point sees every
        neighbour, so no link is missed. Any other point joins the cluster of the core point that reaches it at the
        least (reach, id) at this radius, measured anew: a reach recorded at a larger radius is that of another core
        point.
        """
        radius = self.eps if radius is None else radius
        if radius > self.eps:
            raise ValueError(f"nothing was measured beyond eps={self.eps}")
        labelled = self._with_borders(self._merged(radius), radius)
        is_core = F.coalesce(F.col("core_dist") <= radius, F.lit(False))
        return labelled.withColumn("is_core", is_core).select(
            "id", *self.coords, "part_id", "order_id", "reach_dist", "core_dist", "is_core", "cluster_id"
        )

    def _with_borders(self, merged: DataFrame, radius: float) -> DataFrame:
        """Keep the clusters of core points; points that are not core at ``radius`` take theirs from their cores."""
        grid = Grid(tuple(self.coords), float(radius))
        merged = cut_lineage(merged)
        is_core = F.col("core_dist") <= radius
        core = merged.where(is_core).select("id", *self.coords, "core_dist", "cluster_id")
        others = merged.where(~F.coalesce(is_core, F.lit(False)))
        border = border_clusters(grid, others, core, cut_lineage(grid.cells(core, 0))).select("id", F.col("cluster_id").alias("own"))
        assigned = others.join(border, "id", "left").withColumn("cluster_id", F.coalesce("own", F.lit(NOISE)).cast("bigint"))
        return merged.where(is_core).unionByName(assigned.drop("own"))

    def _merged(self, radius: float) -> DataFrame:
        local = cut_lineage(self.local_labels(radius))
        core = local.where((F.col("core_dist") <= radius) & F.col("local_cluster").isNotNull())
        # Leaf and local cluster packed into one number; the cluster's final name is its least core id.
        names = core.groupBy("part_id", "local_cluster").agg(F.min("id").alias("least"))
        names = names.withColumn("label", F.col("part_id") + F.col("local_cluster") * (2**20))
        home = core.where("is_home").select("id", _label().alias("src"))
        shared = core.where("not is_home").select("id", _label().alias("dst")).join(home, "id")
        merged = connected_components(shared.select("src", "dst"), names.select(F.col("label").alias("id")))
        merged = names.join(merged.withColumnRenamed("id", "label"), "label")
        cluster = merged.groupBy("component").agg(F.min("least").alias("cluster_id"))
        mapping = merged.join(cluster, "component").select("part_id", "local_cluster", "cluster_id")
        chosen = best_copies(local).join(mapping, ["part_id", "local_cluster"], "left")
        return chosen.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE)).cast("bigint"))

    def ordered(self, radius: float | None = None) -> DataFrame:
        """``labels`` sorted by cluster, leaf and place, noise last."""
        clustered = F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))
        return self.labels(radius).orderBy(F.asc_nulls_last(clustered), "part_id", F.asc_nulls_last("order_id"), "id")


def _label() -> Column:
    return F.col("part_id") + F.col("local_cluster") * (2**20)


def extract(ordered: DataFrame, radius: float, group: Sequence[str], offset: int = 0) -> DataFrame:
    """Add ``local_cluster``: clusters of an ordering at ``radius``, numbered from ``offset + 1`` in each group.

    A point out of reach starts a cluster when it is core at ``radius`` and is noise (NULL) otherwise; a point
    within reach belongs to the cluster that is open.
    """
    away = F.col("reach_dist").isNull() | (F.col("reach_dist") > radius)
    core = F.coalesce(F.col("core_dist") <= radius, F.lit(False))
    so_far = Window.partitionBy(*group).orderBy("order_id", "id").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(away & core, 1).otherwise(0)).over(so_far) + offset
    return ordered.withColumn("local_cluster", F.when(~away | core, opened))


def best_copies(local: DataFrame) -> DataFrame:
    """One copy per point: in a cluster if any is, then least reach, then the home copy, then the least leaf."""
    rest = [c for c in local.columns if c != "id"]
    rank = F.struct(
        F.col("local_cluster").isNull().alias("noise"),
        F.coalesce("reach_dist", F.lit(float("inf"))).alias("reach"),
        (~F.col("is_home")).alias("away"),
        F.col("part_id").alias("part"),
    )
    return local.groupBy("id").agg(F.min_by(F.struct(*rest), rank).alias("c")).select("id", "c.*")


def partitioned_ordering(
    points: DataFrame,
    min_pts: int,
    eps: float,
    partitions: int | None = 8,
    coords: Sequence[str] = ("x", "y"),
    max_local_points: int = MAX_LOCAL_POINTS,
) -> DensityOrdering:
    """Order the points leaf by leaf of a balanced KD tree, each leaf with a halo of its neighbourhood.

    Core distances are measured globally first, so a leaf sees true values for its halo as well; the halo is always
    ``eps`` wide. ``partitions=None`` takes as many leaves as keep a leaf at an eighth of ``max_local_points``. A leaf
    that holds more than ``max_local_points`` with its halo is ordered in bands instead of in one task.
    """
    coords = tuple(coords)
    cores = cut_lineage(core_distances(points.select("id", *coords), min_pts, eps, coords))
    kept, members = gather_piles(cores, coords)
    kept = cut_lineage(kept)
    tree = build_kdtree(kept, coords, partitions, max_leaf_points=None if partitions else max(1, max_local_points // 8))
    copies = cut_lineage(tree.with_halo(kept, dict.fromkeys(tree.leaves, float(eps))))
    ordered = order_any_size(copies, "part_id", coords, float(eps), max_local_points)
    copies = cut_lineage(spread_piles(ordered, members).drop("weight"))
    return DensityOrdering(copies, tree, float(eps), coords)


def order_any_size(points: DataFrame, group: str, coords: Sequence[str], eps: float, max_points: int) -> DataFrame:
    """The ordering of each group: in one task up to ``max_points`` rows, else in bands of reach, with the same result."""
    sizes = points.groupBy(group).agg(F.count("*").alias("_n"))
    large = cut_lineage(sizes.where(F.col("_n") > max_points).select(group))
    if large.isEmpty():
        return order_groups(points, group, coords)
    small = order_groups(points.join(large, group, "left_anti"), group, coords)
    in_bands = order_by_bands(points.join(large, group, "left_semi"), group, coords, eps, max_points)
    return small.unionByName(in_bands.select(*small.columns))


def exact_ordering(
    points: DataFrame,
    min_pts: int,
    eps: float,
    coords: Sequence[str] = ("x", "y"),
    max_component_points: int = MAX_LOCAL_POINTS,
) -> DataFrame:
    """One ordering of all points: ``id``, coordinates, ``order_id``, ``reach_dist``, ``core_dist``, ``cluster_id``.

    Components of core points within ``eps`` do not influence each other, so each is ordered on its own and they
    follow each other by their least core id, as one run over all points would have it. A border point is ordered
    with the first component that reaches it; its ``cluster_id`` is that of the core point that reaches it at the least
    (reach, id), as in ``density_labels``. Components above ``max_component_points`` are ordered in bands of reach
    instead of in one task, with the same result.
    """
    coords = tuple(coords)
    grid = Grid(coords, float(eps))
    cores = cut_lineage(core_distances(points.select("id", *coords), min_pts, eps, coords))
    core = cores.where("core_dist is not null")
    cells = cut_lineage(grid.cells(core, 0))
    clusters = cut_lineage(core_components(grid, core, cells))
    pairs = near_points(grid, cores.where("core_dist is null"), clusters, cells)
    border = pairs.groupBy(F.col("q_id").alias("id")).agg(F.min("p_cluster_id").alias("cluster_id"))
    clustered = clusters.select("id", "cluster_id").unionByName(border)
    kept, members = gather_piles(cores, coords)
    placed = cut_lineage(kept.join(clustered, "id", "left"))
    inside = placed.where("cluster_id is not null").withColumn("radius", F.lit(float(eps)))
    ordered = cut_lineage(order_any_size(inside, "cluster_id", coords, float(eps), max_component_points))
    lengths = ordered.groupBy("cluster_id").agg(F.sum("weight").alias("w"))
    ends = prefix_sum(lengths, "cluster_id", "w", "end")
    shifted = ordered.join(ends, "cluster_id").withColumn("order_id", F.col("order_id") + F.col("end") - F.col("w"))
    out = ["id", *coords, "order_id", "reach_dist", "core_dist", "cluster_id"]
    noise = placed.where("cluster_id is null").withColumns(
        {"order_id": F.lit(None).cast("bigint"), "reach_dist": F.lit(None).cast("double"), "cluster_id": F.lit(NOISE)}
    )
    placed = shifted.select(*out).unionByName(noise.select(*out))
    nearest = border_clusters(grid, cores.where("core_dist is null"), clusters, cells)
    placed = placed.join(nearest.select("id", F.col("cluster_id").alias("own")), "id", "left")
    placed = placed.withColumn("cluster_id", F.coalesce("own", "cluster_id")).select(*out)
    return spread_piles(placed, members)


def reachability_series(ordered: DataFrame, cap: float) -> DataFrame:
    """The plotted series: smaller of reach and core distance, undefined or larger values shown as ``cap``."""
    height = F.least(F.coalesce(F.least("reach_dist", "core_dist"), F.lit(cap)), F.lit(cap))
    return ordered.where("order_id is not null").select("id", "cluster_id", "order_id", height.alias("height"))
