"""Clustering against golden results and quadratic models, crowded cells and equal points included."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdense.density import bands as bands_module
from sparkdense.density import grid as grid_module
from sparkdense.density import ordering as ordering_module
from sparkdense.density.labels import density_labels, labels_at
from sparkdense.density.neighbours import core_distances, neighbour_counts
from sparkdense.density.ordering import (
    best_copies,
    exact_ordering,
    extract,
    partitioned_ordering,
    reachability_series,
)
from sparkdense.density.partition import box_range_join, build_kdtree
from tests import brute

TEN = [(8, 16, 16), (0, 16, 13), (2, 16, 24), (4, 17, 22), (6, 19, 13),
       (1, 49, 47), (3, 49, 60), (5, 51, 46), (7, 42, 61), (9, 46, 64)]


def blobs(seed, n=240, k=2, pile=0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 40, (4, k))
    xy = np.concatenate([centres[i % 4] + rng.normal(0, 1.5, (1, k)) for i in range(n - n // 5)])
    xy = np.concatenate([xy, rng.uniform(0, 40, (n // 5, k))])
    if pile:
        xy = np.concatenate([xy, np.repeat(centres[:1], pile, axis=0)])
        dense = centres[1] + rng.normal(0, 1e-3, (pile, k))
        xy = np.concatenate([xy, dense])
    ids = rng.permutation(len(xy)).tolist()
    return ids, xy


def frame(spark, ids, xy):
    names = ["x", "y", "z"][: xy.shape[1]]
    rows = [(int(i), *map(float, p)) for i, p in zip(ids, xy)]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(4)


def test_golden_ordering(spark):
    ids, xy = [r[0] for r in TEN], np.array([r[1:] for r in TEN], float)
    rows = {r["id"]: r for r in exact_ordering(frame(spark, ids, xy), 4, 8.5).collect()}
    assert [i for i in sorted(rows, key=lambda i: (rows[i]["order_id"] is None, rows[i]["order_id"], i))][:5] == [8, 0, 2, 4, 6]
    assert rows[8]["core_dist"] == 8.0 and rows[8]["reach_dist"] is None
    assert all(rows[i]["reach_dist"] == 8.0 and rows[i]["core_dist"] is None for i in (0, 2, 4, 6))
    assert all(rows[i]["order_id"] is None and rows[i]["cluster_id"] == -1 for i in (1, 3, 5, 7, 9))
    labels = {r["id"]: r["cluster_id"] for r in density_labels(frame(spark, ids, xy), 4, 7.9).collect()}
    assert set(labels.values()) == {-1}


def test_full_queue(spark):
    xy = np.array([[8.0], [6], [5], [12], [10], [9]])
    points = frame(spark, range(6), xy)
    ordered = exact_ordering(points, 2, 3.0, coords=("x",)).orderBy("order_id").collect()
    assert [r["id"] for r in ordered] == [0, 1, 2, 4, 3, 5]
    assert len({r["cluster_id"] for r in ordered}) == 1


def test_few_near_points_are_noise(spark):
    xy = np.array([[0.0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1]])
    labels = density_labels(frame(spark, range(4), xy), 4, 1.0).collect()
    assert {r["cluster_id"] for r in labels} == {-1}


@pytest.mark.parametrize(("seed", "k", "pile"), [(2, 2, 120), (3, 3, 0)])
def test_counts_and_core_distances(spark, seed, k, pile):
    ids, xy = blobs(seed, k=k, pile=pile)
    names = ("x", "y", "z")[:k]
    points, eps, min_pts = frame(spark, ids, xy), 2.0, 4
    near = (brute.distances(xy) <= eps).sum(axis=1)
    found = {r["id"]: r["n_near"] for r in neighbour_counts(points, eps, names).collect()}
    assert found == {i: int(n) for i, n in zip(ids, near)}
    expected = brute.core_distances(xy, min_pts, eps)
    cores = {r["id"]: r["core_dist"] for r in core_distances(points, min_pts, eps, names).collect()}
    assert cores == {i: None if math.isnan(c) else c for i, c in zip(ids, expected)}


@pytest.mark.parametrize(("seed", "k", "pile"), [(6, 2, 150), (7, 3, 0)])
def test_labels(spark, seed, k, pile):
    ids, xy = blobs(seed, k=k, pile=pile)
    names, eps, min_pts = ("x", "y", "z")[:k], 2.0, 4
    points = frame(spark, ids, xy)
    cores = core_distances(points, min_pts, eps, names)
    for radius in (eps, 0.6 * eps):
        found = {r["id"]: r["cluster_id"] for r in labels_at(cores, radius, names).collect()}
        assert found == brute.labels(ids, xy, min_pts, eps, radius)


def test_crowded_cells_are_sliced_and_split(spark, monkeypatch):
    monkeypatch.setattr(grid_module, "CELL_ROWS_PER_TASK", 10)
    monkeypatch.setattr(grid_module, "LEAF_POINTS", 2)
    ids, xy = blobs(8, pile=100)
    points = frame(spark, ids, xy)
    found = {r["id"]: r["cluster_id"] for r in density_labels(points, 4, 2.0).collect()}
    assert found == brute.labels(ids, xy, 4, 2.0)
    near = {r["id"]: r["n_near"] for r in neighbour_counts(points, 2.0).collect()}
    assert near == {i: int(n) for i, n in zip(ids, (brute.distances(xy) <= 2.0).sum(axis=1))}


def test_two_crowded_cells_just_apart(spark, monkeypatch):
    monkeypatch.setattr(grid_module, "LEAF_POINTS", 4)
    y = np.linspace(0, 0.5, 40)
    left, right = np.stack([np.zeros(40), y], 1), np.stack([np.full(40, 1.0 + 1e-9), y], 1)
    xy = np.concatenate([left, right])
    points = frame(spark, range(80), xy)
    assert {r["cluster_id"] for r in density_labels(points, 3, 1.0).collect()} == {0, 40}
    assert {r["cluster_id"] for r in density_labels(points, 3, 1.0 + 2e-9).collect()} == {0}


def test_exact_ordering(spark):
    ids, xy = blobs(9)
    ordered = exact_ordering(frame(spark, ids, xy), 4, 2.0).where("order_id is not null").orderBy("order_id", "id")
    assert [(r["id"], r["reach_dist"]) for r in ordered.collect()] == brute.ordering(ids, xy, 4, 2.0)


def test_exact_ordering_with_piles(spark):
    ids, xy = blobs(10, pile=60)
    rows = exact_ordering(frame(spark, ids, xy), 4, 2.0).where("order_id is not null").collect()
    expected = brute.ordering(ids, xy, 4, 2.0)
    assert sorted(r["id"] for r in rows) == sorted(i for i, _ in expected)
    reach = [sorted(-1 if v is None else v for v in vs) for vs in ((r["reach_dist"] for r in rows), (v for _, v in expected))]
    assert reach[0] == reach[1]


@pytest.mark.parametrize("limit", [30, 100, 100_000])
@pytest.mark.parametrize("ties", [False, True])
def test_the_size_limit_changes_nothing(spark, monkeypatch, limit, ties):
    monkeypatch.setattr(bands_module, "LINKS_PER_POINT", 4)
    ids, xy = blobs(11, n=200)
    xy = np.round(xy * 2) / 2 + np.arange(len(xy))[:, None] % 3 * 0.125 if ties else xy
    ordered = exact_ordering(frame(spark, ids, xy), 4, 3.0, max_component_points=limit)
    found = [(r["id"], r["reach_dist"]) for r in ordered.where("order_id is not null").orderBy("order_id", "id").collect()]
    assert found == brute.ordering(ids, xy, 4, 3.0)
    assert ordered.count() == len(ids)


def test_bands_give_what_one_task_gives(spark, monkeypatch):
    """Several groups with points that are no core, piles' weights and shared borders, in many bands."""
    monkeypatch.setattr(bands_module, "LINKS_PER_POINT", 1)
    ids, xy = blobs(21, n=160)
    core = brute.core_distances(xy, 5, 2.5)
    rows = [(g, int(i), *map(float, p), None if math.isnan(c) else float(c), 1 + int(i) % 3, 2.5) for g in (3, 7) for i, p, c in zip(ids, xy, core)]
    points = spark.createDataFrame(rows, "g int, id long, x double, y double, core_dist double, weight long, radius double")
    points = points.where("g = 3 OR id % 4 > 0")  # the second group lacks points that the core distances were measured with
    columns = ["g", "id", "order_id", "reach_dist"]
    want = ordering_module.order_groups(points, "g", ("x", "y")).select(*columns)
    found = bands_module.order_by_bands(points, "g", ("x", "y"), 2.5, 150).select(*columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("limit", [60, 100_000])
def test_partitioned_ordering_of_any_size(spark, limit):
    """Each leaf with its whole halo is ordered as the plain model orders these points, whatever a task may hold."""
    ids, xy = blobs(22, n=160)
    core = dict(zip(ids, brute.core_distances(xy, 4, 2.0)))
    ordering = partitioned_ordering(frame(spark, ids, xy), 4, 2.0, partitions=2, max_local_points=limit)
    assert len(ordering.tree.leaves) == 2
    copies = ordering.copies.toPandas()
    assert (copies["radius"] == 2.0).all()
    for _, leaf in copies.groupby("part_id"):
        plain = leaf.drop(columns=["order_id", "reach_dist"]).assign(weight=1, core_dist=[core[i] for i in leaf["id"]])
        want = ordering_module.order_group(plain, ("x", "y")).set_index("id")
        for r in leaf.itertuples():
            place, reach = want.loc[r.id, "order_id"], want.loc[r.id, "reach_dist"]
            assert (pd.isna(place) and pd.isna(r.order_id)) or place == r.order_id
            assert (pd.isna(reach) and pd.isna(r.reach_dist)) or reach == r.reach_dist


@pytest.mark.parametrize(("partitions", "pile"), [(1, 0), (2, 80), (8, 80)])
def test_partitioned_labels_do_not_depend_on_partitions(spark, partitions, pile):
    ids, xy = blobs(12, pile=pile)
    points = frame(spark, ids, xy)
    ordering = partitioned_ordering(points, 4, 2.0, partitions=partitions)
    for radius in (2.0, 1.3):
        expected = brute.labels(ids, xy, 4, 2.0, radius)
        rows = ordering.labels(radius).collect()
        assert len(rows) == len(ids)
        assert {r["id"]: r["cluster_id"] for r in rows} == expected
        cores = brute.core_distances(xy, 4, 2.0)
        assert {r["id"] for r in rows if r["is_core"]} == {i for i, c in zip(ids, cores) if c <= radius}
    with pytest.raises(ValueError):
        ordering.labels(2.5)


def test_labels_of_leaves_beyond_one_task(spark):
    ids, xy = blobs(13, pile=150)
    ordering = partitioned_ordering(frame(spark, ids, xy), 4, 3.0, partitions=3, max_local_points=90)
    assert len(ordering.tree.leaves) == 3
    assert {r["id"]: r["cluster_id"] for r in ordering.labels().collect()} == brute.labels(ids, xy, 4, 3.0)


def test_extraction_and_series(spark):
    ids, xy = blobs(14)
    ordered = exact_ordering(frame(spark, ids, xy), 4, 2.0).where("order_id is not null").withColumn("g", F.lit(0))
    rows = extract(ordered, 1.2, ["g"], offset=10).collect()
    expected = brute.labels(ids, xy, 4, 2.0, 1.2)
    groups = {}
    for r in rows:
        if r["core_dist"] is not None and r["core_dist"] <= 1.2:
            groups.setdefault(r["local_cluster"], set()).add(expected[r["id"]])
    assert all(len(g) == 1 for g in groups.values()) and min(groups) == 11
    series = reachability_series(ordered, 1.5).collect()
    assert max(r["height"] for r in series) == 1.5 and len(series) == len(rows)


def test_local_group_function():
    import pandas as pd

    ids, xy = blobs(15)
    core = brute.core_distances(xy, 4, 2.0)
    pdf = pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1], "core_dist": core, "radius": 2.0, "weight": 1})
    out = ordering_module.order_group(pdf, ("x", "y")).dropna(subset=["order_id"]).sort_values("order_id")
    got = [(i, None if math.isnan(r) else r) for i, r in zip(out["id"], out["reach_dist"])]
    assert got == brute.ordering(ids, xy, 4, 2.0)


def test_best_copy_prefers_clusters_then_reach(spark):
    rows = [(1, 0, True, None, None), (1, 1, False, 3, 0.5), (2, 0, False, 1, 0.4), (2, 1, True, 2, 0.4)]
    local = spark.createDataFrame(rows, "id bigint, part_id int, is_home boolean, local_cluster bigint, reach_dist double")
    best = {r["id"]: r["part_id"] for r in best_copies(local).collect()}
    assert best == {1: 1, 2: 1}


@pytest.mark.parametrize("method", ["min_var", "rotation"])
def test_kd_leaves(spark, method):
    ids, xy = blobs(16, n=600)
    points = frame(spark, ids, xy)
    tree = build_kdtree(points, max_partitions=16, split_method=method)
    assert len(tree.leaves) == 16
    rows = tree.assign(points).collect()
    sizes = {}
    for r in rows:
        leaf = tree.leaves[r["part_id"]]
        assert leaf.lower[0] <= r["x"] <= leaf.upper[0] and leaf.lower[1] <= r["y"] <= leaf.upper[1]
        sizes[r["part_id"]] = sizes.get(r["part_id"], 0) + 1
    assert sizes == {p: leaf.n for p, leaf in tree.leaves.items()}
    assert max(sizes.values()) < 600 / 16 * 3


def test_kd_of_equal_points_is_one_leaf(spark):
    points = frame(spark, range(20), np.zeros((20, 2)))
    assert len(build_kdtree(points, max_partitions=8).leaves) == 1


def test_halo_matches_the_boxes(spark):
    ids, xy = blobs(17)
    points = frame(spark, ids, xy)
    tree = build_kdtree(points, max_partitions=8)
    radii = {p: 0.5 + 0.25 * p for p in tree.leaves}
    copies = {(r["id"], r["part_id"], r["is_home"]) for r in tree.with_halo(points, radii).collect()}
    home = {r["id"]: r["part_id"] for r in tree.assign(points).collect()}
    expected = set()
    for i, (x, y) in zip(ids, xy):
        for p, leaf in tree.leaves.items():
            r = radii[p]
            if leaf.lower[0] - r <= x <= leaf.upper[0] + r and leaf.lower[1] - r <= y <= leaf.upper[1] + r:
                expected.add((i, p, home[i] == p))
    assert copies == expected


def test_box_join_both_ways(spark):
    ids, xy = blobs(19)
    points = frame(spark, ids, xy)
    boxes = build_kdtree(points, max_partitions=8).leaf_table(spark)
    few = box_range_join(points, boxes, ("x", "y"), 1.0).select("id", "part_id")
    many = box_range_join(points, boxes, ("x", "y"), 1.0, max_broadcast=3).select("id", "part_id")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
