"""Vectors of many axes against quadratic models: piles, tight balls, unusable rows, leaves of any size."""

import math

import numpy as np
import pytest

from sparkdense.density import metric
from sparkdense.density.labels import density_labels
from sparkdense.density.metric import ball_tree, places_of, range_join, vector_core_distances, vector_counts, vector_labels
from tests.test_density import blobs, frame


def cloud(seed, k, n=150):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 10, (3, k))
    parts = [centres[i] + rng.normal(0, 0.3, (n // 3, k)) for i in range(3)]
    parts += [rng.uniform(0, 10, (12, k)), np.repeat(centres[:1], 40, axis=0), centres[1] + rng.normal(0, 1e-4, (60, k))]
    xs = np.concatenate(parts)
    return rng.permutation(len(xs)).tolist(), xs


def vectors(spark, ids, xs):
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(ids, xs, strict=True)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(4)


def distances(xs):
    total = np.zeros((len(xs), len(xs)))
    for axis in range(xs.shape[1]):
        total += (xs[:, axis, None] - xs[None, :, axis]) ** 2
    return np.sqrt(total)


def model(ids, xs, min_pts, eps):
    """{id: (n_near, core_dist, cluster_id)} by all pairs."""
    dist, ids = distances(xs), np.array(ids)
    near = dist <= eps
    core = [None] * len(xs)
    for i in range(len(xs)):
        others = np.sort(np.delete(dist[i], i))
        if len(others) >= min_pts and others[min_pts - 1] <= eps:
            core[i] = float(others[min_pts - 1])
    cluster = {i: None for i in range(len(xs))}
    for start in sorted((i for i in range(len(xs)) if core[i] is not None), key=lambda i: ids[i]):
        todo = [start] if cluster[start] is None else []
        while todo:
            i = todo.pop()
            if cluster[i] is None:
                cluster[i] = int(ids[start])
                todo += [j for j in np.flatnonzero(near[i]) if core[j] is not None and cluster[j] is None]
    for i in range(len(xs)):
        if core[i] is None:
            reach = [(max(core[j], dist[i, j]), ids[j], cluster[j]) for j in np.flatnonzero(near[i]) if core[j] is not None]
            cluster[i] = min(reach)[2] if reach else -1
    return {int(ids[i]): (int(near[i].sum()), core[i], cluster[i]) for i in range(len(xs))}


@pytest.mark.parametrize(("k", "eps", "leaf"), [(8, 1.2, 8), (64, 3.5, 20)])
def test_many_axes_against_all_pairs(spark, k, eps, leaf):
    ids, xs = cloud(k, k)
    points, expected = vectors(spark, ids, xs), model(ids, xs, 4, eps)
    assert len({c for _, _, c in expected.values()}) > 2 and any(c is None for _, c, _ in expected.values())
    counts = {r["id"]: r["n_near"] for r in vector_counts(points, eps, leaf).collect()}
    assert counts == {i: e[0] for i, e in expected.items()}
    cores = {r["id"]: r["core_dist"] for r in vector_core_distances(points, 4, eps, leaf).collect()}
    assert cores == {i: e[1] for i, e in expected.items()}
    labels = {r["id"]: (r["core_dist"], r["cluster_id"]) for r in vector_labels(points, 4, eps, leaf).collect()}
    assert labels == {i: e[1:] for i, e in expected.items()}


def test_plane_labels_equal_those_of_the_grid(spark):
    ids, xy = blobs(3, pile=30)
    flat = density_labels(frame(spark, ids, xy), 4, 1.1).collect()
    assert {tuple(r) for r in vector_labels(vectors(spark, ids, xy), 4, 1.1, 16).collect()} == {tuple(r) for r in flat}


def test_range_join_of_two_tables(spark):
    ids, xs = cloud(5, 6)
    left, right = (ids[:100], xs[:100]), (ids[60:], xs[60:])
    eps = float(np.quantile(distances(xs), 0.1))
    got = {(r["left_id"], r["right_id"]): r["dist"] for r in range_join(vectors(spark, *left), vectors(spark, *right), eps, 8).collect()}
    dist = distances(xs)
    expected = {(ids[i], ids[j]): dist[i, j] for i in range(100) for j in range(60, len(xs)) if dist[i, j] <= eps}
    assert got == expected


def test_unusable_rows_lengths_and_ends(spark):
    rows = [
        (1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [-0.0, 0.0]), (4, [0.0]), (5, None), (6, []), (7, [math.nan, 0.0]),
        (8, [math.inf, 0.0]), (9, [None, 0.0]), (None, [0.0, 0.0]), (10, [1e300, 0.0]),
    ]
    points = spark.createDataFrame(rows, "id bigint, vector array<double>")
    counts = {r["id"]: r["n_near"] for r in vector_counts(points, 5.0).collect()}
    assert counts == {1: 3, 2: 3, 3: 3, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, None: 0, 10: 1}
    labels = {r["id"]: (r["core_dist"], r["is_core"], r["cluster_id"]) for r in vector_labels(points, 2, 5.0).collect()}
    assert labels[1] == labels[3] == labels[2] == (5.0, True, 1)
    assert all(labels[i] == (None, False, -1) for i in (4, 5, 6, 7, 8, 9, None, 10))
    assert vector_labels(points.limit(0), 2, 5.0).collect() == []


def test_leaves_stay_small_and_hopeless_nodes_end(spark):
    ids, xs = cloud(7, 8, 600)
    tree = ball_tree(places_of(vectors(spark, ids, xs)), 10)
    assert max(r["count"] for r in tree.places.groupBy("leaf").count().collect()) <= 10
    assert len(tree.levels) > 1
    tiny = [(i, [i * 1e-200]) for i in range(40)]  # squares of the differences are zero
    points = spark.createDataFrame(tiny, "id bigint, vector array<double>")
    assert {r["n_near"] for r in vector_counts(points, 1e-9, 5).collect()} == {40}
    huge = [(i, [1e300 * (i % 2), float(i // 2)]) for i in range(40)]  # squares of the differences overflow
    points = spark.createDataFrame(huge, "id bigint, vector array<double>")
    assert {r["n_near"] for r in vector_counts(points, 100.0, 5).collect()} == {20}


def test_rows_written_grow_with_places_not_with_pairs(spark, monkeypatch):
    """Distances that hardly differ: no ball is beyond reach, yet no row for each search and leaf may arise."""
    xs = np.random.default_rng(11).normal(size=(1000, 16))
    xs /= np.linalg.norm(xs, axis=1)[:, None]
    written, cut = [], metric.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(metric, "cut_lineage", counted)
    monkeypatch.setattr(metric, "TILE_PLACES", 400)
    got = {r["id"]: r["n_near"] for r in vector_counts(vectors(spark, range(1000), xs), 0.9, 32).collect()}
    assert got == dict(enumerate((distances(xs) <= 0.9).sum(axis=1).tolist()))
    assert sum(written) < 10 * len(xs)
