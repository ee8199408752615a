"""Plain quadratic models of the clustering semantics, for small inputs only."""

from __future__ import annotations

import numpy as np


def distances(xy: np.ndarray) -> np.ndarray:
    delta = xy[:, None, :] - xy[None, :, :]
    total = np.zeros(delta.shape[:2])
    for axis in range(xy.shape[1]):
        total = total + delta[:, :, axis] * delta[:, :, axis]
    return np.sqrt(total)


def core_distances(xy: np.ndarray, min_pts: int, eps: float) -> np.ndarray:
    """NaN where fewer than ``min_pts`` others lie within eps."""
    d = distances(xy)
    np.fill_diagonal(d, np.inf)
    if len(xy) <= min_pts:
        return np.full(len(xy), np.nan)
    kth = np.sort(d, axis=1)[:, min_pts - 1]
    return np.where(kth <= eps, kth, np.nan)


def labels(ids, xy, min_pts, eps, radius=None):
    """{id: cluster}: components of core points by least core id; others by least (reach, core id); -1 is noise."""
    radius = eps if radius is None else radius
    d, core = distances(xy), core_distances(xy, min_pts, eps)
    is_core = core <= radius
    cluster = {i: i for i in np.flatnonzero(is_core)}

    def root(i):
        while cluster[i] != i:
            i = cluster[i]
        return i

    near = (d <= radius) & is_core[:, None] & is_core[None, :]
    for a, b in zip(*np.nonzero(near)):
        ra, rb = root(a), root(b)
        if ra != rb:
            cluster[max(ra, rb)] = min(ra, rb)
    members: dict[int, int] = {}
    for i in cluster:
        members.setdefault(root(i), ids[i])
        members[root(i)] = min(members[root(i)], ids[i])
    result = {}
    for i in range(len(ids)):
        if is_core[i]:
            result[ids[i]] = members[root(i)]
            continue
        offers = [
            (max(core[j], d[i, j]), ids[j], members[root(j)]) for j in np.flatnonzero(is_core) if d[i, j] <= radius
        ]
        result[ids[i]] = min(offers)[2] if offers else -1
    return result


def ordering(ids, xy, min_pts, eps):
    """[(id, reach)] of one run over all points: least reach, then least id, next; only core points start."""
    d, core = distances(xy), core_distances(xy, min_pts, eps)
    by_id = sorted(range(len(ids)), key=lambda i: ids[i])
    reach, done, out = {}, set(), []
    for seed in by_id:
        if seed in done or np.isnan(core[seed]):
            continue
        queue = {seed: float("inf")}
        while queue:
            p = min(queue, key=lambda i: (queue[i], ids[i]))
            queue.pop(p)
            done.add(p)
            out.append((ids[p], reach.get(p)))
            if np.isnan(core[p]):
                continue
            for q in by_id:
                if q in done or d[p, q] > eps:
                    continue
                offer = max(core[p], d[p, q])
                if offer < reach.get(q, float("inf")):
                    reach[q] = queue[q] = offer
    return out
