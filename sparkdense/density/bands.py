"""Density-reachability orderings of any size, computed in bands of reach.

An ordering always takes the least pending reach, then the least id. So whatever it can reach at a reach of at most t
from the core points of a block (points of core distance at most t, connected within t) is taken right after the
block is entered, before anything beyond t. The order of the blocks of one band therefore needs only the links of that
band between them, and the order inside a block depends on nothing but the point where it was entered:

1. ``reach_links`` keeps the links that can decide an ordering, about as many as points times ``min_pts``.
2. From narrow to wide bands, blocks grow together (``_blocks``).
3. From wide to narrow bands, one task orders the parts of each block, entered at a known point and place (``_enter``).

Bands hold about equally many links, so a task holds about as many however large and dense a component is. The
number of bands changes nothing in the result.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdense.density.partition import build_kdtree
from sparkdense.graph.components import connected_components
from sparkdense.operators.sequence import prefix_sum
from sparkdense.session import cut_lineage

# Links of a band for each point that a task may hold.
LINKS_PER_POINT = 16
NOWHERE = float("inf")

_LINKS = "src bigint, dst bigint, reach double, mutual double"
_MOVES = "kind string, node bigint, block bigint, place bigint, reach double"


def local_links(pdf: pd.DataFrame, coords: Sequence[str], eps: float) -> pd.DataFrame:
    """Links from the home core points of a leaf to all points within ``eps`` that matter to an ordering.

    A link from p to z is left out when a core point q offers a detour of two steps that are both shorter: the
    detour is then taken first, wherever the ordering comes from. ``mutual`` is the reach at which both ends are
    core points of one block.
    """
    xy, core, node = pdf[list(coords)].to_numpy(float), pdf["core_dist"].to_numpy(float), pdf["node"].to_numpy()
    cells = np.floor(xy / (eps * (1 + 1e-9))).astype(np.int64)
    occupied, owner = np.unique(cells, axis=0, return_inverse=True)
    rows = np.split(np.argsort(owner.ravel(), kind="stable"), np.cumsum(np.bincount(owner.ravel()))[:-1])
    members = dict(zip(map(tuple, occupied.tolist()), rows))
    offsets = list(itertools.product((-1, 0, 1), repeat=len(coords)))
    found: list[tuple] = []
    for p in np.flatnonzero(pdf["is_home"].to_numpy(bool) & ~np.isnan(core)):
        around = [members.get(tuple((cells[p] + o).tolist())) for o in offsets]
        near = np.concatenate([a for a in around if a is not None])
        dist = _distances(xy[near], xy[p])
        inside = (dist <= eps) & (near != p)
        near, dist = near[inside], dist[inside]
        nearest_first = np.argsort(dist, kind="stable")
        near, dist = near[nearest_first], dist[nearest_first]
        while len(near):
            q, reach = near[0], max(core[p], dist[0])
            near, dist = near[1:], dist[1:]
            mutual = NOWHERE if np.isnan(core[q]) else max(reach, core[q])
            found.append((node[p], node[q], reach, mutual))
            if mutual < NOWHERE and len(near):
                stays = (dist <= mutual) | (_distances(xy[near], xy[q]) >= dist)
                near, dist = near[stays], dist[stays]
    return pd.DataFrame(found, columns=["src", "dst", "reach", "mutual"])


def _distances(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    delta = many - one
    return np.sqrt((delta * delta).sum(axis=1))


def reach_links(nodes: DataFrame, coords: Sequence[str], eps: float, leaf_points: int) -> DataFrame:
    """(src, dst, reach, mutual) inside each ``group`` of ``nodes``, leaf by leaf of a KD tree with full halos."""
    coords = tuple(coords)
    seen = nodes.select("node", "group", *coords, "core_dist")
    tree = build_kdtree(seen, coords, max_leaf_points=leaf_points)
    copies = tree.with_halo(seen, dict.fromkeys(tree.leaves, eps * (1 + 1e-9)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return local_links(pdf, coords, eps)

    return copies.groupBy("group", "part_id").applyInPandas(run, _LINKS)


def enter_block(links: pd.DataFrame, entry: pd.Series) -> pd.DataFrame:
    """Order the parts of one block, entered at ``entry``.

    ``links`` lead from a part to a node and to the part that holds it; a part is a block of the next narrower band
    or a single point. Links of reach -1 name the points that a part takes along when it is entered. The result says where each
    part is entered (kind 'run'), which points it takes along ('along'), and the places of single points ('done').
    """
    out: dict[int, list] = {}
    along: dict[int, list] = {}
    columns = ("src_part", "dst", "dst_part", "dst_points", "dst_weight", "reach")
    for part, dst, dst_part, points, weight, reach in zip(*(links[c].tolist() for c in columns)):
        (along if reach < 0 else out).setdefault(part, []).append((reach, dst, dst_part, points, weight))
    taken, rows, place = set(), [], int(entry["place"])
    pending = [(float(entry["reach"]), *(int(entry[c]) for c in ("entry", "part", "points", "weight")))]
    while pending:
        reach, node, part, points, weight = heapq.heappop(pending)
        if part in taken:
            continue
        taken.add(part)
        own = [x for x in along.get(part, ()) if x[2] not in taken]
        is_block = points > 1 or (points == 1 and own)
        rows.append(("run" if is_block else "done", node, part, place, reach))
        place += weight
        for offer in out.get(part, ()):
            heapq.heappush(pending, offer)
        for _, dst, dst_part, _, dst_weight in own:
            taken.add(dst_part)
            rows.append(("along", dst, part, place, NOWHERE))
            place += dst_weight
            for offer in out.get(dst_part, ()):
                heapq.heappush(pending, offer)
    return pd.DataFrame(rows, columns=["kind", "node", "block", "place", "reach"])


def thresholds(links: DataFrame, eps: float, links_per_task: int) -> list[float]:
    """Upper ends of the bands, ascending; the last one is ``eps``."""
    bands = -(-links.count() // links_per_task)
    shares = [i / bands for i in range(1, bands)]
    cuts = links.approxQuantile("reach", shares, 0.1 / bands) if shares else []
    return [*sorted({c for c in cuts if c < eps}), float(eps)]


def _blocks(nodes: DataFrame, links: DataFrame, ends: Sequence[float]) -> list[DataFrame]:
    """(node, block) at no reach at all and at each of ``ends``: blocks go by their least node, other points by themselves."""
    levels = [cut_lineage(nodes.select("node", F.col("node").alias("block")))]
    low = -1.0
    for high in ends:
        state = levels[-1]
        band = links.where((F.col("mutual") > low) & (F.col("mutual") <= high))
        joined = band.join(state.select(F.col("node").alias("src"), F.col("block").alias("a")), "src")
        joined = joined.join(state.select(F.col("node").alias("dst"), F.col("block").alias("b")), "dst")
        found = connected_components(joined.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        merged = state.join(found.select(F.col("id").alias("block"), "component"), "block", "left")
        levels.append(cut_lineage(merged.select("node", F.coalesce("component", "block").alias("block"))))
        low = high
    return levels


def _starts(nodes: DataFrame, links: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The widest blocks, entered at their least node one after the other, and (node, block) of their border points.

    A border point goes with the first block that reaches it.
    """
    member = nodes.where("core_dist is not null").join(top, "node")
    border = links.where(F.col("mutual") == NOWHERE).join(top.withColumnRenamed("node", "src"), "src")
    border = cut_lineage(border.groupBy(F.col("dst").alias("node")).agg(F.min("block").alias("block")))
    both = member.select("block", "weight").unionByName(border.join(nodes, "node").select("block", "weight"))
    sizes = cut_lineage(both.groupBy("block").agg(F.sum("weight").alias("held")))
    ends = prefix_sum(sizes, "block", "held", "end")
    runs = ends.select("block", F.col("block").alias("entry"), (F.col("end") - F.col("held")).alias("place"), F.lit(NOWHERE).alias("reach"))
    return cut_lineage(runs), border


def _enter(nodes, links, wide, narrow, low: float, high: float, runs, along) -> DataFrame:
    """Order the parts of every block of the band between ``low`` and ``high``; rows as ``enter_block`` gives them."""
    inner = F.coalesce(F.col("core_dist") <= low, F.lit(False))
    within = F.coalesce(F.col("core_dist") <= high, F.lit(False))
    taken = along.select("node", F.col("block").alias("taker"))
    placed = nodes.join(wide.withColumnRenamed("block", "wide"), "node").join(narrow.withColumnRenamed("block", "part"), "node")
    placed = placed.join(taken, "node", "left")
    block = F.when(within, F.col("wide")).otherwise(F.col("taker"))
    placed = placed.select("node", "weight", inner.alias("inner"), block.alias("block"), "part").where("block is not null")
    placed = cut_lineage(placed.join(runs.select("block"), "block", "left_semi"))
    # a block of the narrower band has its points, a single point beyond it counts as none
    held = placed.where("inner").groupBy("part").agg(F.count(F.lit(1)).alias("points"), F.sum("weight").alias("held"))
    held = cut_lineage(held)
    placed = placed.join(held, "part", "left")
    part = placed.select(
        "node", "block", "part", "inner",
        F.when(F.col("inner"), F.col("points")).otherwise(0).alias("points"),
        F.when(F.col("inner"), F.col("held")).otherwise(F.col("weight")).alias("weight"),
    )
    part = cut_lineage(part)
    source = part.select(F.col("node").alias("src"), "block", F.col("part").alias("src_part"), F.col("inner").alias("src_inner"))
    target = part.select(F.col("node").alias("dst"), F.col("block").alias("to"), *[F.col(c).alias(f"dst_{c}") for c in ("part", "inner", "points", "weight")])
    of_band = (F.col("reach") <= high) & ((F.col("reach") > low) | (F.col("mutual") > low))
    joined = links.where(of_band).join(source, "src").join(target, "dst").where("block = to and src_part <> dst_part")
    goes_along = (F.col("reach") <= low) & F.col("src_inner") & ~F.col("dst_inner")
    moves = joined.where((F.col("reach") > low) | goes_along).withColumn("reach", F.when(F.col("reach") > low, F.col("reach")).otherwise(-1.0))
    # of the links between two parts only the first that the ordering would take matters
    best = F.min(F.struct("reach", "dst", "dst_points", "dst_weight")).alias("b")
    moves = moves.groupBy("block", "src_part", "dst_part", (F.col("reach") < 0).alias("along")).agg(best)
    moves = moves.select("block", "src_part", "dst_part", "b.*")
    at = part.select(F.col("node").alias("entry"), "part", "points", "weight")
    entries = runs.join(at, "entry")

    def run(links: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if entry.empty:
            return pd.DataFrame(columns=["kind", "node", "block", "place", "reach"])
        return enter_block(links, entry.iloc[0])

    return moves.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(run, _MOVES)


def order_by_bands(points: DataFrame, group: str, coords: Sequence[str], eps: float, max_points: int) -> DataFrame:
    """``points`` plus ``order_id`` and ``reach_dist``: the ordering of each group, as ``order_group`` would give it.

    ``points`` has ``id``, the coordinates, ``core_dist`` and ``weight``. ``max_points`` bounds what a task holds, not
    what is found: leaves have an eighth of it, bands about ``LINKS_PER_POINT`` links for each.
    """
    coords = tuple(coords)
    keys = ["_group", "id"]
    sorted_points = points.withColumn("_group", F.col(group)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = cut_lineage(sorted_points.withColumn("node", F.monotonically_increasing_id()))
    nodes = numbered.select("node", F.col("_group").alias("group"), *coords, "core_dist", "weight")
    links = cut_lineage(reach_links(nodes, coords, float(eps), max(1, max_points // 8)))
    nodes = nodes.select("node", "core_dist", "weight")
    ends = thresholds(links, float(eps), LINKS_PER_POINT * max_points)
    levels = _blocks(nodes, links, ends)
    runs, along = _starts(nodes, links, levels[-1])
    done = []
    for i in range(len(ends) - 1, -1, -1):
        low = ends[i - 1] if i else -1.0
        moves = cut_lineage(_enter(nodes, links, levels[i + 1], levels[i], low, ends[i], runs, along))
        done.append(moves.where("kind = 'done'").select("node", "place", "reach"))
        along = moves.where("kind = 'along'").select("node", "block")
        runs = moves.where("kind = 'run'").select("block", F.col("node").alias("entry"), "place", "reach")
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    placed = cut_lineage(numbered.join(places, "node", "left"))
    first = placed.groupBy("_group").agg(F.min("place").alias("_first"))
    placed = placed.join(first, placed["_group"].eqNullSafe(first["_group"])).drop(first["_group"])
    reach = F.when(F.col("reach") < NOWHERE, F.col("reach"))
    placed = placed.withColumns({"order_id": F.col("place") - F.col("_first"), "reach_dist": reach})
    return placed.select(*points.columns, "order_id", "reach_dist")
