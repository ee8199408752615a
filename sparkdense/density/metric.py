"""Range joins, neighbour counts, core distances and density labels for vectors of any number of axes.

Equal vectors are one *place* with a number of copies. A tree of balls is grown over the places, level by level and as
tables: a node with too many places is split among the places with its least hashes, each place goes to the nearest.
Neighbouring leaves are packed into *tiles*, and what is shuffled are pairs of tiles that the triangle inequality does not
put beyond reach: each holds millions of pairs of places, so few bytes move for each comparison. In a task, pairs of
leaves are skipped, or taken as wholes, in the same way. What remains is compared by matrix products, which leave a margin
for rounding: pairs nearer to the edge are measured axis by axis, so no decision differs from a direct distance test.

Points are rows of a unique bigint ``id`` and an array ``vector``. Vectors of different lengths are never near each other.
Rows with a null id, and vectors that are null, empty or hold null or non-finite components, are near nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdense.density.labels import NOISE
from sparkdense.functions.columns import vector_distance
from sparkdense.graph.components import connected_components
from sparkdense.operators.relational import smallest_per_key
from sparkdense.session import broadcast_if_small, cut_lineage

# Parts that a node is split into.
FANOUT = 16
# Nodes with more places are split; also the searches that one comparison holds.
LEAF_PLACES = 256
# Places and numbers that a tile holds, up to twice as many; the groups that a tile's comparisons are dealt to.
TILE_PLACES = 16_384
TILE_NUMBERS = 1 << 20
TILE_GROUPS = 4
# Pairs measured at a time.
EXACT_PAIRS = 1 << 20
# Relative margin of decisions on whole balls, and the least margin of those on squares (these may underflow).
SLACK = 1e-9
TINY = 1e-290


@dataclass(frozen=True)
class BallTree:
    """``places``: pid (the least id), vector, copies, leaf. ``levels``: for each level the splits (node, children)."""

    places: DataFrame
    levels: list[DataFrame]


def usable_points(points: DataFrame) -> DataFrame:
    """(id, vector) of the rows that can be near something, components as doubles and without negative zeros."""
    vector = F.transform("vector", lambda v: v.cast("double") + F.lit(0.0))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return points.select("id", vector.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0) & fine)


def places_of(points: DataFrame) -> DataFrame:
    """One stored row for all points of equal vectors: pid, vector, copies."""
    grouped = usable_points(points).groupBy("vector").agg(F.min("id").alias("pid"), F.count("*").alias("copies"))
    return cut_lineage(grouped.select("pid", "vector", "copies"))


def _with_places(points: DataFrame, results: DataFrame) -> DataFrame:
    """The ids of all usable points with the result of their place; ``results`` has the vector."""
    return usable_points(points).join(cut_lineage(results), "vector").drop("vector", "pid")


# --- the tree ---------------------------------------------------------------------------------------------


def ball_tree(places: DataFrame, leaf_places: int = LEAF_PLACES) -> BallTree:
    """Split nodes until none has more than ``leaf_places`` places; the number of leaves has no limit.

    A node that one split left whole (distances too small for a double) stays a leaf; comparisons cut it into parts.
    """
    placed = places.withColumn("leaf", F.size("vector").cast("string"))
    levels: list[DataFrame] = []
    before = None
    while True:
        large = placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_places)
        if before is not None:
            parent = F.substring_index("leaf", ".", len(levels))
            large = large.withColumn("up", parent).join(before, "up").where("n < n_up").select("leaf", "n")
        large = cut_lineage(large)
        if large.isEmpty():
            return BallTree(placed, levels)
        inside = placed.join(broadcast_if_small(large.select("leaf")), "leaf", "left_semi")
        hashed = inside.select("leaf", "pid", "vector", F.xxhash64("vector").alias("h"))
        chosen = smallest_per_key(hashed, ["leaf"], ["h", "pid"], FANOUT)
        pivots = cut_lineage(chosen.groupBy("leaf").agg(F.collect_list(F.struct("rank", "vector")).alias("pivots")))
        to_pivots = F.transform(
            "pivots", lambda p: F.struct(vector_distance(p["vector"], F.col("vector")).alias("dist"), p["rank"].alias("rank"))
        )
        moved = placed.join(broadcast_if_small(pivots), "leaf", "left").withColumn("near", F.array_min(to_pivots))
        child = F.concat_ws(".", "leaf", F.col("near.rank").cast("string"))  # skips a null rank
        moved = cut_lineage(moved.select("pid", "vector", "copies", child.alias("leaf"), F.col("leaf").alias("up"), "near"))
        balls = moved.where("near is not null").groupBy("up", "leaf", "near.rank").agg(
            F.max("near.dist").alias("radius"), F.sum("copies").alias("copies"), F.min("pid").alias("least")
        )
        centres = pivots.select(F.col("leaf").alias("up"), F.explode("pivots").alias("p"))
        balls = balls.join(centres.select("up", "p.rank", F.col("p.vector").alias("pivot")), ["up", "rank"])
        ball = F.struct(F.col("leaf").alias("node"), "pivot", "radius", "copies", "least")
        levels.append(cut_lineage(balls.groupBy(F.col("up").alias("node")).agg(F.collect_list(ball).alias("children"))))
        placed = moved.drop("up", "near")
        before = large.select(F.col("leaf").alias("up"), F.col("n").alias("n_up"))


# --- tiles ------------------------------------------------------------------------------------------------


def _tiled(tree: BallTree) -> DataFrame:
    """The places of a tree with ``tile``: neighbouring leaves that are compared together.

    The topmost nodes that fit into a tile are put side by side with their siblings; a leaf that does not fit is cut.
    """
    rows, axes = tree.places.agg(F.count("*"), F.max(F.size("vector"))).first()
    tasks = tree.places.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(TILE_PLACES, TILE_NUMBERS // max(1, axes or 1)))
    fit = F.lit(max(min(LEAF_PLACES, most), min(most, (rows or 0) // tasks)))
    leaves = cut_lineage(tree.places.groupBy("leaf").agg(F.count("*").alias("n")))
    path = F.split("leaf", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "."))
    nodes = leaves.select("leaf", "n", F.explode(above).alias("node"))
    fitting = nodes.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") <= fit)
    chosen = nodes.select("leaf", "node").join(fitting, "node").groupBy("leaf")
    chosen = chosen.agg(F.min(F.struct(F.length("node"), "node", "n")).alias("top")).select("leaf", "top.node", "top.n")
    parent = F.regexp_replace("node", r"\.?[^.]*$", "")
    units = chosen.select("node", "n", parent.alias("up")).distinct()
    upto = F.sum("n").over(Window.partitionBy("up").orderBy("node")) - F.col("n")  # siblings: at most FANOUT rows
    units = units.select("node", F.concat_ws("#", "up", F.floor(upto / fit).cast("string"), F.when(F.col("up") == "", F.col("node"))).alias("tile"))
    named = leaves.join(chosen.select("leaf", "node").join(units, "node"), "leaf", "left")
    named = cut_lineage(named.select("leaf", "tile", F.ceil(F.col("n") / fit).alias("parts")))
    part = F.concat_ws("/", "leaf", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("string"))
    placed = tree.places.join(broadcast_if_small(named), "leaf").withColumn("tile", F.coalesce("tile", part))
    return cut_lineage(placed.drop("parts"))


def _packed(places: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """One row for each tile: its ball, the greatest ``reach`` of its places if they have one, and arrays as bytes."""
    extras = list(extras)
    schema = "tile string, axes int, rows int, centre array<double>, radius double, reach double, narrow boolean, sizes binary, vector binary, pid binary"
    schema += "".join(f", {c} binary" for c in extras if c != "reach") + (", reaches binary" if "reach" in extras else "")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["leaf", "pid"])
        xs = np.stack(rows["vector"].to_list())
        with np.errstate(all="ignore"):
            centre = xs[0] + (xs - xs[0]).mean(axis=0)
            radius = float(_apart(xs, centre[None, :]).max())
            small = xs.astype(np.float32)
            narrow = bool((small == xs).all())
        out = {"tile": key[0], "axes": xs.shape[1], "rows": len(xs), "centre": centre.tolist(), "radius": radius, "narrow": narrow}
        out |= {"reach": float(rows["reach"].max()) if "reach" in extras else None}
        sizes = rows.groupby("leaf").size().to_numpy().astype(np.int64)
        out |= {"sizes": sizes.tobytes(), "vector": (small if narrow else xs).tobytes(), "pid": rows["pid"].to_numpy().tobytes()}
        out |= {"reaches" if c == "reach" else c: rows[c].to_numpy().tobytes() for c in extras}
        return pd.DataFrame([out])

    return cut_lineage(places.select("tile", "leaf", "pid", "vector", *extras).groupBy("tile").applyInPandas(pack, schema))


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows (or of each row and one), summed axis by axis."""
    total = np.zeros((len(left), len(right)))
    for axis in range(left.shape[1]):
        apart = left[:, axis, None] - right[None, :, axis]
        total += apart * apart
    return np.sqrt(total)


class _Tile:
    """A packed tile in a task: vectors, ids and other columns, and the balls of its leaves."""

    def __init__(self, row: dict):
        self.name, axes = row["tile"], row["axes"]
        self.xs = np.frombuffer(row["vector"], np.float32 if row["narrow"] else np.float64).astype(np.float64).reshape(-1, axes)
        kinds = {"core_dist": np.float64, "reaches": np.float64}
        fixed = ("tile", "axes", "rows", "centre", "radius", "reach", "narrow", "sizes", "vector")
        self.columns = {c: np.frombuffer(v, kinds.get(c, np.int64)) for c, v in row.items() if c not in fixed}
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        centres, radii = [], []
        for start, end in zip(self.starts, self.ends, strict=True):
            own = self.xs[start:end]
            centres.append(own[0] + (own - own[0]).mean(axis=0))
            radii.append(_apart(own, centres[-1][None, :]).max())
        self.centres, self.radii = np.array(centres), np.array(radii)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]


def _exact(left: _Tile, right: _Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows ``i`` and ``j``, summed axis by axis: what decides near a reach."""
    total = np.zeros(len(i))
    for axis in range(left.xs.shape[1]):
        apart = left.xs[i, axis] - right.xs[j, axis]
        total += apart * apart
    return np.sqrt(total)


def _blocks(left: _Tile, right: _Tile, reach: np.ndarray, wholes: bool = False, wanted=None):
    """The pairs of rows that have to be compared, one block of ``left`` at a time.

    Yields (rows of left, rows of right, excess, margin): ``excess`` is the squared distance beyond the squared reach by
    one matrix product; below -margin a pair is within reach, above margin it is not, between them ``_exact`` decides.
    Pairs of leaves beyond reach are left out. With ``wholes``, leaves that are within reach as wholes are yielded as
    rows without an excess. ``wanted`` may drop rows of right, given those of left.
    """
    far = _apart(left.centres, right.centres)
    around = left.radii[:, None] + right.radii[None, :]
    furthest = np.maximum.reduceat(reach, left.starts)[:, None]
    slack = SLACK * (far + around + furthest)
    beyond = far - around > furthest + slack  # not a number where distances overflow: such leaves are compared
    whole = (far + around <= np.minimum.reduceat(reach, left.starts)[:, None] - slack) & wholes
    middle = left.xs[0] + (left.xs - left.xs[0]).mean(axis=0)
    mine, other = left.xs - middle, right.xs - middle
    mine_sq, other_sq = (mine * mine).sum(axis=1), (other * other).sum(axis=1)
    axes = left.xs.shape[1]
    product = np.concatenate([other * -2.0, np.ones((len(other), 1)), other_sq[:, None]], axis=1).T.copy()
    squares = reach * reach
    searched = np.concatenate([mine, (mine_sq - squares)[:, None], np.ones((len(mine), 1))], axis=1)
    error = 16 * (axes + 8) * np.finfo(float).eps
    for leaf in range(len(left.sizes)):
        for n in np.flatnonzero(whole[leaf]):
            yield np.arange(left.starts[leaf], left.ends[leaf]), np.arange(right.starts[n], right.ends[n]), None, None
        cols = np.flatnonzero(np.repeat(~beyond[leaf] & ~whole[leaf], right.sizes))
        for start in range(left.starts[leaf], left.ends[leaf], LEAF_PLACES):
            rows = np.arange(start, min(start + LEAF_PLACES, left.ends[leaf]))
            some = cols if wanted is None else wanted(rows, cols)
            if len(some):
                excess = searched[rows] @ (product if len(some) == product.shape[1] else product[:, some])
                size = np.sqrt(mine_sq[rows].max()) + np.sqrt(other_sq[some])
                yield rows, some, excess, error * (size * size + squares[rows].max()) + TINY


def _within(left: _Tile, right: _Tile, reach: np.ndarray, rows: np.ndarray, cols: np.ndarray, excess, margin) -> np.ndarray:
    """Which pairs of a block are within reach; the few near the edge are measured again."""
    near = ~(excess > margin)
    i, j = np.nonzero(near & ~(excess < -margin))
    for at in range(0, len(i), EXACT_PAIRS):
        a, b = i[at : at + EXACT_PAIRS], j[at : at + EXACT_PAIRS]
        near[a, b] = _exact(left, right, rows[a], cols[b]) <= reach[rows[a]]
    return near


def _hits(left: _Tile, right: _Tile, reach: np.ndarray, nearest: int | None = None):
    """Rows of left, rows of right and distances of the pairs within reach, in pieces; all pairs of a row come together.

    With ``nearest``, pairs may be left out that at least so many others of their row precede by distance.
    """
    for rows, cols, excess, margin in _blocks(left, right, reach):
        near = ~(excess > margin)
        if nearest is not None and nearest < len(cols) and np.count_nonzero(near) > 8 * nearest * len(rows):
            least = np.partition(np.where(np.isnan(excess), -np.inf, excess), nearest - 1, axis=1)[:, nearest - 1]
            near &= ~(excess > (least + 2 * margin.max())[:, None])
        step = max(1, EXACT_PAIRS // len(cols))
        for at in range(0, len(rows), step):
            i, j = np.nonzero(near[at : at + step])
            i, j = rows[i + at], cols[j]
            dist = _exact(left, right, i, j)
            inside = dist <= reach[i]
            yield i[inside], j[inside], dist[inside]


def _found_pairs(eps: float):
    def found(left: _Tile, right: _Tile):
        for i, j, dist in _hits(left, right, np.full(len(left.xs), eps)):
            yield {"qid": left["pid"][i], "pid": right["pid"][j], "dist": dist}

    return found


def _found_counts(eps: float):
    """Counts of both tiles' places, as each pair of tiles is compared once."""

    def found(left: _Tile, right: _Tile):
        reach = np.full(len(left.xs), eps)
        ours, theirs = np.zeros(len(left.xs)), np.zeros(len(right.xs))
        mine, other = left["copies"].astype(float), right["copies"].astype(float)
        for rows, cols, excess, margin in _blocks(left, right, reach, wholes=True):
            if excess is None:
                ours[rows] += other[cols].sum()
                theirs[cols] += mine[rows].sum()
                continue
            near = _within(left, right, reach, rows, cols, excess, margin).astype(float)
            ours[rows] += near @ other[cols]
            theirs[cols] += mine[rows] @ near
        yield {"qid": left["pid"], "n": ours.astype(np.int64)}
        if left.name != right.name:
            yield {"qid": right["pid"], "n": theirs.astype(np.int64)}

    return found


def _found_nearest(k: int):
    def found(left: _Tile, right: _Tile):
        for i, j, dist in _hits(left, right, left["reaches"], k + 1):
            pid = right["pid"][j]
            copies = right["copies"][j] - (pid == left["pid"][i])  # a point is not its own neighbour
            some = copies > 0
            i, dist, pid, copies = i[some], dist[some], pid[some], copies[some]
            order = np.lexsort((pid, dist, i))
            first = np.searchsorted(i[order], i[order])
            order = order[np.arange(len(order)) - first < k]
            yield {"qid": left["pid"][i[order]], "dist": dist[order], "pid": pid[order], "copies": copies[order]}

    return found


def _found_links(eps: float):
    """Links that connect the vertices of two tiles as all their pairs within reach do: each vertex with one other."""

    def found(left: _Tile, right: _Tile):
        reach = np.full(len(left.xs), eps)
        vertices, named = np.unique(np.concatenate([left["vertex"], right["vertex"]]), return_inverse=True)
        ours, theirs = named[: len(left.xs)], named[len(left.xs) :]
        label = np.arange(len(vertices))

        def unconnected(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            least, most = label[ours[rows]].min(), label[ours[rows]].max()
            return cols if least < most else cols[label[theirs[cols]] != least]

        for rows, cols, excess, margin in _blocks(left, right, reach, wholes=True, wanted=unconnected):
            if excess is None:
                _connect(label, np.repeat(ours[rows[0]], len(cols)), theirs[cols])
                _connect(label, ours[rows], np.repeat(theirs[cols[0]], len(rows)))
            else:
                i, j = np.nonzero(_within(left, right, reach, rows, cols, excess, margin))
                _connect(label, ours[rows[i]], theirs[cols[j]])
        moved = label != np.arange(len(label))
        yield {"src": vertices[moved], "dst": vertices[label[moved]]}

    return found


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the components of each i and its j one label, the least; every label names itself."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _found_border(eps: float):
    def found(left: _Tile, right: _Tile):
        for i, j, dist in _hits(left, right, np.full(len(left.xs), eps)):
            reach, pid = np.maximum(dist, right["core_dist"][j]), right["pid"][j]
            order = np.lexsort((pid, reach, i))
            order = order[np.unique(i[order], return_index=True)[1]]
            yield {
                "qid": left["pid"][i[order]], "reach_dist": reach[order], "core_id": pid[order],
                "cluster_id": right["cluster_id"][j[order]],
            }

    return found


def _compare(left: DataFrame, right: DataFrame, eps: float, found, schema: str, which: str = "true") -> DataFrame:
    """Apply ``found`` to all pairs of packed tiles that are near enough, and for which ``which`` holds of names a and b.

    A tile of ``left`` goes to several groups, each with some of its tiles of ``right``; a task holds few pairs at a time.
    """
    spark = left.sparkSession

    def balls(tiles: DataFrame, name: str) -> DataFrame:
        return tiles.select("axes", F.struct(F.col("tile").alias("name"), "centre", "radius", "reach").alias(name))

    far = vector_distance(F.col("a.centre"), F.col("b.centre"))
    around = F.col("a.radius") + F.col("b.radius")
    reach = F.coalesce("a.reach", F.lit(eps))
    gap = far - around
    near = (gap <= reach + F.lit(SLACK) * (far + around + reach)) | F.isnan(gap)
    pairs = balls(left, "a").join(broadcast_if_small(balls(right, "b")), "axes").where(near)
    pairs = pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).where(which)
    pairs = cut_lineage(pairs.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(TILE_GROUPS)).cast("int")))
    tasks = max(1, min(pairs.count(), max(spark.sparkContext.defaultParallelism * 8, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    groups = pairs.select("a", "g").distinct()
    ours = left.select(F.col("tile").alias("a"), F.struct(*left.columns).alias("left")).join(broadcast_if_small(groups), "a")
    theirs = right.select(F.col("tile").alias("b"), F.struct(*right.columns).alias("right")).join(broadcast_if_small(pairs), "b")
    both = ours.repartition(tasks, "a", "g").join(theirs.repartition(tasks, "a", "g"), ["a", "g"]).select("left", "right")
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        with np.errstate(all="ignore"):
            for batch in batches:
                for row in range(batch.num_rows):
                    mine, other = (_Tile(batch.column(c)[row].as_py()) for c in (0, 1))
                    for piece in found(mine, other):
                        yield pa.RecordBatch.from_arrays([pa.array(piece[n]) for n in names], names=names)

    return both.mapInArrow(run, schema)


# --- operations -------------------------------------------------------------------------------------------


def range_join(left: DataFrame, right: DataFrame, eps: float, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(left_id, right_id, dist) of all pairs at a distance of at most ``eps``; the pairs of places are compared once."""
    queries = places_of(left)
    places = queries if right is left else places_of(right)
    searches = _packed(_tiled(ball_tree(queries, leaf_places)))
    members = searches if right is left else _packed(_tiled(ball_tree(places, leaf_places)))
    pairs = cut_lineage(_compare(searches, members, float(eps), _found_pairs(float(eps)), "qid long, pid long, dist double"))
    lefts = _with_places(left, queries.select("vector", F.col("pid").alias("qid"))).withColumnRenamed("id", "left_id")
    rights = usable_points(right).join(places.select("vector", F.col("pid").alias("own")), "vector")
    rights = rights.select(F.col("id").alias("right_id"), F.col("own").alias("pid"))
    return lefts.join(pairs, "qid").join(rights, "pid").select("left_id", "right_id", "dist")


def vector_counts(points: DataFrame, eps: float, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(id, n_near): the points within ``eps`` of each point, itself included; 0 for unusable rows.

    Leaves that lie wholly within reach of each other are counted without being opened.
    """
    places = places_of(points)
    tiles = _packed(_tiled(ball_tree(places, leaf_places)), ["copies"])
    counts = _compare(tiles, tiles, float(eps), _found_counts(float(eps)), "qid long, n long", "a <= b")
    counts = counts.groupBy("qid").agg(F.sum("n").alias("n_near"))
    by_place = places.join(counts.withColumnRenamed("qid", "pid"), "pid").select("vector", "n_near")
    found = points.select("id").join(_with_places(points, by_place), "id", "left")
    return found.select("id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _kth(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, core_dist): the distance at which the copies of the nearest places reach ``k``."""
    nearest = cut_lineage(smallest_per_key(candidates, ["qid"], ["dist", "pid"], k))
    reached = F.sum("copies").over(Window.partitionBy("qid").orderBy("rank"))  # at most k rows each
    return nearest.withColumn("reached", reached).where(F.col("reached") >= k).groupBy("qid").agg(F.min("dist").alias("core_dist"))


def _place_cores(tiled: DataFrame, min_pts: int, eps: float) -> DataFrame:
    """The places with ``core_dist``, NULL beyond ``eps``.

    The own tile gives each place a first bound, so that few pairs with other tiles are measured.
    """
    schema, found = "qid long, dist double, pid long, copies long", _found_nearest(min_pts)
    start = _packed(tiled.withColumn("reach", F.lit(float(eps))), ["copies", "reach"])
    home = cut_lineage(_compare(start, start, eps, found, schema, "a = b"))
    bounded = tiled.join(_kth(home, min_pts).withColumnRenamed("qid", "pid"), "pid", "left")
    bounded = bounded.select(*tiled.columns, F.coalesce("core_dist", F.lit(float(eps))).alias("reach"))
    tiles = _packed(bounded, ["copies", "reach"])
    cores = _kth(home.unionByName(_compare(tiles, tiles, eps, found, schema, "a <> b")), min_pts)
    return cut_lineage(tiled.join(cores.withColumnRenamed("qid", "pid"), "pid", "left"))


def vector_core_distances(points: DataFrame, min_pts: int, eps: float, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(id, core_dist): the distance to the ``min_pts``-th nearest other point, NULL beyond ``eps``."""
    if min_pts < 1:
        raise ValueError("min_pts must be at least 1")
    cores = _place_cores(_tiled(ball_tree(places_of(points), leaf_places)), min_pts, float(eps))
    return points.select("id").join(_with_places(points, cores.select("vector", "core_dist")), "id", "left")


def vector_labels(points: DataFrame, min_pts: int, eps: float, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """(id, core_dist, is_core, cluster_id), as ``density_labels`` gives them, for vectors of any number of axes.

    Core places are connected inside each tile first; what is connected there is one vertex of the links between tiles.
    """
    if min_pts < 1:
        raise ValueError("min_pts must be at least 1")
    eps = float(eps)
    places = _place_cores(_tiled(ball_tree(places_of(points), leaf_places)), min_pts, eps)
    core, links = places.where("core_dist is not null"), "src long, dst long"
    alone = _packed(core.withColumn("vertex", F.col("pid")), ["vertex"])
    local = _compare(alone, alone, eps, _found_links(eps), links, "a = b").toDF("pid", "vertex")
    core = cut_lineage(core.join(local, "pid", "left").withColumn("vertex", F.coalesce("vertex", "pid")))
    tiles = _packed(core, ["vertex"])
    edges = cut_lineage(_compare(tiles, tiles, eps, _found_links(eps), links, "a < b").distinct())
    named = connected_components(edges, core.select(F.col("vertex").alias("id")))
    # vertices are named by members: a cluster takes the least id of all its members
    least = core.join(named.toDF("vertex", "component"), "vertex")
    least = cut_lineage(least.select("pid", "component"))
    ids = least.groupBy("component").agg(F.min("pid").alias("cluster_id"))
    core = cut_lineage(core.join(least.join(ids, "component").drop("component"), "pid"))
    others = _packed(places.where("core_dist is null"))
    schema = "qid long, reach_dist double, core_id long, cluster_id long"
    reached = _compare(others, _packed(core, ["core_dist", "cluster_id"]), eps, _found_border(eps), schema)
    best = F.min(F.struct("reach_dist", "core_id", "cluster_id"))
    border = reached.groupBy(F.col("qid").alias("pid")).agg(best["cluster_id"].alias("cluster_id"))
    assigned = core.select("pid", "cluster_id").unionByName(border)
    by_place = places.join(assigned, "pid", "left").select("vector", "core_dist", "cluster_id")
    found = points.select("id").join(_with_places(points, by_place), "id", "left")
    return found.select(
        "id",
        "core_dist",
        F.col("core_dist").isNotNull().alias("is_core"),
        F.coalesce("cluster_id", F.lit(NOISE)).cast("bigint").alias("cluster_id"),
    )
