"""Level-wise traversals: BFS layers, all shortest paths, list ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdense.graph.core import Graph
from sparkdense.session import cut_lineage

# Spans double every round: more rounds than this mean more elements than a 64-bit count.
MAX_DOUBLINGS = 62
# Elements beyond which lists are contracted before pointers are doubled.
CONTRACT_FROM = 500_000


def bfs_layers(graph: Graph, start: str | Column, max_layers: int | None = None) -> DataFrame:
    """(id, layer) of every vertex that the start vertices reach; the start is layer 0."""
    return _union(_layers(graph, _links(graph), start, max_layers=max_layers))


def _links(graph: Graph) -> DataFrame:
    """One edge per ordered pair, checkpointed because every layer reads it."""
    return cut_lineage(graph.edges.select("src", "dst").distinct())


def _layers(
    graph: Graph, links: DataFrame, start: str | Column, stop: str | Column | None = None, max_layers: int | None = None
) -> list[DataFrame]:
    """One checkpointed table per layer; ends at an empty layer, or at the first one with a ``stop`` vertex."""
    layers = [cut_lineage(graph.vertices.where(start).select("id", F.lit(0).alias("layer")))]
    targets = graph.vertices.where(stop).select("id") if stop is not None else None
    while True:
        if targets is not None and not layers[-1].join(targets, "id", "left_semi").isEmpty():
            return layers
        if max_layers is not None and len(layers) > max_layers:
            return layers
        frontier = layers[-1].select(F.col("id").alias("src"))
        reached = links.join(frontier, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = reached.join(_union(layers).select("id"), "id", "left_anti")
        layer = cut_lineage(fresh.withColumn("layer", F.lit(len(layers))))
        if layer.isEmpty():
            return layers
        layers.append(layer)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def shortest_paths(graph: Graph, start: str | Column, target: str | Column, max_length: int = 10) -> DataFrame:
    """All shortest paths from start vertices to target vertices, as one array column ``path`` of ids.

    Layers are found first, then followed back from the targets that were hit, so paths are only listed over
    edges that lie on some shortest path. Empty when no target lies within ``max_length`` edges.
    """
    links = _links(graph)
    layers = _layers(graph, links, start, target, max_length)
    hits = layers[-1].join(graph.vertices.where(target).select("id"), "id", "left_semi").select("id")
    steps: list[DataFrame] = []
    needed = cut_lineage(hits)
    for layer in reversed(layers[:-1]):
        step = links.join(needed.withColumnRenamed("id", "dst"), "dst", "left_semi")
        step = cut_lineage(step.join(layer.select(F.col("id").alias("src")), "src", "left_semi"))
        steps.append(step)
        needed = step.select(F.col("src").alias("id")).distinct()
    paths = needed.select("id", F.array("id").alias("path"))
    for step in reversed(steps):
        paths = paths.join(step, paths.id == step.src).select(
            F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")
        )
    return paths.select("path")


def list_rank(links: DataFrame, end: int = -1) -> DataFrame:
    """(id, rank): the number of links from each element to the last one of its list.

    Long lists are contracted first: each round splices out about a quarter of the elements, no two of them neighbours,
    so all rounds together move a fixed multiple of the rows. What is left is ranked by doubling, then the elements
    come back in reverse order, each ranked by its successor. Elements of a broken list, which leads to no last
    element, have no rank and are left out; a cycle raises.
    """
    # d counts the links from src to dst; the last element has none, and is done from the start.
    d = F.when(F.col("dst") == end, 0).otherwise(1).cast("bigint")
    state = cut_lineage(links.select("src", "dst", d.alias("d"), (F.col("dst") == end).alias("done")))
    left = state.count()
    if left <= CONTRACT_FROM or not _one_link_each(state):
        return _doubled(state)
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ends, live, spliced = state.where("done"), state.where("not done"), []
    while True:
        before, left = left, live.count()
        if left <= CONTRACT_FROM or (spliced and left > 0.95 * before):  # loops do not shrink any more
            break
        head, tail = (F.xxhash64(F.col(c), F.lit(len(spliced))).bitwiseAND(F.lit(1)) == 1 for c in ("src", "dst"))
        gone = cut_lineage(live.where(head & ~tail).select("src", "dst", "d"))
        ahead = gone.select(F.col("src").alias("dst"), F.col("dst").alias("_dst"), F.col("d").alias("_d"))
        # only an element whose successor has the coin of a spliced one can have lost it
        kept = live.where(~head | tail)
        moved = kept.where(tail).join(ahead, "dst", "left").select(
            "src", F.coalesce("_dst", "dst").alias("dst"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), "done"
        )
        live = cut_lineage(kept.where(~tail).unionByName(moved).coalesce(tasks))
        spliced.append(gone)
    ranks = _doubled(cut_lineage(ends.unionByName(live)))
    for gone in reversed(spliced):
        found = gone.join(ranks.withColumnRenamed("id", "dst"), "dst")
        back = found.select(F.col("src").alias("id"), (F.col("rank") + F.col("d")).alias("rank"))
        ranks = cut_lineage(ranks.unionByName(back).coalesce(tasks))
    return ranks


def _one_link_each(state: DataFrame) -> bool:
    """Whether no element has two links and no end is null, as contraction needs."""
    counted = state.groupBy("src").agg(F.count("*").alias("n"), F.count("dst").alias("known"))
    return counted.where("src IS NULL OR n > 1 OR known < n").isEmpty()


def _doubled(state: DataFrame) -> DataFrame:
    """Ranks by pointer jumping: each round doubles the span of every pointer, so n elements take log2(n) rounds.

    Pointers that reached the last element leave the working set.
    """
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rounds = 0
    while not (live := state.where("not done")).isEmpty():
        rounds += 1
        if rounds > MAX_DOUBLINGS:
            raise ValueError("the links contain a cycle")
        ahead = state.select(F.col("src").alias("dst"), F.col("dst").alias("_dst"), F.col("d").alias("_d"), F.col("done").alias("_done"))
        moved = live.join(ahead, "dst").select(
            "src", F.col("_dst").alias("dst"), (F.col("d") + F.col("_d")).alias("d"), F.col("_done").alias("done")
        )
        # Elements that are done keep clear of the join: they all share one end and would be one hot key.
        state = cut_lineage(state.where("done").unionByName(moved).coalesce(tasks))
    return state.select(F.col("src").alias("id"), F.col("d").alias("rank"))
