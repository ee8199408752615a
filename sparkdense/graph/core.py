"""Property graphs as two DataFrames: degrees, triplets, subgraphs and motifs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdense.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    """``vertices`` has a column ``id``, ``edges`` has ``src`` and ``dst``; references are not checked."""

    vertices: DataFrame
    edges: DataFrame

    def out_degrees(self) -> DataFrame:
        """Vertices without an outgoing edge are absent."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))

    def zero_in_degree(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")

    def triplets(self) -> DataFrame:
        """Columns ``src``, ``edge``, ``dst``, each a struct with all attributes."""
        return motif(self, [("src", "edge", "dst")]).select("src", "edge", "dst")

    def filtered(self, vertices: str | Column, edges: str | Column, drop_dangling: bool = True) -> Graph:
        """The vertices and edges that pass; dangling edges are removed unless asked to stay."""
        kept = self.vertices.where(vertices)
        links = self.edges.where(edges)
        if drop_dangling:
            ids = kept.select("id")
            links = links.join(ids, links.src == ids.id, "left_semi")
            links = links.join(ids, links.dst == ids.id, "left_semi")
        return Graph(kept, links)

    def incident_to(self, edges: DataFrame) -> Graph:
        """The subgraph of the given edges and the vertices that they touch."""
        touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(self.vertices.join(touched, "id", "left_semi"), edges)


Step = tuple[str, str | None, str]


def motif(
    graph: Graph,
    pattern: Sequence[Step],
    absent: Sequence[tuple[str, str]] = (),
    where: dict[str, str] | None = None,
    attributes: bool = True,
) -> DataFrame:
    """All matches of a path pattern.

    ``pattern`` lists edges as (source name, edge name or None, target name); names that repeat are the same
    vertex. ``absent`` lists (source, target) pairs without an edge between them. ``where`` holds one predicate per
    vertex name; it prunes the edges before they are joined. Vertices come as structs, or as bare ids with
    ``attributes=False``; named edges come as structs.
    """
    if not pattern:
        raise ValueError("a pattern needs at least one edge that exists: absent edges only remove matches")
    where = where or {}
    seen: list[str] = []
    matches: DataFrame | None = None
    for source, edge, target in pattern:
        columns = [F.col("src").alias(source)]
        if target != source:
            columns.append(F.col("dst").alias(target))
        if edge:
            columns.append(F.struct(*[F.col(c) for c in graph.edges.columns]).alias(edge))
        links = graph.edges if target != source else graph.edges.where("src = dst")
        step = links.select(*columns)
        for name in dict.fromkeys((source, target)):
            if name in where:
                passing = graph.vertices.where(where[name]).select(F.col("id").alias(name))
                step = step.join(passing, name, "left_semi")
        shared = [name for name in dict.fromkeys((source, target)) if name in seen]
        if matches is None:
            matches = step
        elif shared:
            matches = matches.join(step, shared)
        else:
            raise ValueError(f"edge {source}->{target} shares no vertex with the edges before it")
        seen += [name for name in dict.fromkeys((source, target)) if name not in seen]
    for source, target in absent:
        if source not in seen or target not in seen:
            raise ValueError("an absent edge must join two vertices of the pattern")
        existing = graph.edges.select(F.col("src").alias(source), F.col("dst").alias(target)).distinct()
        matches = matches.join(existing, [source, target], "left_anti")
    if attributes:
        for name in seen:
            vertex = graph.vertices.select(
                F.col("id").alias(name), F.struct(*[F.col(c) for c in graph.vertices.columns]).alias("_vertex")
            )
            matches = matches.join(vertex, name).drop(name).withColumnRenamed("_vertex", name)
    return matches


def directed_triangles(edges: DataFrame) -> DataFrame:
    """All rotations (a, b, c) of directed three-cycles a -> b -> c -> a over distinct vertices.

    Every undirected pair is oriented from the vertex of lower degree to the other, so that no vertex has more
    than sqrt(2E) outgoing pairs; a hub never joins with itself.
    """
    pairs = (
        edges.where("src <> dst")
        .select(
            F.least("src", "dst").alias("p"),
            F.greatest("src", "dst").alias("q"),
            (F.col("src") < F.col("dst")).alias("forward"),
        )
        .groupBy("p", "q")
        .agg(F.max("forward").alias("pq"), F.max(~F.col("forward")).alias("qp"))
    )
    pairs = cut_lineage(pairs)  # read twice; with the degrees cut, too, the skew join can split a hub's pairs
    degrees = pairs.select(F.explode(F.array("p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    degrees = cut_lineage(degrees)
    ranked = pairs.join(degrees.select(F.col("id").alias("p"), F.col("degree").alias("dp")), "p").join(
        degrees.select(F.col("id").alias("q"), F.col("degree").alias("dq")), "q"
    )
    straight = F.struct("dp", "p") < F.struct(F.col("dq").alias("dp"), F.col("q").alias("p"))

    def pick(a: str, b: str) -> Column:
        return F.when(straight, F.col(a)).otherwise(F.col(b))

    oriented = ranked.select(
        pick("p", "q").alias("u"),
        pick("q", "p").alias("v"),
        pick("dq", "dp").alias("dv"),
        pick("pq", "qp").alias("uv"),
        pick("qp", "pq").alias("vu"),
    )
    oriented = cut_lineage(oriented)  # read three times below
    first = oriented
    second = oriented.select(
        "u", F.col("v").alias("w"), F.col("dv").alias("dw"), F.col("uv").alias("uw"), F.col("vu").alias("wu")
    )
    ordered = F.struct("dv", "v") < F.struct(F.col("dw").alias("dv"), F.col("w").alias("v"))
    possible = (F.col("uv") & F.col("wu")) | (F.col("uw") & F.col("vu"))
    wedges = first.join(second, "u").where(ordered & possible)
    closing = oriented.select(
        F.col("u").alias("v"), F.col("v").alias("w"), F.col("uv").alias("vw"), F.col("vu").alias("wv")
    )
    closed = wedges.join(closing, ["v", "w"])

    def rotations(a: str, b: str, c: str) -> Column:
        return F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("c"))
                         for x, y, z in ((a, b, c), (b, c, a), (c, a, b))])

    around = closed.where(F.col("uv") & F.col("vw") & F.col("wu")).select(F.explode(rotations("u", "v", "w")).alias("t"))
    back = closed.where(F.col("uw") & F.col("wv") & F.col("vu")).select(F.explode(rotations("u", "w", "v")).alias("t"))
    return around.unionByName(back).select("t.a", "t.b", "t.c")


def chains_with_label(edges: DataFrame, is_match: Column) -> DataFrame:
    """Per start vertex, the number of chains a -> b -> c -> d with a != d and at least two matching edges.

    Counts are carried backwards along the chain, one aggregate per step, instead of listing the chains; the
    chains that return to their start are labelled triangles, which are counted and taken off. Self-loops are
    left out: with them a chain could return in other ways. Links and the counts that are carried back are
    checkpointed, so the edges are read once and the skew join can split the links of a hub.
    """
    links = edges.where("src <> dst").groupBy("src", "dst").agg(
        F.count_if(is_match).alias("hit"), F.count_if(~is_match).alias("miss")
    )
    links = cut_lineage(links)
    last = cut_lineage(links.groupBy("src").agg(F.sum("hit").alias("h1"), F.sum("miss").alias("m1")))
    onto_last = links.join(last.withColumnRenamed("src", "dst"), "dst")
    last_two = onto_last.groupBy("src").agg(
        F.sum(F.col("hit") * F.col("h1")).alias("two"),
        F.sum(F.col("hit") * F.col("m1") + F.col("miss") * F.col("h1")).alias("one"),
    )
    last_two = cut_lineage(last_two)
    onto_two = links.join(last_two.withColumnRenamed("src", "dst"), "dst")
    total = onto_two.groupBy(F.col("src").alias("a")).agg(
        F.sum(F.col("hit") * (F.col("one") + F.col("two")) + F.col("miss") * F.col("two")).alias("n")
    )

    def named(x: str, y: str, i: int) -> DataFrame:
        return links.select(
            F.col("src").alias(x), F.col("dst").alias(y), F.col("hit").alias(f"h{i}"), F.col("miss").alias(f"m{i}")
        )

    returning = directed_triangles(links)
    for i, (x, y) in enumerate((("a", "b"), ("b", "c"), ("c", "a")), start=1):
        returning = returning.join(named(x, y, i), [x, y])
    matches = F.expr("h1 * h2 * h3 + h1 * h2 * m3 + h1 * m2 * h3 + m1 * h2 * h3")
    closed = returning.groupBy("a").agg(F.sum(matches).alias("closed"))
    return (
        total.join(closed, "a", "left")
        .select("a", (F.col("n") - F.coalesce("closed", F.lit(0))).alias("n"))
        .where("n > 0")
    )
