"""Graph queries. Vertices are parts; an edge leads from the part of one order line to the part of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.graph.components import connected_components
from sparkdense.graph.core import Graph, chains_with_label, directed_triangles, motif
from sparkdense.graph.pagerank import pagerank
from sparkdense.graph.paths import bfs_layers, list_rank, shortest_paths
from sparkdense.operators.sequence import successors
from sparkdense.registry import query, table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]

GRAPH_CTES = """
lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem),
e AS (SELECT DISTINCT src, dst, relationship FROM (
        SELECT l_partkey AS src, l_returnflag AS relationship, lead(l_partkey) OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS dst FROM lines)
      WHERE dst IS NOT NULL AND src <> dst),
v AS (SELECT p_partkey AS id, p_name AS name, p_size AS age FROM part),
p AS (SELECT DISTINCT src, dst FROM e)
"""
GRAPH_SQL = "WITH " + GRAPH_CTES
RECURSIVE_SQL = "WITH RECURSIVE " + GRAPH_CTES


def part_graph(spark: SparkSession, sf: str) -> Graph:
    linked = successors(table(spark, sf, "lineitem").select(*ORDER), ORDER, [], distinct=True)
    edges = linked.where((F.col("next.l_orderkey") == F.col("l_orderkey")) & (F.col("next.l_partkey") != F.col("l_partkey")))
    edges = edges.select(
        F.col("l_partkey").alias("src"), F.col("next.l_partkey").alias("dst"), F.col("l_returnflag").alias("relationship")
    ).distinct()
    vertices = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("age")
    )
    return Graph(vertices, edges)


def simple(graph: Graph) -> Graph:
    """The same graph with one edge per ordered pair."""
    return Graph(graph.vertices, graph.edges.select("src", "dst").distinct())


@query(
    "graph_degrees",
    GRAPH_SQL
    + """SELECT id, out_degree, in_degree FROM (SELECT src AS id, count(*) AS out_degree FROM e GROUP BY 1)
         FULL JOIN (SELECT dst AS id, count(*) AS in_degree FROM e GROUP BY 1) USING (id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = part_graph(spark, sf)
    return graph.out_degrees().join(graph.in_degrees(), "id", "full_outer")


@query(
    "graph_triplets",
    GRAPH_SQL
    + """SELECT s.id AS src_id, s.age AS src_age, e.relationship, d.id AS dst_id, d.age AS dst_age
         FROM e JOIN v s ON e.src = s.id JOIN v d ON e.dst = d.id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    triplets = part_graph(spark, sf).triplets()
    return triplets.select(
        F.col("src.id").alias("src_id"),
        F.col("src.age").alias("src_age"),
        "edge.relationship",
        F.col("dst.id").alias("dst_id"),
        F.col("dst.age").alias("dst_age"),
    )


@query("graph_mutual", GRAPH_SQL + "SELECT x.src AS a, x.dst AS b FROM p x JOIN p y ON x.src = y.dst AND x.dst = y.src")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return motif(simple(part_graph(spark, sf)), [("a", None, "b"), ("b", None, "a")], attributes=False)


@query(
    "graph_triangles",
    GRAPH_SQL
    + """SELECT x.src AS a, y.src AS b, z.src AS c FROM p x JOIN p y ON x.dst = y.src
         JOIN p z ON y.dst = z.src AND z.dst = x.src""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return directed_triangles(part_graph(spark, sf).edges)


@query(
    "graph_oneway",
    GRAPH_SQL + "SELECT src AS a, dst AS b FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.src = x.dst AND y.dst = x.src)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return motif(simple(part_graph(spark, sf)), [("a", None, "b")], absent=[("b", "a")], attributes=False)


@query(
    "graph_chain4",
    GRAPH_SQL
    + """SELECT x.src AS a, count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src
         WHERE x.src <> z.dst AND (x.relationship = 'A')::INT + (y.relationship = 'A')::INT + (z.relationship = 'A')::INT >= 2
         GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return chains_with_label(part_graph(spark, sf).edges, F.col("relationship") == "A")


@query(
    "graph_motif_filter",
    GRAPH_SQL
    + """SELECT x.src AS a, x.dst AS b, v.age AS b_age FROM p x JOIN p y ON x.src = y.dst AND x.dst = y.src
         JOIN v ON v.id = x.dst WHERE v.age > 36""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = simple(part_graph(spark, sf))
    found = motif(graph, [("a", None, "b"), ("b", None, "a")], where={"b": "age > 36"})
    return found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("b.age").alias("b_age"))


@query(
    "graph_zero_indegree",
    GRAPH_SQL + "SELECT id, name, age FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE dst = id AND relationship = 'R')",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = part_graph(spark, sf)
    return Graph(graph.vertices, graph.edges.where("relationship = 'R'")).zero_in_degree()


@query(
    "graph_subgraph",
    GRAPH_SQL
    + """SELECT src, dst, relationship FROM e WHERE relationship = 'A'
         AND src IN (SELECT id FROM v WHERE age > 30) AND dst IN (SELECT id FROM v WHERE age > 30)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return part_graph(spark, sf).filtered("age > 30", "relationship = 'A'").edges


@query(
    "graph_subgraph_by_edges",
    GRAPH_SQL
    + """, f AS (SELECT e.* FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id WHERE relationship = 'N' AND a.age > b.age)
         SELECT id, name, age FROM v WHERE id IN (SELECT src FROM f) OR id IN (SELECT dst FROM f)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = part_graph(spark, sf)
    follows = Graph(graph.vertices, graph.edges.where("relationship = 'N'"))
    downwards = motif(follows, [("a", "e", "b")]).where("a.age > b.age").select("e.*")
    return graph.incident_to(downwards).vertices


@query(
    "graph_components",
    RECURSIVE_SQL
    + """, m AS (SELECT x.src, x.dst FROM p x JOIN p y ON x.src = y.dst AND x.dst = y.src),
         r AS (SELECT id, id AS component FROM v UNION SELECT m.dst, r.component FROM r JOIN m ON r.id = m.src)
         SELECT id, min(component) AS component FROM r GROUP BY id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = simple(part_graph(spark, sf))
    mutual = motif(graph, [("a", None, "b"), ("b", None, "a")], attributes=False)
    return connected_components(mutual.select(F.col("a").alias("src"), F.col("b").alias("dst")), graph.vertices)


@query(
    "graph_bfs_layers",
    RECURSIVE_SQL
    + """, r AS (SELECT id, 0 AS layer FROM v WHERE id = (SELECT min(id) FROM v)
                 UNION SELECT p.dst, layer + 1 FROM r JOIN p ON r.id = p.src WHERE layer < 20)
         SELECT id, min(layer) AS layer FROM r GROUP BY id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = part_graph(spark, sf)
    first = graph.vertices.agg(F.min("id")).first()[0]
    return bfs_layers(graph, F.col("id") == first)


@query(
    "graph_shortest_paths",
    RECURSIVE_SQL
    + """, r AS (SELECT id, id::VARCHAR AS path, 0 AS hops FROM v WHERE id = (SELECT min(id) FROM v)
                 UNION ALL SELECT p.dst, path || '-' || p.dst, hops + 1 FROM r JOIN p ON r.id = p.src
                 WHERE hops < 10 AND NOT EXISTS (SELECT 1 FROM r JOIN v USING (id) WHERE age > 48)),
         hit AS (SELECT path, hops FROM r JOIN v USING (id) WHERE age > 48)
         SELECT path FROM hit WHERE hops = (SELECT min(hops) FROM hit)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    graph = part_graph(spark, sf)
    first = graph.vertices.agg(F.min("id")).first()[0]
    paths = shortest_paths(graph, F.col("id") == first, "age > 48")
    return paths.select(F.array_join("path", "-").alias("path"))


@query(
    "graph_list_rank",
    "SELECT event_id AS id, count(*) OVER () - row_number() OVER (ORDER BY event_id) AS rank FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = successors(table(spark, sf, "events").select("event_id"), ["event_id"], [])
    links = events.select(
        F.col("event_id").alias("src"), F.coalesce("next.event_id", F.lit(-1)).cast("bigint").alias("dst")
    )
    return list_rank(links)


def pagerank_sql(rounds: int, keep_sources: bool) -> str:
    parts = [
        GRAPH_SQL,
        ", s AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e)",
        ", pages AS (SELECT src AS id FROM e UNION SELECT dst FROM e)",
        ", r0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS rank FROM e)",
    ]
    for i in range(rounds):
        if keep_sources:
            parts.append(
                f", r{i + 1} AS (SELECT id, 0.15 + 0.85 * coalesce(s, 0) AS rank FROM pages LEFT JOIN (SELECT dst AS id, "
                f"sum(share * rank) AS s FROM s JOIN r{i} ON src = r{i}.id GROUP BY 1) USING (id))"
            )
        else:
            parts.append(
                f", r{i + 1} AS (SELECT dst AS id, 0.15 + 0.85 * sum(share * rank) AS rank "
                f"FROM s JOIN r{i} ON src = r{i}.id GROUP BY 1)"
            )
    return "".join(parts) + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query("graph_pagerank", pagerank_sql(10, False))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pagerank(part_graph(spark, sf).edges).select("id", F.round("rank", 6).alias("rank"))


@query("graph_pagerank_keep_sources", pagerank_sql(10, True))
def _(spark: SparkSession, sf: str) -> DataFrame:
    ranks = pagerank(part_graph(spark, sf).edges, keep_sources=True)
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query("graph_pagerank_top5", pagerank_sql(10, False) + " ORDER BY rank DESC, id LIMIT 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ranks = pagerank(part_graph(spark, sf).edges).select("id", F.round("rank", 6).alias("rank"))
    return ranks.orderBy(F.desc("rank"), "id").limit(5)
