"""Graph operators on a small map of places and ways, and components on random graphs and hubs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkdense.graph import paths
from sparkdense.graph.components import connected_components
from sparkdense.graph.core import Graph, chains_with_label, directed_triangles, motif
from sparkdense.graph.pagerank import pagerank
from sparkdense.graph.paths import bfs_layers, list_rank, shortest_paths

PLACES = [("mill", 12), ("ford", 3), ("quay", 1), ("loch", 25), ("glen", 40), ("moor", 55), ("isle", 7), ("crag", 90),
          ("dune", 2)]
WAYS = [("mill", "ford", "road"), ("ford", "mill", "road"), ("ford", "quay", "road"), ("quay", "mill", "ferry"), ("quay", "isle", "ferry"),
        ("isle", "quay", "ferry"), ("isle", "loch", "ferry"), ("loch", "glen", "road"), ("glen", "moor", "road"), ("moor", "loch", "road"),
        ("moor", "crag", "road"), ("mill", "glen", "road"), ("dune", "isle", "ferry")]
PAIRS = {(a, b) for a, b, _ in WAYS}
HEIGHT = dict(PLACES)


@pytest.fixture(scope="module")
def places(spark):
    return Graph(
        spark.createDataFrame(PLACES, "id string, height int"),
        spark.createDataFrame(WAYS, "src string, dst string, kind string"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def walks(steps):
    found = [[w] for w in WAYS]
    for _ in range(steps - 1):
        found = [[*walk, w] for walk in found for w in WAYS if w[0] == walk[-1][1]]
    return found


def layers_from(start):
    layers, edge = {start: 0}, {start}
    while edge:
        edge = {b for a, b in PAIRS if a in edge} - set(layers)
        layers |= dict.fromkeys(edge, max(layers.values()) + 1)
    return layers


def test_degrees(places):
    assert dict(rows(places.out_degrees())) == Counter(a for a, _, _ in WAYS)
    assert dict(rows(places.in_degrees())) == Counter(b for _, b, _ in WAYS)
    assert [r["id"] for r in places.zero_in_degree().collect()] == ["dune"]


def test_motifs(places):
    mutual = [("a", None, "b"), ("b", None, "a")]
    both = sorted((a, b) for a, b in PAIRS if (b, a) in PAIRS)
    assert len(both) == 4 and rows(motif(places, mutual, attributes=False)) == both
    high = [(a, b) for a, b in both if HEIGHT[b] > 5]
    found = motif(places, mutual).where("b.height > 5").select("a.id", F.col("b.id").alias("other"))
    assert rows(found) == high
    assert rows(motif(places, mutual, where={"b": "height > 5"}, attributes=False).select("a", "b")) == high
    triangle = [("a", None, "b"), ("b", None, "c"), ("c", None, "a")]
    expected = sorted((a, b, c) for a, b in PAIRS for x, c in PAIRS if x == b and (c, a) in PAIRS)
    assert len(expected) == 6
    assert rows(motif(places, triangle, attributes=False).select("a", "b", "c")) == expected
    assert rows(directed_triangles(places.edges)) == expected
    oneway = motif(places, [("a", None, "b")], absent=[("b", "a")], attributes=False)
    assert rows(oneway.select("a", "b")) == sorted(PAIRS - set(both))
    with pytest.raises(ValueError):
        motif(places, [], absent=[("a", "b")])


def test_chains(places):
    chain = motif(places, [("a", "e1", "b"), ("b", "e2", "c"), ("c", "e3", "d")], attributes=False)
    ferries = sum(F.when(F.col(f"{e}.kind") == "ferry", 1).otherwise(0) for e in ("e1", "e2", "e3"))
    found = chain.where((ferries >= 2) & (F.col("a") != F.col("d"))).select("a", "b", "c", "d")
    expected = sorted(
        (w[0][0], w[1][0], w[2][0], w[2][1]) for w in walks(3) if sum(k == "ferry" for *_, k in w) >= 2 and w[0][0] != w[2][1]
    )
    assert expected and rows(found) == expected
    counted = chains_with_label(places.edges, F.col("kind") == "ferry")
    assert dict(rows(counted)) == Counter(a for a, *_ in expected)


def test_subgraphs(places):
    kept = sorted((a, b) for a, b, k in WAYS if k == "road" and HEIGHT[a] > 10 and HEIGHT[b] > 10)
    assert rows(places.filtered("height > 10", "kind = 'road'").edges.select("src", "dst")) == kept
    dangling = places.filtered("height > 10", "kind = 'road'", drop_dangling=False).edges
    assert dangling.count() == sum(k == "road" for *_, k in WAYS)
    downwards = motif(places, [("a", "e", "b")]).where("e.kind = 'ferry' and a.height > b.height").select("e.*")
    down = sorted((a, b) for a, b, k in WAYS if k == "ferry" and HEIGHT[a] > HEIGHT[b])
    assert down and rows(downwards.select("src", "dst")) == down
    assert [r[0] for r in rows(places.incident_to(downwards).vertices.select("id"))] == sorted({v for pair in down for v in pair})
    assert places.triplets().count() == len(WAYS)


def test_paths(places):
    layers = layers_from("ford")
    assert dict(rows(bfs_layers(places, "id = 'ford'"))) == layers and "dune" not in layers
    targets = [v for v in HEIGHT if HEIGHT[v] > 20 and v in layers]
    nearest = min(layers[v] for v in targets)
    expected = sorted([w[0][0], *(b for _, b, _ in w)] for w in walks(nearest) if w[0][0] == "ford" and w[-1][1] in targets)
    assert sorted(r["path"] for r in shortest_paths(places, "id = 'ford'", "height > 20").collect()) == expected
    two = shortest_paths(places, "id = 'quay'", "id = 'glen'").count()
    assert two == sum(w[0][0] == "quay" and w[-1][1] == "glen" for w in walks(layers_from("quay")["glen"]))
    assert shortest_paths(places, "id = 'mill'", "id = 'dune'").count() == 0
    assert shortest_paths(places, "id = 'mill'", "id = 'moor'", max_length=1).count() == 0


def test_list_rank(spark):
    order = [40, 7, 23, 91, 5, 66, 12]
    links = spark.createDataFrame([*zip(order, order[1:]), (order[-1], -1)], "src bigint, dst bigint")
    assert dict(rows(list_rank(links))) == {v: len(order) - 1 - i for i, v in enumerate(order)}


def test_long_lists_are_contracted(spark, monkeypatch):
    """Several lists, a broken one and single elements: right ranks, and no row for each element and round of doubling."""
    rng = random.Random(4)
    ids, expected, links = rng.sample(range(10**6), 1500), {}, []
    for start, stop in ((0, 1100), (1100, 1400), (1400, 1401)):
        own = ids[start:stop]
        links += [*zip(own, own[1:]), (own[-1], -1)]
        expected |= {v: len(own) - 1 - i for i, v in enumerate(own)}
    links += [*zip(ids[1401:], ids[1402:]), (ids[-1], 10**7)]
    written, cut = [], paths.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(paths, "cut_lineage", counted)
    monkeypatch.setattr(paths, "CONTRACT_FROM", 100)
    got = rows(list_rank(spark.createDataFrame(links, "src bigint, dst bigint")))
    assert got == sorted(expected.items())
    assert sum(written) < 12 * len(links)
    doubled = [(1, 2), (1, 2), (2, 3), (3, -1)]
    monkeypatch.setattr(paths, "CONTRACT_FROM", 1)
    assert rows(list_rank(spark.createDataFrame(doubled, "src bigint, dst bigint"))) == [(1, 2), (1, 2), (2, 1), (3, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(1000, v) for v in range(1001, 1100)] + [(v, v + 1) for v in range(2000, 2060)]
    parent = {v: v for v in [*range(120), *range(1000, 1100), *range(2000, 2061)]}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    vertices = spark.createDataFrame([(v,) for v in parent], "id bigint")
    found = dict(rows(connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), vertices)))
    assert found == {v: root(v) for v in parent}


def test_label_merge(spark):
    """Points that several leaves have put into clusters of their own: clusters that share a point become one."""
    chain = [(10 * leaf + i, leaf, 7) for leaf in range(4) for i in (0, 10)]  # each leaf shares a point with the next
    apart = [(100, 0, 8), (101, 0, 8), (102, 2, 9), (101, 2, 9), (200, 3, 5)]
    labels = spark.createDataFrame(chain + apart, "id int, leaf int, cluster int")
    named = labels.select("id", F.struct("leaf", "cluster").alias("label"))
    home = named.groupBy("id").agg(F.min("label").alias("src"))
    edges = named.join(home, "id").select("src", F.col("label").alias("dst"))
    merged = connected_components(edges, named.select(F.col("label").alias("id")))
    found = {tuple(r["id"]): tuple(r["component"]) for r in merged.collect()}
    assert found == {(0, 7): (0, 7), (1, 7): (0, 7), (2, 7): (0, 7), (3, 7): (0, 7), (0, 8): (0, 8), (2, 9): (0, 8), (3, 5): (3, 5)}


def test_pagerank(spark):
    links = {"n": ["o", "p", "q"], "o": ["p"], "p": ["n", "o"], "q": ["o"], "r": ["q", "n"]}
    edges = spark.createDataFrame([(a, b) for a, targets in links.items() for b in targets], "src string, dst string")
    ranks = dict.fromkeys(links, 1.0)
    for _ in range(10):
        sums: dict = {}
        for page, targets in links.items():
            for target in targets if page in ranks else ():
                sums[target] = sums.get(target, 0.0) + ranks[page] / len(targets)
        ranks = {page: 0.15 + 0.85 * s for page, s in sums.items()}
    assert dict(rows(pagerank(edges))) == pytest.approx(ranks)
    kept = dict(rows(pagerank(edges, keep_sources=True)))
    assert kept["r"] == pytest.approx(0.15)
