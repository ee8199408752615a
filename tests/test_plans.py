"""Physical plans: what must and must not be in them."""

import pytest
from pyspark.sql import functions as F

from sparkdense.density.grid import Grid, first_cell_pairs, near_points
from sparkdense.graph import core, pagerank
from sparkdense.graph.core import Graph, motif
from sparkdense.operators.relational import smallest_per_key
from sparkdense.operators.sequence import prefix_sum
from sparkdense.plans import queries
from sparkdense.registry import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark):
    df = spark.range(2000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    return df.withColumn("core_dist", F.lit(0.1))


def test_range_joins_are_equi_joins(spark):
    grid = Grid(("x", "y"), 0.05)
    cells = grid.cells(points(spark), 0)
    for df in (first_cell_pairs(grid, cells, ordered=True), near_points(grid, points(spark), points(spark), cells)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoop" not in plan(df)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(queries()["sort_asc"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#2)]" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_retailprice:double>" in text
    dropped = plan(queries()["rel_filter_dropped_col"](spark, sf_dir))
    assert "EqualTo(p_brand,Brand#2)" in dropped


def test_copartitioned_join_shuffles_each_side_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()["join_copartitioned"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_prefix_sum_has_no_single_partition_window_over_rows(spark):
    df = spark.range(5000).select("id", F.col("id").alias("v"))
    text = plan(prefix_sum(df, "id", "v", blocks=4))
    windows = [line for line in text.splitlines() if "Window [" in line and "rangeframe" not in line]
    assert any("[_block" in line for line in windows)


def test_ranks_are_limited_before_the_shuffle(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = plan(smallest_per_key(orders, ["o_custkey"], ["o_totalprice", "o_orderkey"], 3))
    assert text.count("WindowGroupLimit") == 2


def test_motif_filter_prunes_edges_first(spark, sf_dir):
    vertices = spark.range(100).withColumn("age", F.col("id"))
    edges = spark.range(500).select((F.col("id") % 100).alias("src"), (F.col("id") % 97).alias("dst"))
    text = plan(motif(Graph(vertices, edges), [("a", None, "b"), ("b", None, "a")], where={"b": "age > 36"}, attributes=False))
    assert "CartesianProduct" not in text and text.count("LeftSemi") >= 1


TINY_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.mark.parametrize(
    "module, run, splits",
    [
        (pagerank, lambda edges: pagerank.pagerank(edges, rounds=2), 3),  # shares, then each round
        (core, core.directed_triangles, 1),
        (core, lambda edges: core.chains_with_label(edges, F.col("src") % 2 == 0), 2),
    ],
)
def test_a_hub_is_split_over_tasks(spark, monkeypatch, module, run, splits):
    away = spark.range(1, 8001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    back = away.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    others = spark.range(1, 4000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seen, cut = [], module.cut_lineage

    def watched(df):
        df._jdf.queryExecution().toRdd().count()  # the adaptive plan of this very frame, as its table is written by a plan of its own
        seen.append(df)
        return cut(df)

    monkeypatch.setattr(module, "cut_lineage", watched)
    for key, value in TINY_SKEW.items():
        spark.conf.set(key, value)
    try:
        run(away.unionByName(back).unionByName(others)).count()
        assert sum("skew=true" in plan(df) for df in seen) >= splits
    finally:
        for key in TINY_SKEW:
            spark.conf.unset(key)


def test_rounds_of_pagerank_share_one_shuffle_of_the_links(spark, monkeypatch):
    edges = spark.range(4000).select("id", F.explode(F.array(*[(F.col("id") * 7 + i * i) % 4000 for i in range(5)])).alias("dst"))
    seen, cut = [], pagerank.cut_lineage

    def watched(df):
        df._jdf.queryExecution().toRdd().count()
        seen.append(df)
        return cut(df)

    monkeypatch.setattr(pagerank, "cut_lineage", watched)
    for key, value in TINY_SKEW.items():
        spark.conf.set(key, value)
    try:
        pagerank.pagerank(edges.withColumnRenamed("id", "src"), rounds=10).count()
        joined = [plan(df).split("Initial Plan")[0] for df in seen if "rank" in df.columns]
        assert len(joined) == 2 and all(p.count("ReusedExchange") >= 4 for p in joined)
    finally:
        for key in TINY_SKEW:
            spark.conf.unset(key)
