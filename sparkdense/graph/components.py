"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdense.session import cut_lineage


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component) with the least id of each component; ``vertices`` adds those without an edge.

    Each round replaces neighbours by the least neighbour. Least values are partially aggregated before the
    shuffle and checkpointed, one row per vertex, so that both sides of the join back are plain shuffles and the
    adaptive skew join can split a hub's edges over tasks. The number of rounds grows with the logarithm of the
    diameter.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = cut_lineage(links.distinct())
    while not _is_star_forest(links):
        links = cut_lineage(_small_star(_large_star(links)))
    labels = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = labels.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    labels = labels.unionByName(roots)
    if vertices is None:
        return labels
    return vertices.select("id").distinct().join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of u to the least vertex of u's neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect u and its smaller neighbours to the least of them; every link has u > v."""
    links = cut_lineage(links)
    least = cut_lineage(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(links: DataFrame) -> bool:
    """Every u has one link, and no v has a link of its own: nothing is left to move."""
    ends = F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("own")), F.struct(F.col("v").alias("id"), F.lit(0).alias("own"))
    )
    roles = links.select(F.explode(ends).alias("e")).groupBy("e.id").agg(
        F.sum("e.own").alias("own"), F.min("e.own").alias("least")
    )
    return roles.where("own > 1 OR (own = 1 AND least = 0)").isEmpty()
