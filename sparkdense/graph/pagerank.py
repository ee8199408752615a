"""PageRank without normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdense.session import cut_lineage

DAMPING = 0.85
# Rounds that share one plan, and so one shuffle of the links. Longer plans would only multiply the planner's estimates.
SPAN = 5


def pagerank(edges: DataFrame, rounds: int = 10, keep_sources: bool = False) -> DataFrame:
    """(id, rank) after ``rounds`` rounds of ``0.15 + 0.85 * sum(rank / out_degree)``.

    Ranks start at 1.0 for every page with an outgoing link; repeated links count repeatedly. A page without an
    incoming link drops out after the first round, unless ``keep_sources`` gives it the floor of 0.15.
    """
    links = cut_lineage(edges.groupBy("src", "dst").agg(F.count("*").alias("k")))
    degrees = cut_lineage(links.groupBy("src").agg(F.sum("k").alias("out_degree")))
    shares = cut_lineage(
        links.join(degrees, "src").select("src", "dst", (F.col("k") / F.col("out_degree")).alias("share"))
    )
    ranks = degrees.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    pages = cut_lineage(shares.select(F.explode(F.array("src", "dst")).alias("id")).distinct()) if keep_sources else None
    span = min(SPAN, -(-rounds // 2))
    for i in range(1, rounds + 1):
        # links and ranks meet by the id in a struct, which no aggregate by page has dealt out already: so both sides are
        # plain shuffles and a hub's links can be split
        given = shares.join(ranks, F.struct("src") == F.struct("id"))
        sums = given.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
        if pages is not None:
            sums = pages.join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
        ranks = sums.select("id", (F.lit(1 - DAMPING) + F.lit(DAMPING) * F.col("s")).alias("rank"))
        if i % span == 0 or i == rounds:
            ranks = cut_lineage(ranks)
    return ranks
