"""Pointwise mutual information of word pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdense.functions.columns import words
from sparkdense.session import broadcast_if_small, cut_lineage


def adjacent_pairs(df: DataFrame, text: str) -> DataFrame:
    """One row (first, second) per pair of neighbouring words of each text."""
    tokens = df.select(words(text).alias("w"))  # a filter on w would be pushed below and split each text once more
    n = F.greatest(F.size("w") - 1, F.lit(0))
    return tokens.select(F.inline(F.arrays_zip(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n)))).toDF("first", "second")


def pmi(pairs: DataFrame, min_count: int, top: int | None = None) -> DataFrame:
    """``log2(f * N / (f_first * f_second))`` of every pair seen at least ``min_count`` times.

    Marginals and N count all pairs, rare ones included. They come from the pair counts, so the text is scanned
    and shuffled once. ``top`` keeps the strongest pairs, ordered by (pmi, first, second) descending.
    """
    counts = cut_lineage(pairs.groupBy("first", "second").agg(F.count("*").alias("n")))
    frequent = counts.where(F.col("n") >= min_count)
    firsts = counts.groupBy("first").agg(F.sum("n").alias("n_first"))
    seconds = counts.groupBy("second").agg(F.sum("n").alias("n_second"))
    total = counts.agg(F.sum("n")).scalar()
    score = F.log2(F.col("n") * F.col("n_total") / (F.col("n_first") * F.col("n_second")))
    scored = (
        firsts.join(broadcast_if_small(frequent), "first")
        .join(seconds, "second")
        .withColumn("n_total", total)
        .select("first", "second", score.alias("pmi"))
    )
    strongest = scored.orderBy(F.desc("pmi"), F.desc("first"), F.desc("second"))
    return strongest if top is None else strongest.limit(top)
