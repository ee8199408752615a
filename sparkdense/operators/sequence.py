"""Operators on ordered sequences: positions, prefix sums, best sub-array, selection by rank.

A sequence is a table with a unique numeric order column. It is cut into blocks of bounded size at approximate
quantiles of that column; every block is one window partition and only one summary row per block is combined
globally, so no window ever runs over the whole table.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdense.session import broadcast_if_small, cut_lineage

ROWS_PER_BLOCK = 1_000_000
# Distinct values that a selection sorts at the end.
SELECT_ROWS = 100_000


def with_blocks(df: DataFrame, order: str, blocks: int | None = None, name: str = "_block") -> DataFrame:
    """Add an ascending block number. Results do not depend on where the cuts fall, only task sizes do."""
    if blocks is None:
        rows = df.count()
        default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        blocks = max(min(default, rows // 1000 + 1), math.ceil(rows / ROWS_PER_BLOCK))
    cuts: list[float] = []
    if blocks > 1:
        probabilities = [i / blocks for i in range(1, blocks)]
        cuts = sorted(set(df.approxQuantile(order, probabilities, 0.2 / blocks)))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    key = "_block_key"
    bucketed = Bucketizer(splits=splits, inputCol=key, outputCol=name).transform(
        df.withColumn(key, F.col(order).cast("double"))
    )
    return bucketed.drop(key).withColumn(name, F.col(name).cast("int"))


def _before(column: str, function=F.sum) -> F.Column:
    """Aggregate over all earlier blocks; only ever used on one-row-per-block tables."""
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return function(column).over(earlier)


def positions(df: DataFrame, order: str, name: str = "pos", blocks: int | None = None) -> DataFrame:
    """Add the 0-based rank of every row under a unique order."""
    blocked = with_blocks(df, order, blocks)
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_block", F.coalesce(_before("_n"), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_block").orderBy(order)
    return (
        blocked.join(broadcast_if_small(offsets), "_block")
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_block", "_offset")
    )


def prefix_sum(df: DataFrame, order: str, value: str, name: str = "prefix_sum", blocks: int | None = None) -> DataFrame:
    """Add the running sum of ``value``: sums per block, offsets per block, then a running sum inside each block."""
    blocked = with_blocks(df, order, blocks)
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    offsets = totals.select("_block", F.coalesce(_before("_total"), F.lit(0)).alias("_offset"))
    running = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(broadcast_if_small(offsets), "_block")
        .withColumn(name, F.col("_offset") + F.sum(value).over(running))
        .drop("_block", "_offset")
    )


def max_subarray(df: DataFrame, order: str, value: str, blocks: int | None = None) -> DataFrame:
    """The largest sum of a non-empty run of consecutive rows, as a single row ``best``.

    With prefix sums S the answer is max(S_j - min(S_i, i < j)). Each block reports its total, the least and the
    largest of its own prefix sums and its own best run; runs across blocks combine those.
    """
    blocked = with_blocks(df, order, blocks)
    window = Window.partitionBy("_block").orderBy(order)
    local = blocked.select("_block", order, F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    earlier = F.min("s").over(window.rowsBetween(Window.unboundedPreceding, -1))
    summaries = (
        local.withColumn("lowest", F.least(F.coalesce(earlier, F.lit(0)), F.lit(0)))
        .groupBy("_block")
        .agg(
            F.max_by("s", order).alias("total"),
            F.min("s").alias("low"),
            F.max("s").alias("high"),
            F.max(F.col("s") - F.col("lowest")).alias("inside"),
        )
    )
    placed = summaries.withColumn("offset", F.coalesce(_before("total"), F.lit(0)))
    placed = placed.withColumn("floor", F.col("offset") + F.col("low"))
    placed = placed.withColumn("carry", F.least(F.coalesce(_before("floor", F.min), F.lit(0)), F.lit(0)))
    across = F.col("offset") + F.col("high") - F.col("carry")
    return placed.agg(F.max(F.greatest("inside", across)).alias("best"))


def kth_smallest(df: DataFrame, value: str, k: int, select_rows: int = SELECT_ROWS) -> DataFrame:
    """The k-th smallest value (0-based) as a single row ``value``; duplicates count one by one.

    Equal values are counted into one row first, so a value that fills a third of the table costs nothing. The
    slice of candidates is then narrowed by approximate quantiles, each verified by an exact count, until it is
    small enough to rank.
    """
    if k < 0:
        raise ValueError("k counts from 0")
    counted = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")))
    slice_, below = counted, 0
    distinct, rows = counted.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if k >= rows:
        raise ValueError(f"k={k} is out of range: {rows} values")
    while distinct > select_rows:
        low, high = slice_.agg(F.min(value), F.max(value)).first()
        cuts = sorted(set(slice_.approxQuantile(value, [i / 16 for i in range(1, 16)], 0.01)))
        cuts = [c for c in cuts if low < c <= high]
        if not cuts:  # doubles cannot tell these values apart; some of the values themselves can
            drawn = slice_.where(F.col(value) > low).orderBy(F.xxhash64(value), value).limit(15)
            cuts = sorted(row[0] for row in drawn.select(value).collect())
        edges = slice_.agg(
            *[F.coalesce(F.sum(F.when(F.col(value) < c, F.col("_n"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(cuts)]
        ).first()
        lower = max((i for i in range(len(cuts)) if below + edges[i] <= k), default=None)
        upper = min((i for i in range(len(cuts)) if below + edges[i] > k), default=None)
        if lower is not None:
            slice_ = slice_.where(F.col(value) >= cuts[lower])
        if upper is not None:
            slice_ = slice_.where(F.col(value) < cuts[upper])
        below += edges[lower] if lower is not None else 0
        distinct = slice_.count()
    # The slice holds at most select_rows counted values.
    upto = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = slice_.withColumn("_upto", upto + F.lit(below))
    return ranked.where(F.col("_upto") > k).agg(F.min(value).alias("value"))


def successors(df: DataFrame, order: list[str], carry: list[str], name: str = "next", distinct: bool = False) -> DataFrame:
    """Add the next row under a unique composite order, as a struct of the order and carried columns.

    Rows are range partitioned by the full order, so a leading key that fills a third of the table is cut into
    many blocks; the last row of a block takes the first row of the next one. ``distinct`` drops repeated rows first,
    inside the blocks, as equal rows share one.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    columns = [*order, *[c for c in carry if c not in order]]
    row = F.struct(*columns)
    ranged = df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id())
    ranged = ranged.distinct() if distinct else ranged
    # range bounds are sampled: fix the block of every row before it is read twice; sorted rows take fewer bytes
    ranged = cut_lineage(ranged.sortWithinPartitions(*order))
    heads = ranged.groupBy("_block").agg(F.min(row).alias("_head"))
    following = heads.select("_block", F.lead("_head").over(Window.orderBy("_block")).alias("_head"))
    # one window column each: a window over the struct would send every row twice
    block = Window.partitionBy("_block").orderBy(*order)
    coming = [F.lead(c).over(block).alias(f"_next{i}") for i, c in enumerate(columns)]
    led = ranged.select("*", F.lead(F.lit(True)).over(block).alias("_more"), *coming)
    within = F.when(F.col("_more"), F.struct(*[F.col(f"_next{i}").alias(c) for i, c in enumerate(columns)]))
    return (
        led.withColumn(name, within)
        .join(broadcast_if_small(following), "_block")
        .withColumn(name, F.coalesce(name, "_head"))
        .drop("_block", "_head", "_more", *[f"_next{i}" for i in range(len(columns))])
    )
