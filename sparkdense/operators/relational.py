"""Relational operators that need a little more than one built-in call."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdense.functions.columns import words
from sparkdense.operators.sequence import positions
from sparkdense.session import cut_lineage

# Keys that one sieve task covers; bounds every generated row group.
SIEVE_BLOCK = 100_000


def two_word_lines(lines: DataFrame, column: str, runs: bool = True) -> DataFrame:
    """Lines of exactly two words, as columns ``first`` and ``second``.

    ``runs=True`` splits on runs of white space; ``runs=False`` on every single space, so that a line with two
    adjacent spaces has three words and is dropped.
    """
    split = words(column) if runs else F.split(column, " ")
    return (
        lines.withColumn("_w", split)
        .where(F.size("_w") == 2)
        .withColumns({"first": F.col("_w")[0], "second": F.col("_w")[1]})
        .drop("_w")
    )


def zip_by_position(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Pair the i-th row of ``left`` with the i-th row of ``right`` under the given unique orders."""
    return positions(left, left_order, "_pos").join(positions(right, right_order, "_pos"), "_pos").drop("_pos")


def distinct_with_null(column: str) -> Column:
    """Distinct values, NULL counted as one of them."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def word_count(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hit_ratio(x: str, y: str) -> Column:
    """Four times the share of rows inside the unit disc."""
    return 4 * F.avg(F.when(F.col(x) * F.col(x) + F.col(y) * F.col(y) < 1, 1).otherwise(0))


def partition_sizes(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Rows (and further aggregates) per physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"), *aggregates)


def smallest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The k first rows of every key; Spark limits each group before the shuffle as well as after it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, chosen by a seeded hash of a unique key: the same rows on every run."""
    ticket = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(ticket, key).limit(k)


def bag_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``; duplicates on the left stay.

    The distinct keys are checkpointed, so that both sides of the join are plain shuffles and the adaptive skew join
    can split a hot key of ``left``.
    """
    return left.join(cut_lineage(right.select(key).distinct()), key, "left_anti")


def composites(spark: SparkSession, end: int) -> DataFrame:
    """The composite numbers below ``end``: a sieve by all primes' multiples, block by block.

    Every (divisor, block) pair yields at most ``SIEVE_BLOCK / divisor`` rows, so the multiples of two are
    spread over as many tasks as there are blocks.
    """
    divisors = spark.range(2, max(3, math.isqrt(max(end - 1, 4)) + 1)).withColumnRenamed("id", "d")
    first_block = F.expr(f"(d * d) div {SIEVE_BLOCK}")
    last_block = F.lit((max(end - 1, 4)) // SIEVE_BLOCK)
    jobs = divisors.select("d", F.explode(F.sequence(first_block, last_block)).alias("block")).repartition("block", "d")
    start = F.greatest(F.col("d") * F.col("d"), F.expr(f"((block * {SIEVE_BLOCK} + d - 1) div d) * d"))
    stop = F.least(F.expr(f"(block + 1) * {SIEVE_BLOCK} - 1"), F.lit(end - 1))
    multiples = jobs.select("d", start.alias("start"), stop.alias("stop")).where("start <= stop")
    return multiples.select(F.explode(F.sequence("start", "stop", "d")).alias("composite")).distinct()


def missing_keys(spark: SparkSession, df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """The integers of [start, end) that do not occur as ``key``."""
    domain = spark.range(start, end).withColumnRenamed("id", "k")
    present = df.select(F.col(key).alias("k")).distinct()
    return domain.join(present, "k", "left_anti")
