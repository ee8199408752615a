"""Ordered-sequence, word-association and K-means queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.functions.columns import unpack
from sparkdense.operators.association import adjacent_pairs, pmi
from sparkdense.operators.kmeans import fit_centres, initial_centres, nearest_centre
from sparkdense.operators.sequence import kth_smallest, max_subarray, positions, prefix_sum
from sparkdense.registry import query, table
from sparkdense.session import spread_if_small

CENTS = "CAST(round(value * 100) AS BIGINT)"


def cents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def swings(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases count up, everything else down, so that runs rise and fall."""
    sign = F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(-1)
    return table(spark, sf, "events").select(
        "event_id", (sign * F.round(F.col("value") * 100)).cast("bigint").alias("v")
    )


@query(
    "seq_prefix_sum",
    f"SELECT event_id, {CENTS} AS cents, sum({CENTS}) OVER (ORDER BY event_id)::BIGINT AS prefix_sum FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_sum(cents(spark, sf), "event_id", "cents")


@query(
    "seq_positions",
    "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return positions(table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query(
    "seq_max_subarray",
    f"""WITH v AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE -1 END * {CENTS} AS v FROM events),
             s AS (SELECT event_id, sum(v) OVER (ORDER BY event_id) AS s FROM v),
             m AS (SELECT s, least(0, coalesce(min(s) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
                                                            AND 1 PRECEDING), 0)) AS low FROM s)
        SELECT max(s - low)::BIGINT AS best FROM m""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return max_subarray(swings(spark, sf), "event_id", "v")


@query(
    "seq_kth_smallest",
    f"SELECT {CENTS} AS value FROM events ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) // 3 FROM events)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = cents(spark, sf)
    return kth_smallest(values, "cents", values.count() // 3)


@query(
    "seq_kth_smallest_duplicates",
    "SELECT l_quantity AS value FROM lineitem ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) // 2 FROM lineitem)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "lineitem").select("l_quantity")
    return kth_smallest(values, "l_quantity", values.count() // 2)


PMI_SQL = r"""
WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents
           UNION ALL SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') FROM conversations),
     pairs AS (SELECT unnest(w[1:len(w) - 1]) AS first, unnest(w[2:len(w)]) AS second FROM w WHERE len(w) >= 2),
     c AS (SELECT first, second, count(*) AS n FROM pairs GROUP BY ALL),
     f AS (SELECT first, sum(n) AS nf FROM c GROUP BY 1), s AS (SELECT second, sum(n) AS ns FROM c GROUP BY 1)
SELECT first, second, round(log2(n * (SELECT sum(n) FROM c)::DOUBLE / (nf * ns)), 6) AS pmi
FROM c JOIN f USING (first) JOIN s USING (second) WHERE n >= 100
"""


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select("text").union(table(spark, sf, "conversations").select("text"))
    return adjacent_pairs(spread_if_small(texts), "text")


@query("pmi_all", PMI_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pmi(text_pairs(spark, sf), 100).select("first", "second", F.round("pmi", 6).alias("pmi"))


@query("pmi_top10", PMI_SQL + " ORDER BY pmi DESC, first DESC, second DESC LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = pmi(text_pairs(spark, sf), 100, top=10)
    return scored.select("first", "second", F.round("pmi", 6).alias("pmi"))


# All coordinates of an embedding.
COORDS = [f"v{i}" for i in range(64)]
VECTORS_SQL = "p AS (SELECT vec_id AS id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(COORDS)) + " FROM embeddings)"
FIRST_CENTRES_SQL = f"""SELECT row_number() OVER (ORDER BY md5(id::VARCHAR || ':1'), id) - 1 AS i, {", ".join(COORDS)} FROM p
                  QUALIFY i < 3"""
SQUARES_SQL = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in COORDS)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return unpack(embeddings, "embedding", COORDS).drop("embedding")


@query(
    "km_assign",
    f"""WITH {VECTORS_SQL}, c AS ({FIRST_CENTRES_SQL})
       SELECT id, i::INTEGER AS centre FROM (
         SELECT p.id, c.i, row_number() OVER (PARTITION BY p.id ORDER BY 0 + {SQUARES_SQL}, c.i) AS rn
         FROM p, c) WHERE rn = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    return points.select("id", nearest_centre(COORDS, initial_centres(points, COORDS, 3)).alias("centre"))


def km_rounds_sql(rounds: int) -> str:
    parts = [f"WITH {VECTORS_SQL}, c0 AS ({FIRST_CENTRES_SQL})"]
    means = ", ".join(f"avg({c}) AS {c}" for c in COORDS)
    for r in range(rounds):
        parts.append(
            f""", a{r} AS (SELECT * FROM (SELECT p.*, c.i, row_number() OVER (PARTITION BY p.id ORDER BY 0 + {SQUARES_SQL}, c.i) AS rn
                                          FROM p, c{r} c) WHERE rn = 1),
                  c{r + 1} AS (SELECT i, {means} FROM a{r} GROUP BY i)"""
        )
    parts.append(f" SELECT i::INTEGER AS centre, {', '.join(f'round({c}, 6) AS {c}' for c in COORDS)} FROM c{rounds}")
    return "".join(parts)


@query("km_centres", km_rounds_sql(8))
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    # Eight rounds exactly: a negative tolerance never stops early.
    fitted = fit_centres(points, COORDS, initial_centres(points, COORDS, 3), tolerance=-1.0, max_rounds=8)
    rows = [(i, *(round(v, 6) for v in centre)) for i, centre in enumerate(fitted)]
    return spark.createDataFrame(rows, "centre int, " + ", ".join(f"{c} double" for c in COORDS))


@query("km_converged")
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    fitted = fit_centres(points, COORDS, initial_centres(points, COORDS, 3), tolerance=0.01)
    assigned = points.select(*COORDS, nearest_centre(COORDS, fitted).alias("centre"))
    return assigned.groupBy("centre").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in COORDS])
