"""CSV sinks: plain tables and clustering results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cluster_report(result: DataFrame, points: DataFrame, cap: float, x: str = "x", y: str = "y") -> DataFrame:
    """One row per point in export form; coordinates are looked up by the global id.

    ``minD`` is the smaller of reach and core distance, capped at ``cap``; undefined distances stay NULL
    except in ``minD``, where the cap stands for them.
    """
    least = F.coalesce(F.least("reach_dist", "core_dist"), F.lit(cap))
    columns = ["id", "order_id", "reach_dist", "core_dist", "cluster_id", "is_core"]
    return result.select(*columns).join(points.select("id", x, y), "id").select(
        F.col("id").alias("Pid"),
        F.col("order_id").alias("OPTid"),
        F.col(x).alias("Px"),
        F.col(y).alias("Py"),
        F.col("reach_dist").alias("rD"),
        F.col("core_dist").alias("cD"),
        F.col("cluster_id").alias("cluster"),
        (~F.col("is_core")).alias("notCore"),
        F.least(least, F.lit(cap)).alias("minD"),
    )
