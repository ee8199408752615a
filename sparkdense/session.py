"""Session factory, tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows up to which a metadata table (boxes, labels, centres, offsets) is broadcast.
BROADCAST_ROWS = 200_000
# Bytes that its columns without a fixed width may hold together.
BROADCAST_BYTES = 32 << 20
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def local_session(cores: str | int = "*", app: str = "sparkdense", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, as set in ``spark.checkpoint.dir``.

    Only a local master, which has no other machine to share with, falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"sparkdense-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    A checkpoint would keep the size that was estimated for its plan. Joins multiply such estimates, so in a loop they
    grow to numbers of thousands of digits, which took the planner longer than the work itself. A table has its true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows; else leave the join to shuffle.

    Columns without a fixed width (strings, arrays, structs) are measured, too, and may hold ``max_bytes``. Counting stops at ``max_rows + 1``, so pass tables that are cheap to read (checkpointed or aggregated).
    """
    loose = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, _FIXED_WIDTH)]
    size = F.octet_length(F.to_json(F.struct(*loose))) if loose else F.lit(0)
    first = df.select(size.alias("size")).limit(max_rows + 1)
    rows, held = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def metadata_table(spark: SparkSession, columns: dict[str, list], types: dict[str, str]) -> DataFrame:
    """A few driver-side rows (splits, boxes, widths) as a local relation, which costs no job to read."""
    table = spark.createDataFrame(pa.table(columns))
    return table.select([F.col(name).cast(kind).alias(name) for name, kind in types.items()])


def spread_if_small(df: DataFrame) -> DataFrame:
    """Spread a table over all cores before heavy per-row work, when it has no more input splits than cores.

    A split holds at most ``spark.sql.files.maxPartitionBytes``, so this moves little data; a large table has
    splits enough and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
