"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, per_task: int) -> int:
    return max(1, math.ceil(rows / per_task))


def crc32_of(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def plain_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of few files over the cores, before a costly step for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append_columns(
    df: DataFrame, fields: list[T.StructField], inputs: list[str], make: Callable[[], Callable[..., list[list]]]
) -> DataFrame:
    """All columns of ``df`` plus ``fields``, computed in Arrow batches from the columns ``inputs``.

    ``make`` runs once in each task and returns a function from one list for each input to one list for each field.
    Input columns that bear the name of a new field are replaced. No shuffle.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(schema)
    keep_names = [f.name for f in kept]
    sources = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = work(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in sources])
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep_names]
            old = [a.cast(arrow.field(i).type) for i, a in enumerate(old)]
            made = [pa.array(v, type=arrow.field(len(old) + i).type) for i, v in enumerate(new)]
            yield pa.RecordBatch.from_arrays(old + made, schema=arrow)

    return df.mapInArrow(run, schema)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
