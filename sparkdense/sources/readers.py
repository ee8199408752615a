"""Readers (text, CSV, JSON, literal rows, ranges) and line parsers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """One row per line, column ``value``; repartitioned only when more parallelism is asked for."""
    lines = spark.read.text(path)
    return lines.repartition(min_partitions) if min_partitions else lines


def read_csv_header(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, at the cost of one more pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_positional(spark: SparkSession, path: str, names: dict[int, str]) -> DataFrame:
    """Headerless CSV with inferred types: keep the columns at the given positions under the given names."""
    raw = spark.read.option("inferSchema", True).csv(path)
    return raw.select([F.col(f"_c{position}").alias(name) for position, name in names.items()])


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str | list[str]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def range_table(spark: SparkSession, start: int, end: int, partitions: int, name: str = "id") -> DataFrame:
    return spark.range(start, end, 1, partitions).withColumnRenamed("id", name)


def random_key(n: int, seed: int) -> Column:
    """A random integer in [0, n), repeatable for a fixed partitioning."""
    return F.floor(F.rand(seed) * n)


def hashed_key(column: Column | str, n: int) -> Column:
    """An integer in [0, n) that depends on the key alone, so that it survives a re-run of the task."""
    return F.pmod(F.xxhash64(column), F.lit(n))


def conforming(column: Column | str, data_type: str) -> Column:
    """The value as ``data_type``, NULL where it does not conform."""
    return F.col(column).try_cast(data_type) if isinstance(column, str) else column.try_cast(data_type)


def named_rows(records: DataFrame, fields: Column | str, types: Mapping[str, str]) -> DataFrame:
    """A typed table from rows of named values: ``fields`` is a map from names to values as text.

    One column for each name of ``types``; NULL where a row lacks the name or its value does not conform to the type.
    Names that are not asked for are dropped, other columns of ``records`` are kept ahead of the fields.
    """
    values, own = (F.col(fields), {fields}) if isinstance(fields, str) else (fields, set())
    kept = [c for c in records.columns if c not in own and c not in types]
    return records.select(*kept, *[conforming(F.try_element_at(values, F.lit(name)), kind).alias(name) for name, kind in types.items()])


def delimited_field(line: Column | str, separator: str, position: int, data_type: str = "string") -> Column:
    """Field ``position`` of a delimited line, NULL when absent or not of the type."""
    return F.get(F.split(line, separator), F.lit(position)).try_cast(data_type)


def vector_of_line(line: Column | str) -> Column:
    """A white-space separated line of numbers as array<double>."""
    return F.transform(F.split(F.trim(line), r"\s+"), lambda v: v.try_cast("double"))
