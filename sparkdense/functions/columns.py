"""Column expressions: vectors, distances, boxes, text and integer helpers. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def unpack(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """The leading elements of an array column as plain double columns."""
    return df.select(
        "*", *[F.get(vector, F.lit(i)).cast("double").alias(name) for i, name in enumerate(names)]
    )


def vector_distance(p: Column | str, q: Column | str) -> Column:
    """Euclidean distance of two arrays of equal length."""
    squares = F.zip_with(p, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))


def distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Euclidean distance of two points given as coordinate columns, unrolled for code generation."""
    total = None
    for a, b in zip(left, right, strict=True):
        square = (a - b) * (a - b)
        total = square if total is None else total + square
    return F.sqrt(total)


def capped(value: Column | str, cap: float) -> Column:
    return F.least(value, F.lit(cap))


def words(text: Column | str) -> Column:
    """Split on runs of white space; empty strings are dropped."""
    return F.array_remove(F.split(text, r"\s+"), "")


def characters(text: Column | str) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def int_div(a: Column | str, b: Column | str) -> Column:
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


# --- boxes: struct<lower: array<double>, upper: array<double>> -------------------------------------------


def box(lower: Column, upper: Column) -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def box_union(a: Column, b: Column) -> Column:
    return box(
        F.zip_with(a["lower"], b["lower"], lambda p, q: F.least(p, q)),
        F.zip_with(a["upper"], b["upper"], lambda p, q: F.greatest(p, q)),
    )


def box_intersection(a: Column, b: Column) -> Column:
    return box(
        F.zip_with(a["lower"], b["lower"], lambda p, q: F.greatest(p, q)),
        F.zip_with(a["upper"], b["upper"], lambda p, q: F.least(p, q)),
    )


def box_split(a: Column, dim: int, value: Column) -> tuple[Column, Column]:
    """Left and right part of a box cut at ``value`` on axis ``dim``."""
    left = box(a["lower"], F.transform(a["upper"], lambda v, i: F.when(i == dim, value).otherwise(v)))
    right = box(F.transform(a["lower"], lambda v, i: F.when(i == dim, value).otherwise(v)), a["upper"])
    return left, right


def box_expand(a: Column, eps: Column | float, how: str = "add") -> Column:
    """Grow a box by ``eps`` on each side, or by ``eps`` times its span. ``eps`` may be an array column."""
    if how not in ("add", "multiply"):
        raise ValueError("how must be 'add' or 'multiply'")
    k = F.size(a["lower"])
    margin = eps if isinstance(eps, Column) else F.array_repeat(F.lit(float(eps)), k)
    if how == "multiply":
        span = F.zip_with(a["upper"], a["lower"], lambda u, lo: u - lo)
        margin = F.zip_with(margin, span, lambda m, s: m * s)
    return box(
        F.zip_with(a["lower"], margin, lambda v, m: v - m),
        F.zip_with(a["upper"], margin, lambda v, m: v + m),
    )


def box_contains(a: Column, vector: Column) -> Column:
    """True when the vector lies in the box, both ends included."""
    above = F.forall(F.zip_with(a["lower"], vector, lambda lo, v: lo <= v), lambda t: t)
    below = F.forall(F.zip_with(a["upper"], vector, lambda up, v: up >= v), lambda t: t)
    return above & below


def all_space(k: int) -> Column:
    """The box that contains every k-dimensional vector."""
    return box(
        F.array_repeat(F.lit(float("-inf")), k),
        F.array_repeat(F.lit(float("inf")), k),
    )


@F.pandas_udf(IntegerType())
def text_length_plus_two(text: pd.Series) -> pd.Series:
    """The UDF form of ``length + 2``; NULL stays NULL."""
    return text.str.len().add(2).astype("Int32")
