"""K-means: nearest-centre assignment and Lloyd rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdense.operators.relational import sample_rows

Centre = tuple[float, ...]


def nearest_centre(coords: Sequence[str], centres: Sequence[Centre]) -> Column:
    """Index of the nearest centre, the first one on ties. Centres are literals: there are only K of them."""
    candidates = []
    for i, centre in enumerate(centres):
        square = sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(coords, centre)), F.lit(0.0))
        candidates.append(F.struct(square.alias("d"), F.lit(i).alias("i")))
    return F.array_min(F.array(*candidates))["i"]


def initial_centres(points: DataFrame, coords: Sequence[str], k: int, seed: int = 1, key: str = "id") -> list[Centre]:
    chosen = sample_rows(points.select(key, *coords), key, k, seed).collect()  # K rows
    return [tuple(float(row[c]) for c in coords) for row in chosen]


def fit_centres(
    points: DataFrame, coords: Sequence[str], centres: Sequence[Centre], tolerance: float = 0.01, max_rounds: int = 100
) -> list[Centre]:
    """Move each centre to the mean of its points until the centres together move at most ``tolerance`` (squared).

    One partial-aggregated job per round, K rows back to the driver; a centre without points stays where it is.
    """
    current = [tuple(map(float, c)) for c in centres]
    cached = points.select(*coords).persist()
    try:
        for _ in range(max_rounds):
            means = cached.groupBy(nearest_centre(coords, current).alias("i")).agg(*[F.avg(c).alias(c) for c in coords])
            moved = list(current)
            for row in means.collect():  # at most K rows
                moved[row["i"]] = tuple(row[c] for c in coords)
            shift = sum((a - b) ** 2 for old, new in zip(current, moved) for a, b in zip(old, new))
            current = moved
            if shift <= tolerance:
                break
    finally:
        cached.unpersist()
    return current
