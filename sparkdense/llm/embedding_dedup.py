"""Near-duplicate embeddings by an exact metric range join.

Cosine at least ``cosine`` is a distance of unit vectors of at most eps = sqrt(2 - 2 * cosine). Pivots, chosen for each
label, cut its vectors into cells of the nearest pivot. If y has its home in cell c and lies within eps of x, then, by
the triangle inequality, d(x, c) <= d(x, home of x) + 2 * eps; for unit vectors x moreover lies within eps of the plane
between both pivots, which is the tighter bound. x is replicated to the cells that pass both, so each cell finds all
partners of its home vectors on its own. A large cell is cut into blocks, and pairs of blocks are separate tasks; pairs
are counted where they are found and only the local components leave the task, one edge for each vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.graph.components import connected_components
from sparkdense.llm.common import stored

ROWS_PER_CELL = 5_000
BLOCK_ROWS = 4_000
MAX_PIVOTS = 20_000
_CHUNK = 500


def unit_rows(raw: np.ndarray) -> np.ndarray:
    rows = raw.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _choose_pivots(classes: DataFrame, rows_per_cell: int) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of each (label, dimension) with more than one cell's worth of vectors, by the least hashes.

    At most MAX_PIVOTS in all: with more vectors, cells grow and are cut into more blocks instead.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per_cell = max(rows_per_cell, math.ceil(total / MAX_PIVOTS))
    large = {(r["label"], r["dim"]): r["n"] for r in sizes.where(F.col("n") > per_cell).collect()}  # at most MAX_PIVOTS rows
    if not large:
        return {}
    cut = F.lit(None).cast("long")
    for (label, dim), n in large.items():
        share = min(1.0, 4 / per_cell)
        bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
        cut = F.when((F.col("label") == label) & (F.col("dim") == dim), F.lit(bound)).otherwise(cut)
    few = classes.withColumn("h", F.xxhash64("embedding")).where(F.col("h") <= cut)
    found: dict[tuple[int, int], list] = {}
    for row in few.orderBy("h").select("label", "dim", "embedding").limit(5 * MAX_PIVOTS).collect():
        found.setdefault((row["label"], row["dim"]), []).append(row["embedding"])
    return {
        key: unit_rows(np.array(rows[: math.ceil(large[key] / per_cell)], dtype=np.float32)) for key, rows in found.items()
    }


def _in_cells(classes: DataFrame, pivots: dict[tuple[int, int], np.ndarray], eps: float) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("label", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
            T.StructField("home", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("copies", T.LongType()),
            T.StructField("raw", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors

    def run(batches):
        for batch in batches:
            table = batch.to_pydict()
            out: list[list] = [[] for _ in schema.fields]
            for label, dim, rep, copies, values in zip(
                table["label"], table["dim"], table["rep"], table["copies"], table["embedding"], strict=True
            ):
                raw = np.array(values, dtype=np.float32)
                own = shared.value.get((label, dim))
                if own is None:
                    cells, home = [0], 0
                else:
                    x = unit_rows(raw[None, :])[0]
                    d = np.sqrt(np.maximum(0.0, ((own - x) ** 2).sum(axis=1)))
                    home = int(d.argmin())
                    between = np.sqrt(((own - own[home]) ** 2).sum(axis=1))
                    near = (d - d[home] <= 2 * eps + 1e-9) & (d * d - d[home] ** 2 <= 2 * between * eps + 1e-9)
                    near[home] = True
                    cells = np.flatnonzero(near).tolist()
                for cell in cells:
                    for column, value in zip(out, (label, dim, cell, cell == home, rep, copies, raw.tobytes()), strict=True):
                        column.append(value)
            made = [pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return classes.mapInArrow(run, schema)


def _local_links(cosine: float):
    """The function of one pair of blocks: for each left row the rows it links with, and edges to local components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["is_left"]], rows[~rows["is_left"]]
        empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return empty
        matrix = [unit_rows(np.stack([np.frombuffer(b, dtype=np.float32) for b in side["raw"]])) for side in (left, right)]
        copies = right["copies"].to_numpy()
        ids = [side["rep"].to_numpy() for side in (left, right)]
        linked = np.empty((len(left), len(right)), dtype=bool)
        links = np.empty(len(left), dtype=np.int64)
        for i in range(0, len(left), _CHUNK):
            linked[i : i + _CHUNK] = matrix[0][i : i + _CHUNK] @ matrix[1].T >= cosine
            linked[i : i + _CHUNK] |= ids[0][i : i + _CHUNK, None] == ids[1][None, :]
            links[i : i + _CHUNK] = linked[i : i + _CHUNK] @ copies
        far = np.iinfo(np.int64).max
        least = [ids[0].copy(), ids[1].copy()]
        while True:
            before = least[0].sum(), least[1].sum()
            for i in range(0, len(left), _CHUNK):
                part = linked[i : i + _CHUNK]
                least[0][i : i + _CHUNK] = np.minimum(least[0][i : i + _CHUNK], np.where(part, least[1][None, :], far).min(axis=1))
                least[1] = np.minimum(least[1], np.where(part, least[0][i : i + _CHUNK, None], far).min(axis=0))
            if before == (least[0].sum(), least[1].sum()):
                break
        moved = least[1] != ids[1]
        return pd.DataFrame(
            {
                "rep": np.concatenate([ids[0], ids[1][moved]]),
                "links": np.concatenate([links, np.zeros(moved.sum(), dtype=np.int64)]),
                "least": np.concatenate([least[0], least[1][moved]]),
            }
        )

    return run


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, rows_per_cell: int = ROWS_PER_CELL, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal, non-null label and equal length link at a cosine of at least ``cosine`` in double precision.
    Null embeddings or labels, empty or zero vectors, and such with null or non-finite components link with nothing.
    Rows of equal label and components are one class, counted with its copies; n_links counts all other rows.
    component_id is the least vec_id reachable; rows with a null vec_id link with nothing. A vec_id is one vector: rows
    that repeat it with other components are counted as one node of the links. Other columns are not read.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("dim", F.size("embedding")), "classes")
    cells = stored(_in_cells(classes, _choose_pivots(classes, rows_per_cell), eps), "cells")
    key = ["label", "dim", "cell"]
    blocks = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = cells.join(stored(blocks, "blocks"), key)
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.where("home").select(*key, block.alias("i"), every.alias("j"), F.lit(True).alias("is_left"), "rep", "copies", "raw")
    right = dealt.select(*key, block.alias("j"), every.alias("i"), F.lit(False).alias("is_left"), "rep", "copies", "raw")
    found = left.unionByName(right).groupBy(*key, "i", "j").applyInPandas(_local_links(cosine), "rep long, links long, least long")
    found = stored(found, "found")
    edges = found.where("rep <> least").select(F.col("least").alias("src"), F.col("rep").alias("dst")).distinct()
    components = connected_components(edges)
    totals = found.groupBy("rep").agg((F.sum("links") - 1).alias("n_links"))
    named = classes.select("rep", "label", "embedding").join(totals, "rep").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    named = stored(named.select("label", "embedding", "n_links", F.coalesce("component", "rep").alias("component")), "named")
    joined = rows.alias("r").join(
        named.alias("n"),
        F.col("r.usable") & (F.col("r.label") == F.col("n.label")) & (F.col("r.embedding") == F.col("n.embedding")),
        "left",
    )
    component = F.coalesce("n.component", "r.vec_id")
    return joined.select(
        F.col("r.vec_id").alias("vec_id"),
        F.coalesce("n.n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("r.vec_id") == component, F.lit(True)).alias("kept"),
    )
