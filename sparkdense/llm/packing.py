"""Packing token pieces into sequences by bounded-space online best-fit.

Every task keeps a fixed number of open bins. A bitset says at which amounts of free space there are open bins, so the
best fit of a piece is the lowest set bit at or above its length. If none fits and all bins are open, the fullest one
is closed and a new one opened. Pieces arrive in random groups of twice as many as there are open bins, the longest of a
group first: short pieces then fill what the long ones left, and every group meets bins of all kinds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.llm.bpe import ByteBpe
from sparkdense.llm.common import stored, tasks_for

CAPACITY = 2048
OPEN_BINS = 1024
PIECES_PER_TASK = 60_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
WITH_IDS = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())])


class OpenBins:
    """At most ``limit`` open bins of ``capacity``; ``place`` gives (bin number, offset in it)."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open, self.bins = 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return number

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if size < self.capacity and self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, number = self.capacity, self.bins
            self.bins += 1
            self.open += size < self.capacity
        left = free - size
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        elif free < self.capacity:
            self.open -= 1
        return number, self.capacity - free


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole document: its ids, then ``end_id``; a longer document is cut into full pieces.

    The first piece takes the remainder. A null or empty text is one piece of one token. ``with_ids`` adds the ids.
    """
    schema = WITH_IDS if with_ids else PIECES
    arrow = to_arrow_schema(schema)
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in batches:
            rows: list[list] = [[] for _ in schema.fields]
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                ids = bpe.encode_leaf(text or "") + last
                total = len(ids) // 4
                start, number = 0, 0
                while start < total:
                    length = capacity if start or total % capacity == 0 else total % capacity
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc_id, number, start, length, zlib.crc32(part), part), strict=False):
                        column.append(value)
                    start, number = start + length, number + 1
            if rows[0]:
                made = [pa.array(v, type=f.type) for v, f in zip(rows, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(
    items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    ``items`` is counted and dealt evenly over as many tasks as ``per_task`` needs, so pass a stored table. A task
    leaves at most ``open_bins`` bins partly filled. An empty table gives an empty result.
    """
    schema = T.StructType(
        [f for f in items.schema.fields if f.name not in ("sequence_id", "offset")]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(c)).cast(arrow.field(c).type) for c in names]
            made = [pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    rows = items.count()
    n = tasks_for(rows, per_task)
    # dealt by content, so that a task that runs again gets the same pieces in the same order
    keys = [c for c in ("doc_id", "piece") if c in items.columns] or items.columns
    group = F.pmod(F.xxhash64(*keys), F.lit(tasks_for(rows, n * 2 * open_bins)))
    dealt = items.repartition(n, *keys).sortWithinPartitions(group, F.desc("length"), *keys)
    return dealt.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Other columns of ``docs`` are not read. Repeated rows are packed as often as they occur; null ids stay null.
    """
    return best_fit(stored(pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence of ``pack_documents(..., with_ids=True)``: ``input_ids`` and the pieces' offsets."""
    row = F.struct("offset", "doc_id", "piece", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = F.aggregate("rows", F.lit(b"").cast("binary"), lambda acc, r: F.concat(acc, r["ids"]))
    return grouped.select(
        "sequence_id",
        joined.alias("input_ids"),
        F.transform("rows", lambda r: F.struct(r["doc_id"], r["piece"], r["offset"], r["length"])).alias("parts"),
    )
