"""Merkle manifest of a dataset by checkpoint and recompute.

Every group (a source) has a tree over its leaves in order, and the subroots have a tree of their own. Only every few
levels are stored: a stored node stands for an aligned subtree of ``fanout ** every`` descendants. A proof is made
from the top down: the task that holds the stored descendants of a subtree computes the missing nodes between them
and the subtree's root again, emits for each descendant the siblings on its way up and forgets those nodes. A subtree
has a fixed number of descendants, so a hot source is spread over as many tasks as it has subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.llm.common import stored
from sparkdense.session import broadcast_if_small

FANOUT = 3
# Levels from one stored level to the next: 3^6 = 729 descendants of one subtree are in memory at a time.
EVERY = 6
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# One step of a proof: the digests to the left and to the right of the node in its run, joined.
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 over the values in order, each as byte count, colon and value; null is a minus sign."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256)


def _digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def subtree(nodes: list[str], n: int, fanout: int, every: int) -> list[list[str]]:
    """The levels of one aligned subtree, stored descendants first; ``n`` nodes of the group are on their level."""
    levels = [nodes]
    for _ in range(min(every, _levels(n, fanout))):
        below = levels[-1]
        levels.append([_digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``idx``, the place in the group from 0, and ``n``, the group's size; a stored table.

    Rows are range partitioned by group and order, and only one row for each group and partition is combined, so no
    window runs over a group. Nulls come first.
    """
    keys = [*group, *order]
    in_order = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = stored(in_order.withColumn("mark", F.monotonically_increasing_id()), "ranked")
    marked = marked.withColumn("part", F.shiftright("mark", 33))
    parts = marked.groupBy(*group, "part").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"of_{c}") for c in group],
        F.col("part").alias("of_part"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    same = F.col("part") == F.col("of_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    found = marked.join(broadcast_if_small(stored(offsets, "offsets")), same)
    return found.select(*rows.columns, (F.col("mark") + F.col("shift")).alias("idx"), "n")


@dataclass(frozen=True)
class Forest:
    """One tree for each group. ``tiers`` are the stored levels: the leaves, then each of the nodes ``every`` levels up."""

    group: tuple[str, ...]
    tiers: tuple[DataFrame, ...]
    roots: DataFrame
    fanout: int
    every: int

    def proofs(self, tops: DataFrame) -> DataFrame:
        """The leaves, with all columns given, plus ``path`` and the columns of ``tops``.

        ``tops`` has one row for each group: its columns, ``path`` (the steps above the group's root) and what every
        leaf of the group shall carry.
        """
        carried = [f for f in tops.schema.fields if f.name not in (*self.group, "path")]
        above = None
        for number in range(len(self.tiers) - 1, -1, -1):
            nodes = self.tiers[number]
            if number:
                done, open_ = nodes.where("n = 1"), nodes.where("n > 1")
                top = done.select(*self.group, "idx").alias("d").join(tops.alias("t"), _same(self.group, "d", "t"))
                made = top.select(*[f"d.{c}" for c in self.group], "idx", "path", *[f.name for f in carried])
                if above is not None:
                    below = self._extend(open_, above, carried).select(*made.columns)
                    made = made.unionByName(below)
                above = stored(made, "paths")
            else:
                above = self._extend(nodes, above, carried)
        return above.drop("idx", "n")

    def _extend(self, nodes: DataFrame, above: DataFrame, carried: list[T.StructField]) -> DataFrame:
        """``nodes`` plus path and carried columns: the steps inside the subtree, then those of its root in ``above``."""
        size, fanout, every = self.fanout**self.every, self.fanout, self.every
        schema = T.StructType([*nodes.schema.fields, T.StructField("path", PATH), *carried])
        arrow, kept, names = to_arrow_schema(schema), nodes.columns, [f.name for f in carried]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return arrow.empty_table()
            left = left.select(kept).sort_by("idx").combine_chunks()
            top = right.slice(0, 1).to_pylist()[0]
            levels = subtree(left.column("hash").to_pylist(), left.column("n")[0].as_py(), fanout, every)
            upper = [(s["left"], s["right"]) for s in top["path"]]
            lefts, rights, offsets = [], [], [0]
            for place in range(left.num_rows):
                for nodes_here in levels[:-1]:
                    start = place - place % fanout
                    lefts.append("".join(nodes_here[start:place]))
                    rights.append("".join(nodes_here[place + 1 : start + fanout]))
                    place //= fanout
                lefts += [x for x, _ in upper]
                rights += [x for _, x in upper]
                offsets.append(len(lefts))
            steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
            path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
            more = [pa.array([top[c]] * left.num_rows, type=arrow.field(c).type) for c in names]
            columns = [left.column(c).combine_chunks() for c in kept] + [path.cast(arrow.field("path").type), *more]
            return pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        own = nodes.withColumn("block", F.expr(f"idx div {size}"))
        upper = above.withColumnRenamed("idx", "block")
        return own.groupBy(*self.group, "block").cogroup(upper.groupBy(*self.group, "block")).applyInArrow(run, schema)


def _same(group: Sequence[str], left: str, right: str) -> Column:
    same = F.lit(True)
    for c in group:
        same &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def forest(leaves: DataFrame, group: Sequence[str], order: Sequence[str], fanout: int = FANOUT, every: int = EVERY) -> Forest:
    """The stored levels of one tree for each group over ``leaves`` (group, order, ``hash`` and any other columns)."""
    size = fanout**every
    first = ranked(leaves, group, order)
    tiers = [stored(first, "leaves")]
    nodes = tiers[0].select(*group, "idx", "n", "hash")
    schema = nodes.schema
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        top = table.slice(0, 1).to_pylist()[0]
        root = subtree(table.column("hash").to_pylist(), top["n"], fanout, every)[-1][0]
        row = top | {"idx": top["block"], "n": -(-top["n"] // size), "hash": root}
        return pa.table([pa.array([row[f.name]], type=f.type) for f in arrow], schema=arrow)

    while True:
        keyed = nodes.withColumn("block", F.expr(f"idx div {size}"))
        tiers.append(stored(keyed.groupBy(*group, "block").applyInArrow(run, schema), "tier"))
        nodes = tiers[-1].where("n > 1")
        if nodes.isEmpty():
            break
    roots = tiers[1].where("n = 1")
    for tier in tiers[2:]:
        roots = roots.unionByName(tier.where("n = 1"))
    return Forest(tuple(group), tuple(tiers), roots.select(*group, "hash"), fanout, every)


@dataclass(frozen=True)
class Manifest:
    """Trees of the sources, the tree of their subroots, and the root (None for an empty table)."""

    sources: Forest
    top: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves plus ``path`` (steps from leaf to root), ``subroot`` and ``root``."""
        whole = self.top.roots.select("tree", F.array().cast(PATH).alias("path"), F.lit(self.root).cast("string").alias("root"))
        tops = self.top.proofs(whole).select("source", "path", F.col("hash").alias("subroot"), "root")
        return self.sources.proofs(stored(tops, "tops")).withColumnRenamed("hash", "leaf")


def manifest(leaves: DataFrame, fanout: int = FANOUT, every: int = EVERY) -> Manifest:
    """The manifest over ``leaves``: ``source``, ``doc_id``, ``hash`` and any columns that proofs shall carry.

    Leaves of a source ascend by doc_id, a null one first; rows that share a doc_id ascend by digest and are leaves of
    their own. Null is a source like any other and comes first. An empty table has no root. Columns named ``idx``,
    ``n``, ``path``, ``subroot``, ``root``, ``mark`` or ``part`` must not be among those carried.
    """
    sources = forest(leaves, ["source"], ["doc_id", "hash"], fanout, every)
    subroots = sources.roots.select(F.lit(0).alias("tree"), "source", "hash")
    top = forest(subroots, ["tree"], ["source"], fanout, every)
    found = top.roots.first()
    return Manifest(sources, top, found["hash"] if found else None)


def proof_digest(path: Column) -> Column:
    """sha256 over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def verify(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is made of ``docs`` as it is. Then the proof of each row is folded with the leaf of the row as found
    later: with ``text`` in place of its text where ``tampered`` holds. Null texts and other nulls enter a leaf as a
    minus sign, empty texts as ``0:``; columns other than ``LEAF_COLUMNS`` are not read. Repeated rows have equal
    leaves, places of their own and therefore proofs of their own.
    """
    values = [F.col(c) for c in LEAF_COLUMNS]
    leaf = leaf_digest(values)
    later = F.when(tampered & (text != F.col("text")), leaf_digest([*values[:-1], text]))
    leaves = docs.select("source", "doc_id", leaf.alias("hash"), later.alias("later"))
    found = manifest(leaves).proofs()
    folded = found.withColumn("folded_root", fold(F.coalesce("later", "leaf"), F.col("path")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
