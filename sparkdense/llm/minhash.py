"""Near-duplicate detection by b-bit MinHash.

Each set of word shingles gets 112 minima. Bands of four minima generate candidates: two sets of similarity 0.8 share
none of the 28 bands with probability (1 - 0.8^4)^28, below 4e-7. Of each minimum the four low bits are kept, packed
into seven longs; the number of equal low bits, corrected for chance collisions, estimates the similarity and dismisses
pairs far below the threshold (over six standard deviations). What is left is confirmed on the full sets.

Rows of equal sets are one class from the start. In each bucket one pivot is compared with all members, so a large
group of near copies costs about as many pairs as it has members. Members that are then still apart from the pivot's
component are compared with all members of other components, first by finer signatures of 1,024 minima and each pair in
the least bucket it shares, so no pair of different components goes uncompared. In a large bucket this is done by blocks
inside tasks that hand on links only, not pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdense.graph.components import connected_components
from sparkdense.llm.common import append_columns, stored

BANDS, ROWS_PER_BAND, LOW_BITS = 28, 4, 4
MINIMA = BANDS * ROWS_PER_BAND
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FINE_MINIMA = 1024
# Buckets of more members compare those that lie apart by blocks of about so many.
BLOCK_MEMBERS = 128
# Tells the texts of one doc_id apart: the leading 60 bits of the set's name.
PART = "CAST(conv(substr(hex(set_key), 1, 15), 16, 10) AS BIGINT) AS part"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of ``words`` words as sorted 64-bit hashes, whole text in array operations."""

    def __init__(self, words: int):
        self.words = words
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._powers(4096)

    def _powers(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(size, self.base, dtype=np.uint64))
            self.down = np.cumprod(np.full(size, self.inverse, dtype=np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode().translate(_LOWER), dtype=np.uint8)
        if not len(data):
            return np.empty(0, dtype=np.uint64)
        if len(data) >= len(self.up):
            self._powers(2 * len(data))
        edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
            words = _mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
            n = min(self.words, len(words))
            out = np.zeros(len(words) - n + 1, dtype=np.uint64)
            for i in range(n):
                out = _mixed(out * self.base + words[i : len(words) - n + 1 + i] + np.uint64(i + 1))
            if len(words) < self.words:
                out = _mixed(out + np.uint64(len(words) * 977))
        return np.unique(out)


_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(1, 1 << 63, FINE_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, FINE_MINIMA, dtype=np.uint64)


def minima(shingles: np.ndarray, number: int = MINIMA) -> np.ndarray:
    factor, shift = _FACTOR[:number], _SHIFT[:number]
    least = np.full(number, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1024 * MINIMA) // number)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), step):
            part = shingles[i : i + step, None] * factor + shift
            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return least


def packed_low_bits(least: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a long."""
    low = (least & np.uint64(15)).reshape(-1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX1
        for i in range(ROWS_PER_BAND):
            key = _mixed(key * MIX2 + least.reshape(BANDS, ROWS_PER_BAND)[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that name the set; null without words), low_bits, bands of every row."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("low_bits", T.ArrayType(T.LongType())),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]

    def make():
        shingler = Shingler(words)

        def work(texts):
            out: list[list] = [[], [], [], []]
            for text in texts:
                found = shingler.shingles(text)
                if len(found):
                    least = minima(found)
                    key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    row = (len(found), key, packed_low_bits(least), band_keys(least))
                else:
                    row = (0, None, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return append_columns(docs.select("doc_id", "text"), fields, ["text"], make).drop("text")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set_key, the full set as one binary of sorted 64-bit shingle hashes, and the low bits of 1,024 minima."""
    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("full", T.BinaryType()), T.StructField("fine", T.ArrayType(T.LongType()))]

    def make():
        shingler = Shingler(words)

        def work(texts):
            sets = [shingler.shingles(t) for t in texts]
            fine = [packed_low_bits(minima(x, FINE_MINIMA)) for x in sets]
            sets = [x.tobytes() for x in sets]
            return [[hashlib.blake2b(x, digest_size=16).digest() for x in sets], sets, fine]

        return work

    return append_columns(docs.select("doc_id", "text"), fields, ["text"], make).drop("text")


def _estimate_allows(percent: int, column: str = "low_bits", number: int = MINIMA, deviations: float = 6):
    """True unless the collision-corrected estimate lies ``deviations`` below the threshold."""
    threshold = percent / 100
    collide = 1 / (1 << LOW_BITS)
    equal = threshold + (1 - threshold) * collide
    least = number * equal - deviations * (number * equal * (1 - equal)) ** 0.5

    def differing(x, y):
        x = x.bitwiseXOR(y)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(x)

    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    # array functions, not one term a long: those of 1,024 minima grow beyond what can be compiled
    total = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda x, y: x + y)
    return (F.lit(number) - total) >= F.lit(least)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union on the full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("part").alias("a_part"), F.col("full").alias("full_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("part").alias("b_part"), F.col("full").alias("full_b"))
    both = pairs.join(left, ["a", "a_part"]).join(right, ["b", "b_part"])

    def make():
        def work(left, right):
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                union = np.concatenate([x, y])
                union.sort(kind="stable")
                shared = int((union[1:] == union[:-1]).sum())
                out.append(100 * shared >= percent * (len(x) + len(y) - shared))
            return [out]

        return work

    field = [T.StructField("linked", T.BooleanType())]
    return append_columns(both, field, ["full_a", "full_b"], make).where("linked").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are maximal runs without white space, A-Z in lower case; a text of fewer than ``words`` words is one shingle,
    a text without words (or null) has none and is linked with nothing. component_id is the least doc_id reachable over
    links of similarity ``percent`` or more. Rows of one doc_id are one document, which has the links of all its texts;
    null doc_ids are linked with nothing. Other columns are not read.
    """
    rows = stored(signatures(docs, words), "signatures")
    known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = known.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep")
    # a doc_id with several rows ties their classes together
    ties = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    reps = known.join(classes, (known["doc_id"] == classes["rep"]) & (known["set_key"] == classes["set_key"]), "left_semi")
    reps = reps.dropDuplicates(["doc_id", "set_key"]).selectExpr("doc_id AS rep", PART, "set_key", "low_bits", "bands")
    reps = stored(reps, "reps")
    banded = reps.select("rep", "part", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(shared, "buckets")
    in_buckets = banded.join(shared, "bucket").join(reps.select("rep", "part", "low_bits"), ["rep", "part"])
    in_buckets = stored(in_buckets, "members")
    candidates = stored(in_buckets.select("rep", "part").distinct().join(reps.select("rep", "part", "set_key"), ["rep", "part"]), "candidates")
    texts = docs.select("doc_id", "text").join(candidates.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = full_sets(texts, words).withColumnRenamed("doc_id", "rep").join(candidates, ["rep", "set_key"])
    sets = stored(sets.groupBy("rep", "part").agg(F.min(F.struct("full", "fine")).alias("x")).select("rep", "part", "x.full", "x.fine"), "sets")
    links, labels = ties, None
    if not ties.isEmpty():
        labels = stored(connected_components(ties.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "labels")
    for apart in (False, True):
        placed, spans = _open_buckets(in_buckets, labels)
        if spans.isEmpty():
            break
        found = _links_apart(placed, spans, reps, sets, percent) if apart else _links_of_pivots(placed, spans, sets, percent)
        links = stored(links.unionByName(found), "links")
        labels = stored(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "labels")
    out = rows.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    if labels is not None:
        out = out.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open_buckets(in_buckets: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The members with their component, and the buckets of more than one component with their least member, ``main``."""
    if labels is None:
        placed = in_buckets.withColumn("component", F.col("rep"))
    else:
        placed = in_buckets.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
        placed = placed.withColumn("component", F.coalesce("component", "rep"))
    placed = stored(placed, "placed")
    spans = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("rep", "part", "component", "low_bits")).alias("main")
    )
    return placed, stored(spans.where("low < high").select("bucket", "main"), "open")


def _ends(pairs: DataFrame) -> DataFrame:
    """Each pair once, the lesser end first."""
    a, b = F.struct("a.rep", "a.part"), F.struct("b.rep", "b.part")
    ends = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    return ends.select(F.col("x.rep").alias("a"), F.col("x.part").alias("a_part"), F.col("y.rep").alias("b"), F.col("y.part").alias("b_part"))


def _links_of_pivots(placed: DataFrame, spans: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of each open bucket's least member."""
    a, b = spans.select("bucket", "main.*").alias("a"), placed.alias("b")
    likely = (F.col("a.component") != F.col("b.component")) & _estimate_allows(percent)
    pairs = _ends(b.join(a, (F.col("a.bucket") == F.col("b.bucket")) & likely))
    return _confirmed(stored(pairs, "pairs"), sets, percent)


def _links_apart(placed: DataFrame, spans: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of members outside their bucket's main component with members of any other component.

    Links that join the same components may be left out.
    """
    opened = placed.join(spans.select("bucket", F.col("main.component").alias("main")), "bucket")
    opened = opened.join(reps.select("rep", "part", "bands"), ["rep", "part"]).join(sets.select("rep", "part", "fine"), ["rep", "part"])
    opened = stored(opened, "opened")
    members = opened.where(F.col("size") <= BLOCK_MEMBERS)
    a, b = members.where("component <> main").alias("a"), members.alias("b")
    likely = (F.col("a.component") != F.col("b.component")) & _estimate_allows(percent, "fine", FINE_MINIMA, 5)
    # a pair of which both are apart is taken once, and in the least bucket that it shares
    likely = likely & ((F.col("b.component") == F.col("b.main")) | (F.struct("a.rep", "a.part") < F.struct("b.rep", "b.part")))
    likely = likely & (F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.bucket"))
    pairs = _ends(b.join(a, (F.col("a.bucket") == F.col("b.bucket")) & likely))
    links = _confirmed(stored(pairs, "pairs"), sets, percent)
    return links.unionByName(_links_by_blocks(opened.where(F.col("size") > BLOCK_MEMBERS), sets, percent))


def _links_by_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The work of ``_links_apart`` in large buckets, where only links leave a task.

    The members apart are dealt over blocks, and each block meets a copy of all members, which stream past it.
    """
    blocks = members.where("component <> main").groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks"))
    columns = ["bucket", "block", "side", "rep", "part", "component", "main", "bands", "fine", "full"]
    rows = members.join(stored(blocks, "blocks"), "bucket").join(sets.select("rep", "part", "full"), ["rep", "part"])
    dealt = F.pmod(F.xxhash64("rep", "part"), F.col("blocks")).cast("int")
    own = rows.where("component <> main").withColumns({"block": dealt, "side": F.lit(0)}).select(*columns)
    other = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1)).select(*columns)
    met = own.unionByName(other).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side")

    def run(batches):
        key, block = None, None
        for batch in batches:
            data = batch.to_pydict()
            keys = list(zip(data["bucket"], data["block"], data["side"], strict=True))
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            found = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = {c: data[c][start:end] for c in columns[3:]}
                if keys[start][:2] != key:
                    key, block = keys[start][:2], _Block(keys[start][0], percent)
                if keys[start][2] == 0:
                    block.extend(part)
                else:
                    found += block.links(part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


class _Block:
    """Members of a bucket that lie apart, and the components that were found to be linked with theirs."""

    def __init__(self, bucket: int, percent: int):
        self.bucket, self.percent = bucket, percent
        self.rows: dict[str, list] = {}
        self.arrays: tuple[np.ndarray, np.ndarray] | None = None
        self.parent: dict[int, int] = {}
        share = percent / 100 + (1 - percent / 100) / (1 << LOW_BITS)
        self.most = FINE_MINIMA * (1 - share) + 5 * (FINE_MINIMA * share * (1 - share)) ** 0.5

    def extend(self, rows: dict[str, list]) -> None:
        self.arrays = None
        for name, values in rows.items():
            self.rows.setdefault(name, []).extend(values)

    def root(self, component: int) -> int:
        while component in self.parent:
            component = self.parent[component]
        return component

    def links(self, others: dict[str, list]) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        if not self.rows:
            return found
        if self.arrays is None:
            self.arrays = np.array(self.rows["bands"]), np.array(self.rows["fine"]).view(np.uint64)
        bands, fine = self.arrays
        for i in range(0, len(others["rep"]), BLOCK_MEMBERS):
            part = {c: v[i : i + BLOCK_MEMBERS] for c, v in others.items()}
            other = np.array(part["bands"])[None, :, :]
            shared = np.where(bands[:, None, :] == other, other, np.iinfo(np.int64).max).min(axis=2) == self.bucket
            rows, columns = np.nonzero(shared)
            bits = fine[rows] ^ np.array(part["fine"]).view(np.uint64)[columns]
            bits |= bits >> np.uint64(2)
            bits |= bits >> np.uint64(1)
            near = np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(axis=1) <= self.most
            for x, y in zip(rows[near].tolist(), columns[near].tolist(), strict=True):
                if self._is_link(x, part, y):
                    found.append((self.rows["rep"][x], part["rep"][y]))
        return found

    def _is_link(self, x: int, others: dict[str, list], y: int) -> bool:
        """True for a link that joins two components for the first time here."""
        own, other = self.root(self.rows["component"][x]), self.root(others["component"][y])
        if own == other:
            return False
        if others["component"][y] != others["main"][y]:
            if (self.rows["rep"][x], self.rows["part"][x]) > (others["rep"][y], others["part"][y]):
                return False  # both lie apart: taken once
        a, b = (np.frombuffer(v, dtype=np.uint64) for v in (self.rows["full"][x], others["full"][y]))
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common < self.percent * (len(a) + len(b) - common):
            return False
        self.parent[own] = other
        return True
