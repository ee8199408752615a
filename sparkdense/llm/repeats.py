"""Removal of long repeated byte strings by suffix arrays.

Every string of ``length`` bytes is represented by the least (rightmost if tied) hash of its windows of ``window``
bytes. Equal strings have equal representatives at equal offsets, so each start belongs to one group, named by that
hash, and is compared inside its group only. Groups of a hash that occurs once fall out before any text is moved; equal
contexts are one class and are counted, not compared. Of the distinct contexts of a group, the parts that can hold an
equal string are sorted by a suffix array and equal neighbours found there. Groups of too many contexts are cut by offset into groups that share a longer core, and
at last into single strings, which are only counted.

The suffix array is built by linear grouping: suffixes are grouped by first byte; groups are processed in descending
order, and the previous smaller suffix of each of their members, found through the pointers of greater groups, is moved
to a new group that stands for its longer Lyndon prefix. The final order follows from the groups alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.llm.common import append_columns, plain_text, stored

LENGTH, WINDOW = 400, 128
MAX_CLASSES = 64
PART_WIDTH = 40
WIDTHS = (24, 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in lexicographic order, by linear grouping."""
    n = len(text) + 1
    order = sorted(range(n - 1), key=text.__getitem__)
    order.insert(0, n - 1)
    place, group, size = [0] * n, [0] * n, [0] * n
    start, last = 0, -1
    for i, s in enumerate(order):
        byte = text[s] if s < n - 1 else -1
        if byte != last or not i:
            start, last = i, byte
        place[s], group[s] = i, start
        size[start] += 1
    previous = [-1] * n
    high = n - 1
    while high >= 0:
        low = group[order[high]]
        members = order[low : high + 1]
        if high > low:
            members.sort()
        counts: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        most = max(counts.values(), default=0)
        by_count = [list(counts)] if most == 1 else [[] for _ in range(most)]
        if most > 1:
            for p, k in counts.items():
                by_count[most - k].append(p)
        for moving in by_count:
            tails: dict[int, int] = {}
            for p in moving:
                g = group[p]
                end = tails.get(g)
                if end is None:
                    end = g + size[g]
                end -= 1
                tails[g] = end
                other, at = order[end], place[p]
                order[end], order[at] = p, other
                place[p], place[other] = end, at
            for p in moving:
                g = group[p]
                begin = tails[g]
                if begin > g:
                    group[p] = begin
            for g, begin in tails.items():
                if begin > g:
                    size[begin] = g + size[g] - begin
                    size[g] = begin - g
        high = low - 1
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    free[0] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = previous[s]
    return out[1:]


class Anchors:
    """Representatives of all strings of a text: hashes, positions, and the range of starts that each represents."""

    def __init__(self, length: int = LENGTH, window: int = WINDOW):
        self.length, self.window = length, window
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
        self.down = np.cumprod(np.full(n, inverse, dtype=np.uint64))

    def hashes(self, data: np.ndarray, width: int) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            self._powers(2 * len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        x = (sums[width:] - sums[:-width]) * self.down[: len(data) - width + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, position, first start, last start) of each representative, in order of position."""
        if len(data) < self.length:
            return (np.empty(0, dtype=np.int64),) * 4
        h = self.hashes(data, self.window)
        span = self.length - self.window + 1
        starts = len(data) - self.length + 1
        # least value and its rightmost place in each span, by doubling: the right half wins ties
        value, where, width = h, np.arange(len(h)), 1
        while 2 * width <= span:
            value, where = self._least(value[:-width], where[:-width], value[width:], where[width:])
            width *= 2
        rest = span - width
        if rest:
            value, where = self._least(value[:-rest], where[:-rest], value[rest:], where[rest:])
        where = where[:starts]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:], [starts]]) - 1
        at = where[first]
        return h[at].view(np.int64), at, first, last

    @staticmethod
    def _least(v1, w1, v2, w2):
        left = v1 < v2
        return np.where(left, v1, v2), np.where(left, w1, w2)


def _keyed(docs: DataFrame) -> DataFrame:
    """d and tag name a row: its id and the hash of its text. Equal rows share a name and count as often as they occur."""
    text = plain_text()
    unknown = F.lit(-(2**63)).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), unknown).alias("d"),
        F.xxhash64(text).alias("tag"), text.cast("binary").alias("bytes"),
    )


def _anchor_rows(keyed: DataFrame, length: int, window: int) -> DataFrame:
    anchors = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("key", "at", "first", "last")])

    def make():
        own = Anchors(length, window)
        return lambda texts: [list(c) for c in zip(*[[x.tolist() for x in own.of(np.frombuffer(t, np.uint8))] for t in texts], strict=True)]

    found = append_columns(keyed.select("d", "tag", "bytes"), anchors.fields, ["bytes"], make)
    zipped = F.explode(F.arrays_zip("key", "at", "first", "last")).alias("a")
    return found.select("d", "tag", zipped).select("d", "tag", "a.*")


_RANGE = [T.StructField(c, T.LongType()) for c in ("key", "at", "first", "last")]
_BYTES = [T.StructField("digest", T.BinaryType()), T.StructField("context", T.BinaryType())]
#: the starts of one representative in a document
_CONTEXT = T.StructType([T.StructField("d", T.LongType()), T.StructField("tag", T.LongType()), *_RANGE, *_BYTES])
#: starts of a class of equal contexts: owner is the digest of the class they first belonged to, n its documents
_CLASS = T.StructType([T.StructField("owner", T.BinaryType()), *_RANGE, *_BYTES, T.StructField("n", T.LongType())])


class _Emitter:
    """Context rows of one task; the bytes of equal contexts are sent once by each task."""

    def __init__(self, schema: T.StructType):
        self.arrow = to_arrow_schema(schema)
        self.seen: set[bytes] = set()
        self.rows: list[list] = [[] for _ in schema.fields]
        self.held = 0

    def add(self, before: tuple, context: bytes, after: tuple = ()) -> None:
        # classes are told apart by 128-bit digests of the context and of where its starts lie from the anchor
        *_, at, first, _ = before
        digest = hashlib.blake2b(context, digest_size=16, salt=(at - first).to_bytes(8, "little", signed=True)).digest()
        if digest in self.seen:
            context = None
        else:
            if len(self.seen) >= 200_000:
                self.seen.clear()
            self.seen.add(digest)
            self.held += len(context)
        for column, value in zip(self.rows, (*before, digest, context, *after), strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        made = [pa.array(v, type=f.type) for v, f in zip(self.rows, self.arrow, strict=True)]
        self.rows, self.held = [[] for _ in self.rows], 0
        return pa.RecordBatch.from_arrays(made, schema=self.arrow)

    def full(self) -> bool:
        return self.held > 8_000_000 or len(self.rows[0]) > 50_000


def _contexts(keyed: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """A row for each representative with a repeated hash: the starts it stands for, and the bytes they reach over."""
    repeated = stored(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    row = F.struct("at", "key", "first", "last")
    by_doc = anchors.join(repeated, "key").groupBy("d", "tag").agg(F.collect_set(row).alias("anchors"))
    by_doc = by_doc.select("d", "tag", *[F.col(f"anchors.{c}").alias(c) for c in ("at", "key", "first", "last")])
    joined = keyed.select("d", "tag", "bytes").join(stored(by_doc, "by-doc"), ["d", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(_CONTEXT)
        for batch in batches:
            for i in range(batch.num_rows):
                d, tag, text, *lists = (batch.column(c)[i].as_py() for c in range(7))
                for at, key, first, last in zip(*lists, strict=True):
                    out.add((d, tag, key, at, first, last), text[first : last + length])
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return joined.mapInArrow(run, _CONTEXT)


def _ranges(context: bytes, at: int, last: int, width: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, first start, last start, core) of the ranges of at most ``width`` starts of a context, from 0 to ``last``.

    Ranges are aligned by their distance from the anchor ``at``, as in every equal string. The core is what all strings
    of a full range share: any one of these strings holds it.
    """
    start = 0
    while start <= last:
        block = (at - start) // width
        high = at - block * width
        end = min(last, high)
        yield block, start, end, context[high : high - width + 1 + length]
        start = end + 1


def _parts(group: list[tuple[bytes, int, int, bytes]], length: int) -> list[tuple[bytes, int, int, bytes]]:
    """(digest, first start, last start, bytes) of those ranges of a group's contexts whose core another context has.

    Equal strings lie at equal distances from the anchor, so a string of any other range equals none of the group.
    """
    found = [
        (n, start, end, (block, core))
        for n, (_, last, at, context) in enumerate(group)
        for block, start, end, core in _ranges(context, at, last, PART_WIDTH, length)
    ]
    number = Counter(core for *_, core in found)
    out: list[list] = []
    before = None
    for n, start, end, core in found:
        if number[core] > 1:
            if before == (n, start):
                out[-1][2] = end
            else:
                out.append([n, start, end])
            before = (n, end + 1)
    return [(group[n][0], start, end, group[n][3][start : end + length]) for n, start, end in out]


def _narrower(classes: DataFrame, width: int, length: int) -> DataFrame:
    """The starts of classes in ranges of at most ``width``, keyed by the bytes that all strings of a range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(_CLASS)
        for batch in batches:
            for owner, key, at, first, last, _, context, n in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                for block, start, end, core in _ranges(context, at - first, last - first, width, length):
                    name = hashlib.blake2b(core, digest_size=8, key=block.to_bytes(8, "little", signed=True)).digest()
                    own = int.from_bytes(name, "little", signed=True) ^ key
                    out.add((owner, own, at, first + start, first + end), context[start : end + length], (n,))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return classes.mapInArrow(run, _CLASS)


def _repeated_in_group(length: int):
    """For the classes of a task's groups: which of their starts (first and last, as distances) lie in another class."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    arrow = to_arrow_schema(schema)

    def solve(group: list[tuple[bytes, int, int, bytes]]) -> list[tuple[bytes, int, int]]:
        text, owner, base = bytearray(), [], []
        parts = _parts(group, length)
        for n, (_, first, last, piece) in enumerate(parts):
            base.append(len(text) - first)
            owner += [n if i <= last - first else -1 for i in range(len(piece))]
            text += piece
        text = bytes(text)
        at = [s for s in suffix_array(text) if owner[s] >= 0]
        hit = sorted({s for pair in zip(at, at[1:], strict=False) if text[pair[0] : pair[0] + length] == text[pair[1] : pair[1] + length] for s in pair})
        out: list[list] = []
        for s in hit:
            digest, start = parts[owner[s]][0], s - base[owner[s]]
            if out and out[-1][0] == digest and out[-1][2] == start - 1:
                out[-1][2] = start
            else:
                out.append([digest, start, start])
        return [tuple(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def flush():
            found = solve(group) if len(group) > 1 else []
            made = [pa.array([x[i] for x in found], type=f.type) for i, f in enumerate(arrow)]
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for batch in batches:
            for own, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != key:
                    if group:
                        yield flush()
                    key, group = own, []
                group.append(tuple(row))
        if group:
            yield flush()

    return run, schema


def removed_runs(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(d, tag, runs): for each row name of ``docs`` with any, the sorted, disjoint byte runs (start, end) to remove."""
    keyed = _keyed(docs)
    anchors = stored(_anchor_rows(keyed, length, window), "anchors")
    contexts = stored(_contexts(keyed, anchors, length), "contexts")
    same = contexts.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("context").alias("context"), F.max(F.col("at") - F.col("first")).alias("at"),
        F.max(F.col("last") - F.col("first")).alias("last"),
    )
    first = F.lit(0).cast("long").alias("first")
    level = stored(same.select(F.col("digest").alias("owner"), "key", "at", first, "last", "digest", "context", "n"), "classes")
    found = None
    for width in (*WIDTHS, None):
        classes = level.groupBy("key", "digest").agg(
            F.sum("n").alias("n"), F.max("context").alias("context"), F.max(F.col("last") - F.col("first")).alias("span"),
            F.max(F.col("at") - F.col("first")).alias("at"),
        )
        classes = stored(classes, "classes")
        groups = stored(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "groups")
        copies = classes.where("n > 1").select("digest", F.lit(0).cast("long").alias("low"), F.col("span").alias("high"))
        # once a context is a single string, different contexts of one hash are different strings
        small = groups.where(F.col("classes") <= (MAX_CLASSES if width else 0)).select("key")
        run, schema = _repeated_in_group(length)
        members = classes.join(small, "key").select("key", "digest", "span", "at", "context")
        tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        solved = members.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, schema)
        equal = stored(copies.unionByName(solved), "equal")
        here = level.select("owner", "digest", "first").join(equal, "digest")
        here = here.select("owner", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
        found = here if found is None else found.unionByName(here)
        if width is None:
            break
        large = stored(groups.where(F.col("classes") > MAX_CLASSES).select("key"), "large")
        if large.isEmpty():
            break
        whole = level.drop("context").join(large, "key").join(classes.select("digest", "context"), "digest")
        level = stored(_narrower(whole.select(*_CLASS.names), width, length), "narrower")
    by_class = found.distinct().groupBy("owner").agg(F.collect_list(F.struct("low", "high")).alias("hits"))
    hits = contexts.select("d", "tag", "first", F.col("digest").alias("owner")).join(stored(by_class, "hits"), "owner")
    runs = F.transform(
        "hits", lambda x: F.struct((F.col("first") + x["low"]).alias("low"), (F.col("first") + x["high"] + length).alias("high"))
    )
    by_doc = hits.select("d", "tag", runs.alias("runs")).groupBy("d", "tag").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return by_doc.select("d", "tag", F.array_sort("runs").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Removed is each byte of the UTF-8 text that lies in a string of ``length`` bytes which also starts at another place
    of any row, the same one included, judged on the input. Null counts as empty; texts shorter than ``length`` lose
    nothing; rows that are equal throughout are copies of each other. ``with_kept`` adds the remaining bytes. Other
    columns are not read.
    """
    keyed = _keyed(docs)
    joined = keyed.join(stored(removed_runs(docs, length, window), "runs"), ["d", "tag"], "left")
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_bytes", T.BinaryType())] * with_kept

    def make():
        def work(texts, spans):
            out: list[list] = [[] for _ in fields]
            for text, found in zip(texts, spans, strict=True):
                runs: list[list[int]] = []
                for span in found or ():
                    if runs and span["low"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], span["high"])
                    else:
                        runs.append([span["low"], span["high"]])
                kept, at = [], 0
                for low, high in runs:
                    kept.append(text[at:low])
                    at = high
                rest = b"".join([*kept, text[at:]])
                row = (len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            return out

        return work

    found = append_columns(joined, fields, ["bytes", "spans"], make)
    return found.select("doc_id", *[f.name for f in fields])
