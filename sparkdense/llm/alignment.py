"""Alignment of two tokenizers over the same bytes.

Both encodings of a text are turned into cumulative byte ends, each kept in a dictionary from end to index. The ends
that both dictionaries hold, sorted, cut the two id lists into groups; inside a group every pair of overlapping tokens
is a link. How many documents hold an id pair is counted without moving the links: a task cuts its documents into
blocks of a bounded number of bytes and sums up each block's distinct pairs, only these sums are shuffled, and each
block gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.llm.bpe import PATTERN, load_ranks
from sparkdense.llm.common import append_columns, spread, stored
from sparkdense.session import broadcast_if_small

# Text bytes after which a block is closed; one longer document is a block of its own.
BLOCK_BYTES = 4 << 20
SPACE_MARK = "\u2581"


# A stretch starts at a space behind a character that is no white space, or at the space before the text.
_STRETCH = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
CACHED_STRETCHES = 300_000
CACHED_CHARS = 48


class Pieces:
    """A sentencepiece vocabulary: ids of a text and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        self.apart = True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            is_byte = self.model.is_byte(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(SPACE_MARK, " ").encode())
            self.apart &= SPACE_MARK not in piece.lstrip(SPACE_MARK)

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of ``text``, before which the model puts a space; None where they do not spell space and text."""
        ids = self.model.encode(text)
        spelled = b"".join(map(self.bytes_of.__getitem__, ids))
        return np.array(ids, dtype=np.int64) if spelled == (" " + text).encode() else None


class Aligner:
    """Both vocabularies. ``encode``, ``cuts``, ``links`` and ``spelled`` are the steps for one text.

    ``summary`` takes them for the stretches of a text that are new to it. No pre-token of A crosses the start of a
    stretch, and no merge of B does, as no piece holds a space behind another character: both encodings end a token there,
    and the groups of a text are those of its stretches one after the other.
    """

    def __init__(self, path_a: str, path_b: str):
        import tiktoken

        ranks = load_ranks(path_a)
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = Pieces(path_b)
        self.size_a, self.size_b = max(ranks.values(), default=-1) + 1, len(self.b.bytes_of)
        self.lengths_a = np.zeros(self.size_a, dtype=np.int64)
        self.lengths_a[list(ranks.values())] = [len(t) for t in ranks]
        self.lengths_b = np.array([len(t) for t in self.b.bytes_of], dtype=np.int64)
        # ids as text with the sign that follows them: inside a group, at the end of its first or second half
        signs = (self.size_a, ","), (self.size_a, "|"), (self.size_b, ","), (self.size_b, ";")
        names = [f"{i}{sign}" for size, sign in signs for i in range(size)]
        self.names = np.array(names, dtype=object)
        self.known: dict[str, tuple] = {}

    def summary(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """Numbers of A tokens, B tokens and groups, the groups as text, and the id pair of each link."""
        if not text:
            return self._whole("")
        stretches = _STRETCH.findall(" " + text)
        if not self.b.apart or SPACE_MARK in text or not self._learn(stretches):
            return self._whole(text)
        found = [self.known[s] for s in stretches]
        for long in [s for s in stretches if len(s) > CACHED_CHARS]:
            self.known.pop(long, None)
        n_a, n_b, n_groups = (sum([f[i] for f in found]) for i in range(3))
        pairs = np.frombuffer(b"".join([f[4] for f in found]), dtype="<i8")
        return n_a, n_b, n_groups, ";".join([f[3] for f in found]), pairs

    def _whole(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        ids_a, ids_b = self.encode(text)
        cut_a, cut_b, ends_a, ends_b = self.cuts(ids_a, ids_b)
        left, right, _ = self.links(ends_a, ends_b)
        return len(ids_a), len(ids_b), len(cut_a), self.spelled(ids_a, ids_b, cut_a, cut_b), ids_a[left] * self.size_b + ids_b[right]

    def _learn(self, stretches: list[str]) -> bool:
        """Align what is not known yet, all of it as one text; False if B does not spell it."""
        if len(self.known) > CACHED_STRETCHES:
            self.known.clear()
        new = list({s for s in stretches if s not in self.known})
        if not new:
            return True
        new.sort(key=lambda s: s[-1].isspace())  # only the last stretch of a text can end with white space
        ids_a, ids_b = self.encode("".join(new)[1:])
        if not len(ids_a):
            return False
        cut_a, cut_b, ends_a, ends_b = self.cuts(ids_a, ids_b)
        left, right, steps = self.links(ends_a, ends_b)
        groups = self.spelled(ids_a, ids_b, cut_a, cut_b).split(";")
        pairs = (ids_a[left] * self.size_b + ids_b[right]).astype("<i8").tobytes()
        to_a, to_b = np.array([0, *cut_a]), np.array([0, *cut_b])
        ends = np.cumsum([len(s.encode()) for s in new])
        to_group = [0, *(np.searchsorted(ends_a[to_a[1:] - 1], ends) + 1).tolist()]
        to_link = [0, *(8 * (np.searchsorted(steps, ends) + 1)).tolist()]
        n_a, n_b = np.diff(to_a[to_group]).tolist(), np.diff(to_b[to_group]).tolist()
        for i, stretch in enumerate(new):
            low, high = to_group[i], to_group[i + 1]
            self.known[stretch] = (n_a[i], n_b[i], high - low, ";".join(groups[low:high]), pairs[to_link[i] : to_link[i + 1]])
        return True

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space and text by A, of text by B; none where the bytes of either differ from space and text."""
        none = np.empty(0, dtype=np.int64)
        ids_b = self.b.encode(text) if text else None
        if ids_b is None:
            return none, none
        # byte-level tokens always spell the text that they come from
        return np.array(self.a.encode_ordinary(" " + text), dtype=np.int64), ids_b

    def cuts(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Where the groups end in either id list, and both lists of cumulative byte ends."""
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        index_a = dict(zip(ends_a.tolist(), range(1, len(ids_a) + 1), strict=True))
        index_b = dict(zip(ends_b.tolist(), range(1, len(ids_b) + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        return list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common)), ends_a, ends_b

    @staticmethod
    def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the tokens of every link, and the byte at which their overlap ends.

        Two tokens of a group overlap exactly once between neighbouring ends of either kind. The last ends of a group are
        equal, so the ends of all groups are gone through at once and no link leaves its group.
        """
        steps = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        steps = steps[np.diff(steps, prepend=0) > 0]
        return np.searchsorted(ends_a, steps), np.searchsorted(ends_b, steps), steps

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: list[int], cut_b: list[int]) -> str:
        """The groups as text: ids of A, a bar, ids of B; groups parted by semicolons."""
        if not cut_a:
            return ""
        ends_a, ends_b = np.array(cut_a, dtype=np.int64), np.array(cut_b, dtype=np.int64)
        name_a, name_b = ids_a.copy(), ids_b + 2 * self.size_a
        name_a[ends_a - 1] += self.size_a
        name_b[ends_b - 1] += self.size_b
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        # before a token of A come the tokens of B of all groups before, before one of B those of A of its own group, too
        order[np.arange(len(ids_a)) + np.repeat(ends_b - np.diff(ends_b, prepend=0), np.diff(ends_a, prepend=0))] = name_a
        order[np.arange(len(ids_b)) + np.repeat(ends_a, np.diff(ends_b, prepend=0))] = name_b
        return "".join(self.names[order].tolist())[:-1]


GROUP = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` plus ``groups``: the aligned groups of token ids of each whole ``text``, in order.

    Empty for a null or empty text and where a vocabulary can't spell the text. Other columns stay, except one named
    ``groups``; rows are independent.
    """

    def make():
        aligner = Aligner(path_a, path_b)

        def one(text):
            ids_a, ids_b = aligner.encode(text)
            cut_a, cut_b, _, _ = aligner.cuts(ids_a, ids_b)
            parts = zip([0, *cut_a], cut_a, [0, *cut_b], cut_b, strict=False)
            return [{"a": ids_a[p:q].tolist(), "b": ids_b[r:s].tolist()} for p, q, r, s in parts]

        return lambda texts: [[one(t) for t in texts]]

    return append_columns(docs, [T.StructField("groups", T.ArrayType(GROUP))], ["text"], make)


# A row is a document, or the sum of a block: its distinct pairs and how many of its documents hold each.
_ROWS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("is_sum", T.BooleanType()),
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
    ]
)
_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_PAIRS = T.StructType([T.StructField("block", T.LongType()), T.StructField("pair", T.LongType()), T.StructField("docs", T.LongType())])
_RESULT = T.StructType([f for f in _ROWS.fields if f.name in _DOCUMENT] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])


def _aligned(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """Documents and sums of blocks; a pair is ``id of A * size of B + id of B``, both lists of numbers are sorted by it."""
    arrow = to_arrow_schema(_ROWS)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def total(block: int, found: list[np.ndarray]) -> tuple:
        pairs, held = np.unique(np.concatenate(found), return_counts=True)
        return (block, None, True, None, None, None, None, None, pairs.astype("<i8").tobytes(), held.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        block, size, found = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if found and size + len(text or "") > block_bytes:
                    rows.append(total(block, found))
                    block, size, found = block + 1, 0, []
                n_a, n_b, n_groups, spelled, links = aligner.summary(text)
                digest = hashlib.sha256(spelled.encode()).hexdigest() if n_a else ""
                pairs, times = np.unique(links, return_counts=True)
                numbers = (n_a, n_b, n_groups, len(links), digest)
                rows.append((block, doc_id, False, *numbers, pairs.astype("<i8").tobytes(), times.astype("<u4").tobytes()))
                size += len(text or "")
                found.append(pairs)
            if rows:
                yield table(rows)
        if found:
            yield table([total(block, found)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def pair_counts(sums: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best): documents that hold a pair linked, and the highest such number of the pair's id of A."""
    counts = stored(sums.groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    id_a = F.expr(f"pair div {size_b}")
    best = counts.groupBy(id_a.alias("id_a")).agg(F.max("docs").alias("best"))
    return counts.withColumn("id_a", id_a).join(best, "id_a").select("pair", "docs", "best")


def alignment_statistics(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    ``n_best`` counts the links whose pair is held by as many documents as any pair of the same id of A, ``count_sum``
    adds up those documents over all links. Texts that are null, empty or not spelled exactly by both vocabularies have
    zeros and an empty digest. Every row is a document of its own, repeated ones too; other columns are not read.
    """
    size_b = len(Pieces(path_b).bytes_of)
    rows = stored(_aligned(spread(docs), path_a, path_b, block_bytes), "aligned")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_PAIRS)
        for batch in batches:
            for row in batch.to_pylist():
                pairs, held = np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["times"], "<u4").astype(np.int64)
                block = np.full(len(pairs), row["block"])
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(pairs), pa.array(held)], schema=schema)

    sums = rows.where("is_sum").select("block", "pairs", "times").mapInArrow(unpack, _PAIRS)
    sums = stored(sums, "sums")
    counts = broadcast_if_small(stored(pair_counts(sums, size_b), "counts"))
    wanted = sums.select("block", "pair").join(counts, "pair")
    arrow = to_arrow_schema(_RESULT)

    def look_up(documents: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("pair")
        pair, held, best = (found.column(c).to_numpy() for c in ("pair", "docs", "best"))
        is_best = held == best
        n_best, count_sum = [], []
        for pairs, times in zip(documents.column("pairs").to_pylist(), documents.column("times").to_pylist(), strict=True):
            at, often = np.searchsorted(pair, np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(often[is_best[at]].sum()))
            count_sum.append(int((often * held[at]).sum()))
        columns = [documents.column(c).combine_chunks() for c in arrow.names[:-2]]
        return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema=arrow)

    documents = rows.where("NOT is_sum").drop("is_sum")
    return documents.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(look_up, _RESULT)
