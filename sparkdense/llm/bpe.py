"""Byte-level BPE by monoid tree reduction.

A stretch of text is represented by its token ids. Halves are encoded on their own, down to leaves, and neighbours are
joined by re-encoding a window around the cut. The window grows (32, 64, ... characters) until it starts and ends at a
stable place: a space or newline that follows a character which is no white space. The pre-token pattern has no
look-behind, and no match of it holds white space after another character, so a match starts at every stable place in
the whole text as in either half; all tokens outside the window are therefore those of the whole text. Decoding
concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkdense.llm.common import append_columns

# The pre-token pattern of the public byte-level vocabularies, as their file gives it.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
_STABLE = re.compile(r"\S(?=[ \n])")
_ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
LEAF_CHARS = 4096
CACHED_WORDS = 300_000
CACHED_WORD_CHARS = 64


def ranks_of_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary whose file spells each byte as a printable character."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain}
    spelled |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in content.get("added_tokens", [])}
    vocabulary = content["model"]["vocab"].items()
    return {bytes(spelled[c] for c in token): rank for token, rank in vocabulary if token not in special}


def load_ranks(path: str) -> dict[bytes, int]:
    return ranks_of_json(path) if path.endswith(".json") else ranks_of_tiktoken(path)


class Words(dict):
    """Ids of words that follow a space, as little-endian bytes; forgets all when full."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.lead + word), dtype="<u4").tobytes()
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary. ``encode`` works up the tree, ``encode_leaf`` from left to right."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        ranks = load_ranks(path)
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars = leaf_chars
        self.after_space = Words(encoding.encode_ordinary, " ")
        self.first = Words(encoding.encode_ordinary, "")
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of], dtype=np.int64)

    def encode_leaf(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; single spaces between words are stable places."""
        if not text:
            return b""
        words = _INNER_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        head = self.first[words[0]]
        return head + b"".join(map(self.after_space.__getitem__, words[1:])) if len(words) > 1 else head

    def encode(self, text: str) -> bytes:
        return self._encode(text, 0, len(text)).tobytes()

    def _encode(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf_chars:
            return np.frombuffer(self.encode_leaf(text[low:high]), dtype="<u4")
        cut = (low + high) // 2
        left, right = self._encode(text, low, cut), self._encode(text, cut, high)
        return self._join(text, low, cut, high, left, right)

    def _join(self, text: str, low: int, cut: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if text[cut] in " \n" and not text[cut - 1].isspace():
            return np.concatenate([left, right])
        start = self._stable_before(text, low, cut)
        end = self._stable_after(text, cut, high)
        keep = len(left) - self._tokens_in(left[::-1], text[start:cut])
        skip = self._tokens_in(right, text[cut:end])
        window = np.frombuffer(self.encode_leaf(text[start:end]), dtype="<u4")
        return np.concatenate([left[:keep], window, right[skip:]])

    @staticmethod
    def _stable_before(text: str, low: int, cut: int) -> int:
        width = 32
        while True:
            begin = max(low, cut - width)
            found = [m.end() for m in _STABLE.finditer(text, begin, cut)]
            if found:
                return found[-1]
            if begin == low:
                return low
            width *= 2

    @staticmethod
    def _stable_after(text: str, cut: int, high: int) -> int:
        width = 32
        while True:
            end = min(high, cut + width)
            found = _STABLE.search(text, cut, end)
            if found:
                return found.end()
            if end == high:
                return high
            width *= 2

    def _tokens_in(self, ids: np.ndarray, piece: str) -> int:
        """How many of the leading ids spell ``piece``."""
        wanted, count = len(piece.encode()), 64
        if not wanted:
            return 0
        while True:
            spelled = np.cumsum(self.lengths[ids[:count]])
            if spelled[-1] >= wanted:
                return int(np.searchsorted(spelled, wanted)) + 1
            count *= 2

    def decode(self, ids: bytes, leaf: int = 4096) -> bytes:
        return self._decode(np.frombuffer(ids, dtype="<u4").tolist(), leaf)

    def _decode(self, ids: list[int], leaf: int) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self._decode(ids[:half], leaf) + self._decode(ids[half:], leaf)


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` plus ``ids`` (binary, little-endian unsigned 32-bit) of the whole ``text``; null counts as empty.

    Empty texts have no ids. Any other columns stay, except one named ``ids``. Rows are independent.
    """

    def make():
        bpe = ByteBpe(path, leaf_chars)
        return lambda texts: [[bpe.encode(t or "") for t in texts]]

    return append_columns(docs, [T.StructField("ids", T.BinaryType())], ["text"], make)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` plus ``decoded`` (binary): the bytes that ``ids`` spell; null ids spell nothing."""

    def make():
        bpe = ByteBpe(path)
        return lambda ids: [[bpe.decode(x or b"") for x in ids]]

    return append_columns(encoded, [T.StructField("decoded", T.BinaryType())], ["ids"], make)


def round_trip(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` plus digests of the ids and of the bytes decoded from them, in one pass: no ids leave the task.

    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; a null text counts as empty.
    """

    def make():
        bpe = ByteBpe(path, leaf_chars)

        def work(texts):
            counts, of_ids, of_bytes = [], [], []
            for text in texts:
                ids = bpe.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [counts, of_ids, of_bytes]

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return append_columns(docs, fields, ["text"], make)
