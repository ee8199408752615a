"""Secrets in texts, also in nested encodings, by a worklist of layers.

A layer is a text with the place in the document that each of its characters comes from. Each layer is scanned for the
plain formats; then everything in it that can be unwrapped becomes a new layer: percent and Unicode escapes, base64
runs, and what such bytes unpack to. A layer that was seen before for the same place is not opened again, so the
worklist ends when nothing new comes out. Spans found in a layer are mapped back to the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkdense.llm.common import append_columns, spread

KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
# Bytes that one packed layer, and all packed layers of a document together, may unpack to: a guard against bombs.
MAX_UNPACKED = 64 << 20

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN = re.compile(rf"(?ai:password|passwd|secret|token|api_?key){_VALUE}")
_NAMES = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")

# An escape may hide the sign that starts another one any number of times (%252541); such a chain is one escape here.
_ONE_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_PERCENT = re.compile(rf"(?:{_ONE_PERCENT.pattern})+")
_ONE_ESCAPE = re.compile(
    r"\\u(?:005[cC]u)*(?:([0-9A-Fa-f]{4})|\{([0-9A-Fa-f]{1,6})\})|\\U([0-9A-Fa-f]{8})|\\x(?:5[cC]x)*([0-9A-Fa-f]{2})"
    r"|&(?:amp;|#38;)*#(?:([0-9]{1,7});|[xX]([0-9A-Fa-f]{1,6});)"
)
_ESCAPES = re.compile(rf"(?:{_ONE_ESCAPE.pattern})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_URL_ALPHABET = str.maketrans("-_", "+/")
# The first bytes of the packed formats.
_GZIP, _ZSTD, _BZ2, _XZ = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00"
_UNPRINTED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffe\uffff]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The plain formats: leftmost non-overlapping matches of each kind that are long enough, by start, then kind."""
    found = []
    if _NAMES.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return _ordered(found)


def _ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Layer:
    """A text whose character i comes from ``starts[i]`` to ``ends[i]`` of the document (None: the document itself)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the document that characters ``start`` to ``end`` come from."""
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def key(self) -> bytes:
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        digest.update(repr(self.place(0, len(self.text))).encode())
        return digest.digest()


def _as_text(data: bytes) -> str | None:
    """``data`` as text, if it is UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not _UNPRINTED.search(text) else None


class Budget:
    """What is left of the bytes that a document's packed layers may unpack to."""

    def __init__(self, limit: int = MAX_UNPACKED):
        self.left, self.unopened = limit, 0


def _unpack(data: bytes, budget: Budget) -> bytes | None:
    """The content of a packed stream, None if it is none; one beyond the budget is counted and stays closed."""
    if data.startswith(_GZIP):
        stream = zlib.decompressobj(31)
    elif data.startswith(_BZ2):
        stream = bz2.BZ2Decompressor()
    elif data.startswith(_XZ):
        stream = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    elif len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        stream = zlib.decompressobj()
    elif data.startswith(_ZSTD):
        import zstandard

        reader = zstandard.ZstdDecompressor(max_window_size=MAX_UNPACKED).stream_reader(data)
        return _within(budget, lambda limit: reader.read(limit), zstandard.ZstdError)
    else:
        return None
    return _within(budget, lambda limit: stream.decompress(data, limit), (zlib.error, OSError, lzma.LZMAError, EOFError))


def _within(budget: Budget, read, errors) -> bytes | None:
    try:
        found = read(budget.left + 1)
    except errors:
        return None
    if len(found) > budget.left:
        budget.unopened += 1
        return None
    budget.left -= len(found)
    return found


def _contents(data: bytes, budget: Budget) -> tuple[str | None, bool]:
    """Text that ``data`` holds, and whether it came out of a packed stream; streams may be packed several times."""
    packed = False
    while (inner := _unpack(data, budget)) is not None and inner != data:
        data, packed = inner, True
    return _as_text(data), packed


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that ``decode`` takes in place of it; its characters come from the escape they stood in."""
    parts, starts, ends, last = [], [], [], 0
    own_starts = np.arange(len(layer.text)) if layer.starts is None else layer.starts
    own_ends = np.arange(1, len(layer.text) + 1) if layer.ends is None else layer.ends
    for match in pattern.finditer(layer.text):
        found = decode(match[0])
        if found is None:
            continue
        text, firsts, lasts = found
        low, high = match.span()
        parts += [layer.text[last:low], text]
        starts += [own_starts[last:low], own_starts[low + np.array(firsts, dtype=np.int64)]]
        ends += [own_ends[last:low], own_ends[low + np.array(lasts, dtype=np.int64) - 1]]
        last = high
    if not parts:
        return None
    parts.append(layer.text[last:])
    return Layer("".join(parts), np.concatenate([*starts, own_starts[last:]]), np.concatenate([*ends, own_ends[last:]]))


def _bytes_of(run: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of a run of percent escapes and where each one's escape stands in it."""
    found = list(_ONE_PERCENT.finditer(run))
    return bytes(int(m[1], 16) for m in found), [m.span() for m in found]


def _percent(run: str) -> tuple[str, list[int], list[int]] | None:
    """Characters of a run of percent escapes, each with where its escapes start and end in the run.

    Bytes that are no UTF-8 and control characters stay as they are written.
    """
    data, spans = _bytes_of(run)
    parts, starts, ends, at, changed = [], [], [], 0, False
    for c in data.decode("utf-8", "surrogateescape"):
        size = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        low, high = spans[at][0], spans[at + size - 1][1]
        at += size
        if "\udc80" <= c <= "\udcff" or _UNPRINTED.match(c):
            parts.append(run[low:high])
            starts += range(low, high)
            ends += range(low + 1, high + 1)
        else:
            parts.append(c)
            starts.append(low)
            ends.append(high)
            changed = True
    return ("".join(parts), starts, ends) if changed else None


def _escapes(run: str) -> tuple[str, list[int], list[int]] | None:
    """Characters of a run of Unicode escapes; halves of a surrogate pair make one."""
    units, starts, ends = [], [], []
    for m in _ONE_ESCAPE.finditer(run):
        code = int(m[5]) if m[5] else int(next(filter(None, m.groups())), 16)
        low = units[-1] if units else 0
        if 0xDC00 <= code < 0xE000 and 0xD800 <= low < 0xDC00:
            units[-1], ends[-1] = 0x10000 + ((low - 0xD800) << 10) + code - 0xDC00, m.end()
            continue
        units.append(code)
        starts.append(m.start())
        ends.append(m.end())
    # what stands for no printed character stays as a mark of its own, so that its neighbours are still restored
    shown = [chr(u) if u <= 0x10FFFF and not 0xD800 <= u < 0xE000 else "\ufffd" for u in units]
    return _UNPRINTED.sub("\ufffd", "".join(shown)), starts, ends


def _decoded(run: str) -> bytes | None:
    """Bytes of a base64 run, padded or not, in the common or the URL alphabet."""
    bare = run.rstrip("=").translate(_URL_ALPHABET)
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _whole(layer: Layer, start: int, end: int, text: str) -> Layer:
    """``text`` as a layer whose every character comes from all of ``start`` to ``end``."""
    low, high = layer.place(start, end)
    return Layer(text, np.full(len(text), low), np.full(len(text), high))


def unwrapped(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers directly inside ``layer``."""
    text = layer.text
    if "%" in text:
        inner = _replaced(layer, _PERCENT, _percent)
        if inner:
            yield inner
        for match in _PERCENT.finditer(text):
            found, packed = _contents(_bytes_of(match[0])[0], budget)
            if packed and found:
                yield _whole(layer, *match.span(), found)
    if "\\" in text or "&#" in text:
        inner = _replaced(layer, _ESCAPES, _escapes)
        if inner:
            yield inner
    for match in _BASE64.finditer(text):
        data = _decoded(match[0])
        found, packed = _contents(data, budget) if data else (None, False)
        if not found:
            continue
        if packed:
            yield _whole(layer, *match.span(), found)
            continue
        # byte i stands in the four characters from 4 * (i // 3) on
        sizes = np.array([len(c.encode()) for c in found])
        last = np.cumsum(sizes)
        low = match.start() + (last - sizes) * 4 // 3
        high = np.minimum(match.start() + -(-last * 4 // 3), match.end())
        if layer.starts is None:
            yield Layer(found, low, high)
        else:
            yield Layer(found, layer.starts[low], layer.ends[high - 1])


def all_spans(text: str, limit: int = MAX_UNPACKED) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, layers opened beyond the text itself, and packed streams that were too large to open.

    A span that lies in a base span of its kind adds nothing and is left out.
    """
    base = base_spans(text)
    spans, budget = set(base), Budget(limit)
    work, seen, opened = [Layer(text)], set(), 0
    while work:
        layer = work.pop()
        for inner in unwrapped(layer, budget):
            key = inner.key()
            if key in seen or inner.text == text:
                continue
            seen.add(key)
            work.append(inner)
            opened += 1
            spans |= {(kind, *inner.place(start, end)) for kind, start, end in base_spans(inner.text)}
    if len(spans) > len(base):
        spans = set(base) | _outside(spans - set(base), base)
    return base, _ordered(spans), opened, budget.unopened


def _outside(added: set[Span], base: list[Span]) -> set[Span]:
    """Those of ``added`` that no base span of their kind holds; base spans of a kind do not overlap."""
    out = set()
    for kind in KINDS:
        own = [(s, e) for k, s, e in base if k == kind]
        starts, ends = np.array([s for s, _ in own], dtype=np.int64), np.array([e for _, e in own], dtype=np.int64)
        for k, start, end in added:
            if k == kind:
                at = int(np.searchsorted(starts, start, side="right")) - 1
                if at < 0 or ends[at] < end:
                    out.add((k, start, end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


FIELDS = [
    *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_layers", T.LongType()),
    T.StructField("n_unopened", T.LongType()),
]


def scan(docs: DataFrame, limit: int = MAX_UNPACKED) -> DataFrame:
    """``docs`` plus counts of base spans by kind, their digest, all spans, opened layers and unopened streams.

    The whole ``text`` is scanned; null counts as empty and has no spans. Spans are ``kind:start:end`` in code points,
    end exclusive, by start, then kind. A packed stream is opened only while all of a document's streams unpack to at
    most ``limit`` bytes; ``n_unopened`` counts the others. Rows are independent; columns that bear the name of a new
    one are replaced.
    """

    def make():
        def work(texts):
            columns = [[] for _ in FIELDS]
            for text in texts:
                base, spans, layers, unopened = all_spans(text or "", limit)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                for column, value in zip(columns, [*counts, digest, joined(spans), layers, unopened], strict=True):
                    column.append(value)
            return columns

        return work

    return append_columns(spread(docs), FIELDS, ["text"], make)
