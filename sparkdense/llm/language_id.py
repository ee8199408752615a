"""Language identification by compression with one raw-content dictionary for each language.

A text, reduced to its letters in lower case, is compressed once with each language's dictionary, in windows of a fixed
number of characters so that a long text does not come to teach the compressor itself. The smallest total wins; the
margin to the next gives the score. A text is rejected when the margin, as a share of the size, is narrow, which is how
languages that were not learned show, or when windows that clearly prefer another language hold too much of it, which
is how mixtures show.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdense.llm.common import append_columns

DICTIONARY_BYTES = 110_000
SNIPPET_CHARS = 400
WINDOW_CHARS = 800
# Texts from this length on have two windows at least, so that mixtures show.
SPLIT_CHARS = 200
SHORT_CHARS = 1_000
# A second coder, which looks for longer matches, helps to tell short texts apart.
CODERS = ((zstandard.STRATEGY_LAZY, 4), (zstandard.STRATEGY_DFAST, 5))
BITS_PER_NAT = 24.0
# Share of the size that the winner must save against the next language.
MIN_MARGIN = 0.045
# A window belongs to another language when that saves this share of its size; share of a text such windows may hold.
FOREIGN_MARGIN = 0.03
MAX_FOREIGN = 0.2
MAX_LANGUAGES = 200
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def learn_dictionaries(
    labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, snippet_chars: int = SNIPPET_CHARS
) -> dict[str, bytes]:
    """One dictionary for each value of ``lang`` from (text, lang) rows.

    Bounded sample: at most ``dictionary_bytes`` for each language, in snippets from the middle of distinct texts taken
    in the order of their hash. Hashes below a cut-off for each language are kept before anything is sorted, so the
    sort sees a fixed number of rows. Null texts and languages teach nothing. At most MAX_LANGUAGES languages.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    wanted = dictionary_bytes // snippet_chars + 1
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    # of n hashes spread over 2^64, about 8 * wanted lie below the cut-off
    cut = F.lit(None).cast("long")
    for row in sizes:
        share = min(1.0, 8 * wanted / max(1, row["n"]))
        bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
        cut = F.when(F.col("lang") == row["lang"], F.lit(bound)).otherwise(cut)
    middle = F.greatest(F.lit(1), ((F.length("text") - snippet_chars) / 2).cast("int"))
    few = rows.where(F.col("h") <= cut).select("lang", "h", F.substring("text", middle, F.lit(snippet_chars)).alias("part"))
    few = few.groupBy("lang", "h").agg(F.min("part").alias("part"))
    best = few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "part"))), 1, wanted).alias("parts"))
    found = {}
    for row in best.collect():
        text = " ".join(letters(p["part"]) for p in row["parts"])
        found[row["lang"]] = text.encode()[-dictionary_bytes:]
    return found


def _windows(plain: str) -> list[bytes]:
    """The whole text in windows of equal length."""
    count = max(math.ceil(len(plain) / WINDOW_CHARS), 2 if len(plain) >= SPLIT_CHARS else 1)
    step = math.ceil(len(plain) / count)
    return [plain[i : i + step].encode() for i in range(0, len(plain), step)]


def _judged(windows: list[bytes], sizes: list[list[int]]) -> tuple[int, float, float, float]:
    """Number of the winner, score, relative margin and foreign share from the sizes of each window (one a language)."""
    totals = [sum(column) for column in zip(*sizes, strict=True)]
    least = min(totals)
    best = totals.index(least)
    evidence = sum(math.exp(-min(700.0, 8 * (s - least) / BITS_PER_NAT)) for s in totals)
    second = min((s for i, s in enumerate(totals) if i != best), default=None)
    margin = 1.0 if second is None else (second - least) / second
    foreign = sum(len(w) for w, own in zip(windows, sizes, strict=True) if own[best] - min(own) > FOREIGN_MARGIN * own[best])
    return best, 1.0 / evidence, margin, foreign / sum(map(len, windows))


def _coder(content: bytes, strategy: int, min_match: int) -> zstandard.ZstdCompressor:
    # digested once: a digested dictionary is attached to each window instead of being read again
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(3, window_log=18, min_match=min_match, strategy=strategy)
    kept.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=settings)


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, max_foreign: float = MAX_FOREIGN
) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1), rejected, margin and foreign_share.

    ``und`` with score 0, rejected, for a null text or one without a letter, or if no language was learned. Otherwise
    the language of the smallest size (ties: the least name). The score is the winner's share when each saved byte
    counts as evidence. Rejected: a ``margin`` below ``min_margin``, or a ``foreign_share`` above ``max_foreign``. Where
    only one language was learned there is nothing to compare and the margin is 1. Whole texts are read.
    """
    names = sorted(dictionaries)
    contents = [dictionaries[n] for n in names]

    def make():
        coders = [[_coder(c, *kind) for kind in CODERS] for c in contents]

        def one(text):
            plain = letters(text)
            if not plain or not coders:
                return "und", 0.0, True, 0.0, 0.0
            windows = _windows(plain)
            used = len(CODERS) if len(plain) <= SHORT_CHARS else 1
            sizes = [[sum(len(c.compress(w)) for c in own[:used]) for own in coders] for w in windows]
            best, score, margin, foreign = _judged(windows, sizes)
            return names[best], score, margin < min_margin or foreign > max_foreign, margin, foreign

        def work(texts):
            rows = [one(t) for t in texts]
            return [list(column) for column in zip(*rows, strict=True)]

        return work

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("foreign_share", T.DoubleType()),
    ]
    return append_columns(docs, fields, ["text"], make)
