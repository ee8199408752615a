"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens that may be disguised (figures and signs among
letters, separators between letters, letters spaced out or repeated) become a lattice of what each character may stand
for, and Viterbi decoding under the character model restores the likeliest word. Separators of spaced-out letters either
vanish or end a word, so that decoding also cuts a spaced-out text into its words. Tokens of any length are decoded. Restored words are scored by weights
of words and word beginnings, learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdense.llm.common import append_columns, plain_text, stored
from sparkdense.session import broadcast_if_small

# The alphabet of the character model: word end, the letters of its languages, anything else.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœßùúûüýÿ"
END, OTHER = 0, len(LETTERS) + 1
SYMBOLS = len(LETTERS) + 2
_SYMBOL = np.full(0x110000, END, dtype=np.int16)
_SYMBOL[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
_CAPITALS = [(c.upper(), i) for i, c in enumerate(LETTERS, 1) if len(c.upper()) == 1]
_SYMBOL[[ord(c) for c, _ in _CAPITALS]] = [i for _, i in _CAPITALS]

# What figures and signs commonly stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_DISGUISED = re.compile(r"[a-zà-ÿ][0-9@$!|+(€£¡*._\-]+[a-zà-ÿ]|^[0-9@$!|(€£¡]+[a-zà-ÿ]|([a-zà-ÿ])\1\1", re.I)
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ ._*-]{1,2}[^\W_]){2,}(?![^\W_])")
_SPACED_LETTER = re.compile(r"([^\W_])([ ._*-]*)")
_LEADING, _TRAILING = re.compile(r"[^\w@$!|(€£¡]+"), re.compile(r"[^\w@$€£]+")
_WORDS = re.compile(r"\S+")

SUBSTITUTION, DROP, COLLAPSE = -1.0, -0.5, -0.2
WIDE_GAP_VANISHES = -2.0
COMMIT_STEPS = 256
CACHED_CHARS = 64
LABELLED_DOCUMENTS = 12_000
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS = 4
LEAST_WEIGHT = 2.0
PREDICTED_AT = 0.7
CACHED_WORDS = 300_000


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the letters of all texts; tasks send at most SYMBOLS^3 sums each, added up in Spark."""
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                    ids = np.concatenate([[0, 0], _SYMBOL[points].astype(np.int64), [0]])
                    np.add.at(counts, (ids[:-2] * SYMBOLS + ids[1:-1]) * SYMBOLS + ids[2:], 1)
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts[codes], pa.int64())], schema=arrow)

    sums = docs.select(plain_text().alias("text")).mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n"))
    total = np.zeros(SYMBOLS**3)
    for row in sums.toLocalIterator():  # at most SYMBOLS^3 rows
        total[row["code"]] = row["n"]
    return total.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigram mixed with bigram and unigram."""
    one = counts.sum(axis=(0, 1)) + 1.0
    two = counts.sum(axis=0) + 0.5
    p1 = one / one.sum()
    p2 = two / two.sum(axis=1, keepdims=True)
    total = counts.sum(axis=2, keepdims=True)
    mixed = (counts + 2.0 * p2[None, :, :]) / (total + 2.0)
    return np.log(0.9 * mixed + 0.09 * p2[None, :, :] + 0.01 * p1[None, None, :]).astype(np.float32)


def _readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal characters, what it may stand for and the channel's cost."""
    out, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, length = token[i], j - i
        options: list[tuple[str, float]] = []
        if c.isalpha():
            if length < 3:
                options.append((c * length, 0.0))
            else:
                options += [(c, COLLAPSE), (c * 2, COLLAPSE)]
        for letter in LEET.get(c, ""):
            options.append((letter, SUBSTITUTION))
            if length > 1:
                options.append((letter * 2, SUBSTITUTION))
        if not c.isalnum():
            options.append(("", DROP if i and j < len(token) else COLLAPSE))
        elif not options:
            options.append(("", 4 * SUBSTITUTION))
        out.append(options)
        i = j
    return out


def _spaced_readings(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of spaced-out letters: each separator vanishes or ends a word; a letter three times may be repeated."""
    out, letters, i = [], _SPACED_LETTER.findall(run), 0
    while i < len(letters):
        j = i
        while j < len(letters) and letters[j][0] == letters[i][0]:
            j += 1
        together = j - i if j - i >= 3 else 1
        for k in range(i, j, together):
            out += _readings(letters[k][0] * together)
            gap = letters[k + together - 1][1]
            out.append([("", WIDE_GAP_VANISHES if len(gap) > 1 else 0.0), (" ", 0.0)])
        i = j
    return out[:-1]


def decode(token: str, logp: np.ndarray, spaced: bool = False) -> str:
    """The likeliest word behind a token in lower case: Viterbi over the lattice, with the last two letters as state.

    With ``spaced``, the words behind a run of spaced-out letters, with a space between two. What all states agree on
    is put aside every COMMIT_STEPS steps, so work and memory grow with the length only.
    """
    start = (END, END)
    beam, done = {start: (0.0, "")}, []
    for step, options in enumerate(_spaced_readings(token) if spaced else _readings(token), 1):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in beam.items():
            for letters, cost in options:
                x, y, total = a, b, score + cost
                for c in letters:
                    z = END if c == " " else int(_SYMBOL[ord(c)]) or OTHER
                    total += float(logp[x, y, z])
                    x, y = y, z
                if (x, y) not in following or following[x, y][0] < total:
                    following[x, y] = (total, word + letters)
        beam = following
        if step % COMMIT_STEPS == 0:
            same = len(commonprefix([w for _, w in beam.values()]))
            done.append(next(iter(beam.values()))[1][:same])
            beam = {k: (s, w[same:]) for k, (s, w) in beam.items()}
    best = max(((s + float(logp[a, b, END]), w) for (a, b), (s, w) in beam.items()), key=lambda v: v[0])[1]
    return "".join([*done, best])


def _trimmed(token: str) -> str:
    lead = _LEADING.match(token)
    word = token[lead.end() :] if lead else token
    tail = _TRAILING.match(word[::-1])
    return word[: len(word) - tail.end()] if tail else word


class Restorer(dict):
    """Token in lower case -> restored word, or words behind spaced-out letters, with a space between two.

    Ordinary tokens only lose the signs at their ends; forgets all when full.
    """

    def __init__(self, logp: np.ndarray):
        super().__init__()
        self.logp = logp

    def __missing__(self, token: str) -> str:
        word = _trimmed(token)
        if _SPACED.fullmatch(token):
            letters = "".join(c for c in token if c.isalnum())
            word = letters if letters.isdigit() else decode(token, self.logp, spaced=True)
        elif _DISGUISED.search(word):
            word = decode(word, self.logp)
        else:
            word = word.strip("!@$|(€£¡")
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[token] = word
        return word


def tokens(text: str) -> set[str]:
    """Distinct tokens in lower case; a run of letters that are spaced out is one more token, as it stands."""
    lower = text.lower()
    found = set(lower.split())
    if _SPACED_GATE.search(lower):
        found.update(match.group() for match in _SPACED.finditer(lower))
    return found


_SPACED_GATE = re.compile(r"(?<!\S)[^\W_][ ._*-]{1,2}[^\W_][ ._*-]{1,2}[^\W_]")


def restored(text: str, restorer: Restorer) -> str:
    """The whole text with every token restored, for reading."""
    joined = _SPACED.sub(lambda m: restorer[m.group()], text.lower())
    return _WORDS.sub(lambda m: restorer[m.group()] or m.group(), joined)


def restored_words(text: str, restorer: Restorer) -> set[str]:
    return {word for token in tokens(text) for word in restorer[token].split()}


def terms(words: set[str]) -> set[str]:
    """Words and word beginnings (ending in *)."""
    out = set()
    for word in words:
        if len(word) >= 3:
            out.add(word)
            out.update(word[:n] + "*" for n in PREFIXES if len(word) > n)
    return out


class ToxicityModel:
    """Term weights and a logistic curve over the two highest weights of a document's words."""

    def __init__(self, logp: np.ndarray, weights: dict[str, float], curve: tuple[float, float, float]):
        self.logp, self.weights, self.curve = logp, weights, curve

    def scorer(self):
        restorer, weights, (base, first, rest) = Restorer(self.logp), self.weights, self.curve
        own = _WordWeights(restorer, weights)

        def score(text: str) -> float:
            found = own.highest(text)
            x = base + (first * found[0] + rest * sum(found[1:]) if found else 0.0)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))

        return score


class _WordWeights(dict):
    """Token in lower case -> weights of the words behind it, without zeros."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def __missing__(self, token: str) -> tuple[float, ...]:
        words = sorted(set(self.restorer[token].split()))
        best = (max((self.weights.get(t, 0.0) for t in terms({word})), default=0.0) for word in words)
        weights = tuple(filter(None, best))
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[token] = weights
        return weights

    def highest(self, text: str) -> list[float]:
        """The three highest weights of a text's words, highest first."""
        return sorted(chain.from_iterable(map(self.__getitem__, tokens(text))), reverse=True)[:3]


def labelled_sample(docs: DataFrame, labels: DataFrame, labelled_documents: int) -> DataFrame:
    """(text, toxic) of at most about ``labelled_documents`` distinct texts of each label, chosen by hash; a stored table.

    Only ids and hashes of the documents meet the labels; the texts of those chosen, a bounded number, are fetched after
    that. The sample is empty unless there are labels of both kinds.
    """
    digest = F.xxhash64(plain_text())
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = stored(docs.select("doc_id", digest.alias("h")).join(known, "doc_id"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.approx_count_distinct("h").alias("n")).collect()}
    cut = F.lit(None).cast("long")
    for label, n in sizes.items() if len(sizes) == 2 else ():
        bound = min(2**63 - 1, int(-(2**63) + min(1.0, labelled_documents / max(1, n)) * 2**64))
        cut = F.when(F.col("toxic") == label, F.lit(bound)).otherwise(cut)
    chosen = broadcast_if_small(stored(rows.where(F.col("h") <= cut).dropDuplicates(["h", "toxic"]), "chosen"))
    texts = docs.select("doc_id", digest.alias("h"), plain_text().alias("text")).join(chosen, ["doc_id", "h"])
    return stored(texts.select("text", "toxic", "h").dropDuplicates(["h", "toxic"]), "sample")


def learn(docs: DataFrame, labels: DataFrame, labelled_documents: int = LABELLED_DOCUMENTS) -> ToxicityModel:
    """The character model from all ``docs``, the weights from those with a row in ``labels`` (doc_id, toxic).

    Labels come from a bounded sample: at most about ``labelled_documents`` documents of each label, chosen by hash.
    A term gets a weight when it occurs in LEAST_DOCUMENTS toxic documents or more and its smoothed log ratio of
    document frequencies is at least LEAST_WEIGHT. Without labels of both kinds every score is one half.
    """
    logp = log_probabilities(character_counts(docs))
    sample = labelled_sample(docs, labels, labelled_documents)
    if sample.isEmpty():
        return ToxicityModel(logp, {}, (0.0, 0.0, 0.0))
    counted, n = _term_counts(sample, logp)
    kept = counted.where((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("bad") / n[1] > math.exp(LEAST_WEIGHT) * F.col("good") / n[0]))
    weights = {}
    for row in kept.toLocalIterator():  # terms of a bounded sample
        weight = math.log((row["bad"] + 0.5) / (n[1] + 1)) - math.log((row["good"] + 0.5) / (n[0] + 1))
        if weight >= LEAST_WEIGHT:
            weights[row["term"]] = weight
    weights = _without_longer(weights)
    return ToxicityModel(logp, weights, _curve(sample, logp, weights))


def _without_longer(weights: dict[str, float]) -> dict[str, float]:
    """Leave out terms whose beginning weighs as much: the shorter one says it for all."""

    def covered(term: str) -> bool:
        word = term.rstrip("*")
        return any(weights.get(word[:n] + "*", 0.0) >= weights[term] for n in PREFIXES if n < len(word) or (n == len(word) and term != word + "*"))

    return {t: w for t, w in weights.items() if not covered(t)}


def _term_counts(sample: DataFrame, logp: np.ndarray):
    schema = T.StructType([T.StructField(c, t) for c, t in (("term", T.StringType()), ("bad", T.LongType()), ("good", T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(logp), (Counter(), Counter())

        def flush():
            names = list(counts[1].keys() | counts[0].keys())
            made = [names, [counts[1][t] for t in names], [counts[0][t] for t in names]]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(terms(restored_words(text, restorer)))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush()
        yield flush()

    numbers = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counted = sample.select("text", "toxic").mapInArrow(run, schema)
    counted = counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return counted, {k: max(1, numbers.get(k, 0)) for k in (0, 1)}


def _curve(sample: DataFrame, logp: np.ndarray, weights: dict[str, float]) -> tuple[float, float, float]:
    """Logistic regression, by Newton steps, of the label on the highest weight and the sum of the next two."""

    def make():
        own = _WordWeights(Restorer(logp), weights)

        def work(texts):
            best = [own.highest(t) for t in texts]
            return [[b[0] if b else 0.0 for b in best], [float(sum(b[1:])) for b in best]]

        return work

    fields = [T.StructField("first", T.DoubleType()), T.StructField("rest", T.DoubleType())]
    scored = append_columns(sample, fields, ["text"], make)
    # a bounded sample, and few distinct rows of it
    found = scored.groupBy("toxic", F.round("first", 2).alias("first"), F.round("rest", 2).alias("rest")).count().collect()
    x = np.array([[1.0, r["first"], r["rest"]] for r in found])
    y, n = np.array([float(r["toxic"]) for r in found]), np.array([float(r["count"]) for r in found])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - np.array([0.0, 0.1, 0.1]) * beta
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        beta = beta + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(beta[0]), float(max(0.0, beta[1])), float(max(0.0, beta[2]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from PREDICTED_AT on) of every whole text.

    Null and empty texts get the score of a text without any weighted word. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.logp, model.weights, model.curve))  # bounded by the alphabet and the sample

    def make():
        one = ToxicityModel(*shared.value).scorer()

        def work(texts):
            scores = [one(t or "") for t in texts]
            return [scores, [int(s >= PREDICTED_AT) for s in scores]]

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(docs, fields, ["text"], make)
