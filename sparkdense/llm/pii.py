"""Personal data by candidate gradient boosting.

Generators of high recall propose overlapping spans: the four plain formats, whether or not their check digits hold,
and disguised forms (spelled-out addresses, bracketed dots, other separators, dialling prefixes). Boosted trees score
each span by its format and its context; thresholds calibrated for each kind on held-out candidates choose what is
added to the plain matches, which always stay. A candidate's label comes from the span freed of its disguise; plain
matches of the documents and a few made up here are also disguised artificially, so that there are examples of each kind.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdense.llm.boosting import BoostedTrees
from sparkdense.llm.common import append_columns, plain_text, stored

KINDS = ("email", "ip", "card", "phone")
# Thresholds lie on this many even steps, so that a kind's scores are that many counts at most.
STEPS = 2**16
PRECISION = 0.98
LEAST_CALIBRATION = 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_AT, _DOT = r"\s?(?:\[at\]|\(at\)|\{at\}|＠|@)\s?", r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\.)"
_SPELLED_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_MARKERS = r"[\[({](?:at|dot)[\])}]|＠"
_SPELLED_GATE = re.compile(_MARKERS, re.I)
_GATE = re.compile(rf"[0-9@]|{_MARKERS}", re.I)
_SPELLED_AT, _SPELLED_DOT = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_BRACKETED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({](?:\.|dot)[\])}]\s?[0-9]{1,3}){3}(?![0-9])")
_BRACKET_GATE = re.compile(r"[\[({](?:\.|dot)[\])}]")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ._/ -]{0,2}[0-9]){11,18}(?![0-9])")
_CARD_GROUPS = re.compile(r"[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2,3}(?:[ ._/-]{1,2}[0-9]{1,3})?|[0-9]{4}[ ._/-]{1,2}[0-9]{6}[ ._/-]{1,2}[0-9]{5}")
_GROUPED = re.compile(r"[0-9][ ()/-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00|\(0|0)[0-9 ()./-]{7,18}[0-9](?![0-9])")

# Words that point to a kind, before a span.
_CUES = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.I),
    "card": re.compile(r"card|visa|credit|pay|iban", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
}


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    doubled = (d * 2 - 9 * (d > 4) for d in values[-2::-2])
    return (sum(values[-1::-2]) + sum(doubled)) % 10 == 0


def _holds(kind: str, found: str) -> bool:
    """Whether a match of the kind's format, freed of disguises, passes the kind's check."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == "ip":
        parts = _DIGIT_RUNS.findall(found)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


_DIGIT_RUNS = re.compile(r"[0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ to the left over the local part, to the right over the domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        if domain:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if domain and start < at:
            last = domain.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def plain_matches(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's format, whether they pass the check or not."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text)]
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)] if "+" in text else []
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return _ordered(x for x in plain_matches(text) if _holds(x[0], text[x[1] : x[2]]))


def _ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All spans that any generator proposes; they may overlap."""
    found = {x for x in plain_matches(text) if x[0] != "card" or x[2] - x[1] >= 8}
    if _SPELLED_GATE.search(text):
        found |= {("email", m.start(), m.end()) for m in _SPELLED_EMAIL.finditer(text)}
    if _DIGIT.search(text):
        if _BRACKET_GATE.search(text):
            found |= {("ip", m.start(), m.end()) for m in _BRACKETED_IP.finditer(text)}
        found |= {("card", m.start(), m.end()) for m in _LOOSE_CARD.finditer(text)}
        found |= {("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)}
    return _ordered(found)


def undisguised(kind: str, found: str) -> str:
    """A span's text with signs in place of spelled-out or bracketed ones and + in place of the dialling prefix 00."""
    if kind == "email":
        return _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", found))
    if kind == "ip":
        return ".".join(_DIGIT_RUNS.findall(found))
    if kind == "phone" and found.startswith("00"):
        return "+" + found[2:]
    return found


def is_personal(text: str, span: tuple[str, int, int]) -> bool:
    """The label of a disguised candidate: freed of its disguise it passes its kind's check, and what digits alone do
    not tell (10 % of all numbers are Luhn numbers) is told by a word before it or by how its digits are grouped."""
    kind, start, end = span
    found = text[start:end]
    plain = undisguised(kind, found)
    if not _holds(kind, plain):
        return False
    if kind == "email":
        return _ADDRESS.fullmatch(plain) is not None
    if kind == "ip" or _CUES[kind].search(text[max(0, start - 24) : start]):
        return True
    if kind == "card":
        return _CARD_GROUPS.fullmatch(found) is not None
    return plain[0] == "+" and plain[1:2] != "0" and _GROUPED.search(found) is not None


def disguises(kind: str, found: str) -> list[str]:
    """Disguised forms of a plain match, and the same with its check broken."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        name, host = found.rsplit("@", 1)
        forms = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at} ", "."), ("＠", "."), ("@", "[dot]"))
        return [name + a + h.replace(".", d) for h in (host, host[: host.rindex(".")] + ".4") for a, d in forms]
    if kind == "ip":
        parts = _DIGIT_RUNS.findall(found)
        return [d.join(p) for p in (parts, [*parts[:3], "299"]) for d in ("[.]", "(.)", "[dot]", " [dot] ", "{.}")]
    if kind == "card":
        broken = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [d.join(n[i : i + 4] for i in range(0, len(n), 4)) for n in (digits, broken) for d in ("/", ".", "_", " - ", "  ")]
    return [f"{c}{d}{n[:2]}{d}{n[2:5]}{d}{n[5:]}" for n in (digits, digits[:5]) for c, d in (("00", " "), ("00", "-"), ("00", "/"), ("00", ""), ("0", " "))]


def examples(text: str) -> list[list[float]]:
    """Rows of features, whether the candidate stands in the text and is up to the model, and its label.

    Of the candidates that overlap plain spans only these spans themselves are there, as the others are never added.
    """
    base = base_spans(text)
    held, rows = set(base), []
    covered = sorted((s, e) for _, s, e in base)
    starts, ends, last = [s for s, _ in covered], [], 0
    for _, e in covered:
        ends.append(last := max(last, e))
    for span in candidates(text):
        if span in held:
            rows.append([*features(text, span), 0.0, 1.0])
        elif not (n := bisect_left(starts, span[2])) or ends[n - 1] <= span[1]:
            rows.append([*features(text, span), 1.0, float(is_personal(text, span))])
    for kind, start, end in base:
        before, after = text[max(0, start - 64) : start], text[end : end + 64]
        for form in disguises(kind, text[start:end]):
            made, span = before + form + after, (kind, len(before), len(before) + len(form))
            if span in candidates(made):
                rows.append([*features(made, span), 0.0, float(is_personal(made, span))])
    return rows


def _made_up(seed: int, count: int = 40) -> list[str]:
    """Short texts with one plain span each, ``count`` for each kind, half of them after a word that points to it."""
    rng, out = random.Random(seed), []
    words = "the report lists every item that was sent in before noon as agreed by both sides".split()
    cues = {"email": "contact mail", "ip": "server address", "card": "credit card", "phone": "phone call"}

    def some(n: int) -> str:
        return " ".join(rng.choices(words, k=n))

    def digits(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    for i in range(count):
        number = rng.choice("3456") + digits(14)
        number += next(d for d in "0123456789" if luhn(number + d))
        values = {
            "email": f"{rng.choice(words)}.{rng.choice(words)}@{rng.choice(words)}{digits(1)}.{rng.choice(('com', 'org', 'de', 'co.uk'))}",
            "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
            "card": " ".join(number[k : k + 4] for k in range(0, 16, 4)),
            "phone": f"+{rng.randrange(1, 99)} {rng.randrange(10, 999)} {digits(7)}",
        }
        out += [f"{some(5)} {rng.choice(cues[k].split()) if i % 2 else some(1)} {v} {some(5)}" for k, v in values.items()]
    return out


def _char_class(text: str, i: int) -> int:
    if i < 0 or i >= len(text):
        return 0
    c = text[i]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    kind, start, end = span
    found = text[start:end]
    digits = _NOT_DIGIT.sub("", found)
    runs = _DIGIT_RUNS.findall(found)
    before = text[max(0, start - 24) : start]
    around = text[max(0, start - 40) : end + 40]
    return [
        *(float(kind == k) for k in KINDS),
        len(found), len(digits), len(runs), max(map(len, runs), default=0), len(set(digits)),
        sum(map(str.isalpha, found)), sum(not c.isalnum() for c in found),
        float(bool(digits) and luhn(digits)), float(max((int(r[:9]) for r in runs), default=0) <= 255),
        float(found[:1] in "+0("), found.count("."), found.count("@"),
        float(_holds(kind, undisguised(kind, found))), float(_SPELLED_GATE.search(found) is not None),
        float(kind == "email" and _ADDRESS.fullmatch(undisguised(kind, found)) is not None),
        float(kind == "card" and _CARD_GROUPS.fullmatch(found) is not None), float(found.startswith("00")),
        float(_GROUPED.search(found) is not None),
        float(_CUES[kind].search(before) is not None), _char_class(text, start - 1), _char_class(text, end),
        sum(map(str.isdigit, around)) / max(1, len(around)),
    ]


class SpanModel:
    """Trees and one threshold for each kind; with no trees, or for a kind without enough evidence, nothing is added."""

    def __init__(self, trees: BoostedTrees | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def added(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """For each text, the spans beyond the plain ones that the model selects; none overlaps another or a plain one."""
        if self.trees is None:
            return [[] for _ in texts]
        proposals, rows = [], []
        for n, text in enumerate(texts):
            base = set(base_spans(text))
            for span in candidates(text):
                if span not in base:
                    proposals.append((n, span))
                    rows.append(features(text, span))
        scores = self.trees.predict(np.array(rows)) if rows else []
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        taken = {}
        for score, (n, span) in sorted(zip(scores, proposals, strict=True), key=lambda x: (-x[0], x[1])):
            if score < self.thresholds.get(span[0], 2.0):
                continue
            used = taken.setdefault(n, [(s, e) for _, s, e in base_spans(texts[n])])
            if all(span[2] <= s or e <= span[1] for s, e in used):
                used.append(span[1:])
                out[n].append(span)
        return out


def learn(docs: DataFrame) -> SpanModel:
    """Trees and thresholds from all candidates of the whole texts of all documents; a text that repeats counts once.

    A plain match that passes its kind's check is personal data, any other candidate if ``is_personal`` says so; besides
    there are plain matches disguised artificially, of the same documents and made up. Half of the texts (by hash)
    fit the trees, the other half calibrates the thresholds on what the model would add: the least score, in steps of
    1 / STEPS, from which on the share of true candidates among those that stand in the texts is at least PRECISION.
    Equal candidates are one row with their number; histograms and counts for each score come to the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(plain_text()).alias("h"), plain_text().alias("text"))
    texts = texts.where(F.col("text").rlike("(?i)" + _GATE.pattern))

    def make():
        def work(texts):
            return [[examples(t) for t in texts]]

        return work

    field = [T.StructField("rows", T.ArrayType(T.ArrayType(T.DoubleType())))]
    described = append_columns(texts, field, ["text"], make).select("h", F.posexplode("rows").alias("at", "row")).distinct()
    alike = described.groupBy(F.pmod("h", F.lit(2)).cast("int").alias("part"), "row").agg(F.count("*").alias("n"))
    alike = stored(alike, "pii_candidates")
    if alike.isEmpty():  # no candidate anywhere, so there is nothing to add
        return SpanModel(None, {})
    made = Counter((seed, tuple(row)) for seed in (0, 1) for text in _made_up(seed) for row in examples(text))
    alike = alike.unionByName(spark.createDataFrame([(part, [*map(float, row)], n) for (part, row), n in made.items()], alike.schema))
    width = len(next(iter(made))[1]) - 2
    trees = BoostedTrees().fit_cuts(alike.where("part = 0"), width)

    def bin_rows():
        def work(rows):
            table = np.array(rows)
            kinds = table[:, : len(KINDS)].argmax(axis=1).tolist()
            return [kinds, trees.packed(table[:, :width]), table[:, width].tolist(), table[:, width + 1].tolist()]

        return work

    fields = [T.StructField("kind", T.IntegerType()), T.StructField("bins", T.BinaryType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("natural", "y")]
    keys = ["part", *(f.name for f in fields)]
    counted = append_columns(alike, fields, ["row"], bin_rows).groupBy(*keys).agg(F.sum("n").alias("n"))
    counted = stored(counted, "pii_bins")
    trees.fit_counted(counted.where("part = 0"))

    def score():
        def work(bins):
            return [np.floor(trees.predict_packed(bins) * STEPS).astype(int).tolist()]

        return work

    scored = append_columns(counted.where("part = 1"), [T.StructField("step", T.IntegerType())], ["bins"], score)
    natural = F.col("natural") * F.col("n")
    sums = [F.sum(F.col("y") * F.col("n")), F.sum(natural), F.sum(natural * F.col("y"))]
    found = np.array([list(r) for r in scored.groupBy("kind", "step").agg(*sums).collect()])
    return SpanModel(trees, {kind: _threshold(found[found[:, 0] == i, 1:]) for i, kind in enumerate(KINDS)})


def _threshold(steps: np.ndarray) -> float:
    """From rows of a score's step and its numbers of true candidates, of natural ones and of natural true ones.

    Only natural candidates count for the precision, so that artificial ones do not make room for false ones.
    """
    step, truth, natural, right = steps[np.argsort(-steps[:, 0])].T
    if truth.sum() < LEAST_CALIBRATION:
        return 2.0
    n = np.cumsum(natural)
    share = np.where(n > 0, np.cumsum(right) / np.maximum(n, 1), 1.0)
    good = np.flatnonzero(share >= PRECISION)
    return max(0.5, float(step[good[-1]] / STEPS)) if len(good) else 2.0


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each maximal run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: SpanModel, with_redacted: bool = False) -> DataFrame:
    """``docs`` plus n_email, n_ip, n_card, n_phone and base_sha256 of the plain spans, and ``spans`` (all of them).

    Offsets are code points in the whole text, ends exclusive; a null text counts as empty and has no spans.
    ``with_redacted`` adds the redacted text (null stays null). Rows are independent.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    fields += [T.StructField("redacted", T.StringType())] * with_redacted
    trees, thresholds = model.trees, model.thresholds

    def make():
        own = SpanModel(trees, thresholds)

        def work(texts):
            plain = [t or "" for t in texts]
            busy = [i for i, t in enumerate(plain) if _GATE.search(t)]
            added = dict(zip(busy, own.added([plain[i] for i in busy]), strict=True))
            out: list[list] = [[] for _ in fields]
            for i, text in enumerate(plain):
                base = base_spans(text) if i in added else []
                spans = _ordered([*base, *added[i]]) if i in added else []
                row = [sum(s[0] == k for s in base) for k in KINDS]
                row += [hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)]
                row += [None if texts[i] is None else redacted(text, spans) if spans else text] * with_redacted
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return append_columns(docs, fields, ["text"], make)
