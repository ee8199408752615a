"""Secret scans: plain formats against the contract's patterns, nested encodings against planted places."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdense.llm import secrets

# The contract's patterns, written out without any shortcut.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_spans(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


PARTS = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef", "0123456789", "AKIA", "ABCDEFGH", "xyz/", "\u017fecret", "to\u212aen", "%3D", "\\u003d", "&#61;", "é", "\n"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=1500, deadline=None)
def test_base_spans(text):
    base, spans, _, _ = secrets.all_spans(text)
    assert base == plain_spans(text)
    assert set(base) <= set(spans) and all(0 <= s < e <= len(text) for _, s, e in spans)


SECRET = 'api_key = "Zx9.Qw8/Er7_Ty6"'
WRAPS = {
    "url": lambda b: urllib.parse.quote(b, safe="").encode(),
    "all_url": lambda b: "".join(f"%{x:02X}" for x in b).encode(),
    "unicode": lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode()).encode(),
    "html": lambda b: "".join(f"&#{ord(c)};" for c in b.decode()).encode(),
    "base64": base64.b64encode,
    "base64url": lambda b: base64.urlsafe_b64encode(b).rstrip(b"="),
    "gzip": lambda b: base64.b64encode(gzip.compress(b)),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)),
    "bz2": lambda b: base64.b64encode(bz2.compress(b)),
    "xz": lambda b: base64.b64encode(lzma.compress(b)),
    "zstd": lambda b: base64.b64encode(zstandard.compress(b)),
    "twice": lambda b: base64.b64encode(zlib.compress(gzip.compress(b))),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", WRAPS)
def test_nested_encodings(outer, inner):
    wrapped = WRAPS[outer](WRAPS[inner](b"note " + SECRET.encode() + b" end.")).decode()
    text = f"before é {wrapped} after"
    low, high = text.index(wrapped), text.index(wrapped) + len(wrapped)
    base, spans, layers, unopened = secrets.all_spans(text)
    assert base == plain_spans(text) and layers >= 1 and unopened == 0
    assert any(k == "assign" and low <= s < e <= high for k, s, e in spans)


@pytest.mark.parametrize("wrap", ["url", "all_url", "unicode", "html", "base64"])
def test_spans_are_narrow(wrap):
    """Encodings of single characters give the very place of the secret, not that of the whole run."""
    low, high = len(WRAPS[wrap](b"note ab ")), len(WRAPS[wrap](b"note ab " + SECRET[:-1].encode()))
    text = "é " + WRAPS[wrap](b"note ab " + SECRET.encode() + b" end.").decode()
    added = [x for x in secrets.all_spans(text)[1] if x[0] == "assign"]
    assert len(added) == 1
    assert abs(added[0][1] - 2 - low) <= 3 and abs(added[0][2] - 2 - high) <= 3


def test_deep_nesting_and_cycles():
    data = SECRET.encode()
    for _ in range(12):
        data = base64.b64encode(data)
    assert [k for k, _, _ in secrets.all_spans(data.decode())[1]] == ["assign"]
    chain = "%" + "25" * 50_000 + "41"
    assert ("assign", 0, 17 + len(chain)) in secrets.all_spans("token=" + "b" * 11 + chain)[1]
    assert secrets.all_spans("%41%25" * 2000)[1] == []


def test_bombs_stay_closed():
    bomb = base64.b64encode(gzip.compress(b"a b " * 100_000)).decode()
    base, spans, _, unopened = secrets.all_spans(f"x {bomb} y", limit=1000)
    assert base == spans == [] and unopened == 1
    assert secrets.all_spans(f"x {bomb} y")[3] == 0


def test_no_false_alarm():
    random.seed(4)
    plain = " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 14))) for _ in range(20_000))
    assert secrets.all_spans(plain)[1] == plain_spans(plain)
    assert secrets.all_spans("no password=%22short%22 here, 100%25 sure \\u00e9")[1] == []


def test_scan(spark):
    long = "word " * 200_000 + SECRET
    rows = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, "AKIA" + "A1" * 8), (4, long), (5, urllib.parse.quote("é " + SECRET))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("hex", F.lit("x"))
    found = secrets.scan(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        base = plain_spans(r["text"] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in base) for x in secrets.KINDS)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == joined or r["doc_id"] == 5
    assert next(r["spans"] for r in found if r["doc_id"] == 5).startswith("assign:")
    assert secrets.scan(docs.where("1 = 0")).count() == 0
