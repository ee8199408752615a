"""Tokenizer alignment against a plain version on the libraries' own ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdense.llm import alignment
from sparkdense.llm.bpe import ranks_of_json
from sparkdense.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), {i: t for t, i in ranks_of_json(PATHS[0]).items()}


def plain_rows(texts, libraries):
    """Per text: counts, groups as text, links as (id of A, id of B); every pair of tokens is compared."""
    a, b, spelled = libraries
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [spelled[i] for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[p:i], ids_b[q:j]))
            p, q = i, j
        links = []
        for i, x in enumerate(ids_a):
            for j, y in enumerate(ids_b):
                if max(ends_a[i] - len(bytes_a[i]), ends_b[j] - len(bytes_b[j])) < min(ends_a[i], ends_b[j]):
                    links.append((x, y))
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def plain_statistics(texts, libraries):
    rows = plain_rows(texts, libraries)
    held = Counter(pair for _, _, _, links in rows for pair in set(links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, k)) for g, k in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


WORDS = ["alpha", "béta", "<|endoftext|>", "<s>", "</s>", "<0x41>", "x1", "\n", "  ", "日本語", "🙂", "don't", "\t", "e\u0301", "1234567", "https://a.b/c?d=%20", "\x00", "\u00a0"]


def make_texts():
    random.seed(12)
    texts = [" ".join(random.choices(WORDS, k=random.randint(1, 25))) for _ in range(60)]
    texts += ["".join(random.choices(WORDS, k=random.randint(1, 25))) for _ in range(60)]
    return texts + ["", None, "a", " ", "\u2581", "x\u2581y", "\n\n", texts[0], texts[0], "word " * 4000, "z" * 3000]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block_bytes", [1, 500, alignment.BLOCK_BYTES])
def test_statistics(spark, libraries, block_bytes):
    texts = [t if t is None or len(t) < 2000 else t[:2000] for t in make_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.withColumn("block", F.lit("x")).withColumn("pairs", F.lit(1)).repartition(3)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_statistics(docs, *PATHS, block_bytes).collect()}
    assert found == dict(enumerate(plain_statistics(texts, libraries)))


def test_groups(spark, libraries):
    texts = [t for t in make_texts() if t is None or len(t) < 1000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, groups int")
    found = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in alignment.align(docs, *PATHS).collect()}
    assert found == {i: r[2] for i, r in enumerate(plain_rows(texts, libraries))}


def test_no_rows_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_statistics(none, *PATHS).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "a b"), (None, "a b"), (1, "")], "doc_id long, text string")
    rows = sorted((r["n_links"], r["count_sum"], r["doc_id"], r["groups_sha256"] != "") for r in alignment.alignment_statistics(odd, *PATHS).collect() if r["n_links"])
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0][1] == 2 * rows[0][0] and rows[0][2] is None
    assert alignment.alignment_statistics(odd, *PATHS).count() == 4
