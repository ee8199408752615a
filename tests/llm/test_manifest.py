"""Merkle manifest against a plain tree, whole rows and odd ones."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkdense.llm import merkle
from sparkdense.llm.common import crc32_of

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    values = [None if v is None else str(v) for v in row]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Root and, for each node, the steps from it to the root."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place - place % 3
            paths[i].append(("".join(level[start:place]), "".join(level[place + 1 : start + 3])))
            at[i] = place // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return (level[0] if level else None), paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), *plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])])) for s in order}
    root, top = plain_tree([trees[s][1] for s in order])
    out = []
    for s, upper in zip(order, top, strict=True):
        members, subroot, paths = trees[s]
        for (_, _, leaf, row), own in zip(members, paths, strict=True):
            path = own + upper
            later = leaf
            if row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 == 0:
                later = plain_leaf((*row[:4], None if row[4] is None else row[4].replace("\n", "")))
            for left, right in path:
                later = h(left, later, right)
            out.append((row[0], leaf, subroot, root, h(*[x for step in path for x in step]), later, later == root))
    return out


def run(spark, rows, every=None):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit("x")).withColumn("path", F.lit(1)).repartition(5)
    even = crc32_of(F.col("doc_id")) % 2 == 0
    return merkle.verify(docs, even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def key(row):
    return tuple(map(str, row))


ODD = [
    (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 4, "x\ny"), (None, "a", None, None, None), (None, None, None, None, None),
    (2, None, "é", 0, ""), (3, "", "en", 1, "\n"), (4, "ñ", None, 2, "ü\n\n"), (5, "z", "de", 7, "no line"), (6, "Z", "de", 7, "one\nline" * 20_000),
]


@pytest.mark.parametrize("every", [1, 2, 6])
def test_rows_of_every_kind(spark, monkeypatch, every):
    monkeypatch.setattr(merkle.forest, "__defaults__", (3, every))
    monkeypatch.setattr(merkle.manifest, "__defaults__", (3, every))
    rows = ODD + [(i, f"s{i % 4}" if i % 3 else "hot", "en", i, "line\n" * (i % 3)) for i in range(10, 140)]
    found = sorted(map(tuple, run(spark, rows).collect()), key=key)
    assert found == sorted(plain_manifest(rows), key=key)


@pytest.mark.parametrize("sizes", [[], [1], [28], [1, 2, 3, 4, 9, 10, 28, 82]])
def test_sizes_of_sources(spark, sizes):
    rows = [(100 * n + i, f"s{n}", None, 1, f"t{i}\n") for n in sizes for i in range(n)]
    found = sorted(map(tuple, run(spark, rows).collect()), key=key)
    assert found == sorted(plain_manifest(rows), key=key)


def test_a_change_is_seen(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"t{i}\n") for i in range(40)]
    for row in run(spark, rows).collect():
        assert row["verified"] == (zlib.crc32(str(row["doc_id"]).encode()) % 2 == 1)
        assert row["verified"] == (row["folded_root"] == row["root"])


def test_stored_levels_are_few(spark):
    leaves = spark.range(2000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash"))
    made = merkle.manifest(leaves, 3, 3)
    assert [t.count() for t in made.sources.tiers] == [2000, 75, 3, 1]
    assert made.root == plain_tree([h(str(i)) for i in range(2000)])[0]
