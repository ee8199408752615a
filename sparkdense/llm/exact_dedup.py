"""Exact dedup by deterministic block naming.

A text, without its white space, is cut into blocks of a fixed number of characters. Distinct blocks that occur more
than once are sorted and numbered; a block that occurs once makes its document unique. Then adjacent names are paired,
the pairs sorted and numbered in turn, until every remaining document has a single name. Names come from comparing
contents, never from hashes, so equal names mean equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdense.llm.common import plain_text, stored

BLOCK_CHARS = 4096
# Fixed value: the white space that does not count, as a character class.
WHITE_SPACE = r"[\x20\x09-\x0D]"


def normalised(column: str = "text"):
    return F.regexp_replace(plain_text(column), WHITE_SPACE, "")


def _named(values: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur in more than one row, sorted and numbered: the number grows with the value."""
    repeated = values.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    numbered = repeated.orderBy(*columns).select(*columns, F.monotonically_increasing_id().alias("name"))
    return stored(numbered, "names")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars_raw, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical without white space; of equal texts the row with the most code points in its
    original text stays, then the one with the smallest doc_id (a null doc_id comes last). Null counts as empty, and
    empty texts are equal to each other. Rows that agree in doc_id and text are one document that occurs several
    times: each counts in group_size and all share one result. Other columns are not read.
    """
    base = docs.select("doc_id", F.length(plain_text()).cast("long").alias("n_raw"), normalised().alias("norm"))
    base = base.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    row_key = ["doc_id", "sha"]
    n_blocks = F.greatest(F.ceil(F.length("norm") / F.lit(block_chars)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring("norm", i * block_chars + 1, F.lit(block_chars)))
    blocks = base.withColumn("n_blocks", n_blocks).select(*row_key, "n_raw", "n_blocks", F.posexplode(cut).alias("pos", "block"))
    names = _named(blocks, ["block"])
    # unnamed blocks occur once: what holds one is unique and leaves the recursion
    level = blocks.join(names, "block").select(*row_key, "n_raw", "n_blocks", "pos", "name")
    return _groups(docs, base, _recurse(level))


def _recurse(level: DataFrame) -> DataFrame:
    """(doc_id, sha, n_raw, n_blocks, name) of the documents whose blocks all have names, paired up to one name each."""
    # pos of the copies of one row is repeated, so rows are counted through their first block
    keys = ["doc_id", "sha", "n_raw", "n_blocks"]
    level = stored(level.groupBy(*keys, "pos", "name").agg(F.count(F.lit(1)).alias("copies")), "level")
    width, done = 1, None
    while True:
        whole = level.where(F.col("n_blocks") <= width).select(*keys, "name", "copies")
        done = whole if done is None else done.unionByName(whole)
        level = level.where(F.col("n_blocks") > width)
        if level.isEmpty():
            return done
        half = (F.col("pos") / 2).cast("int")
        pairs = level.groupBy(*keys, half.alias("pair"), "copies").agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        # the last block may stand alone; a partner that is missing elsewhere marks a unique document
        blocks_here = F.ceil(F.col("n_blocks") / F.lit(width)).cast("int")
        alone = (F.col("pair") * 2 + 1) >= blocks_here
        pairs = pairs.where(F.col("left").isNotNull() & (F.col("right").isNotNull() | alone))
        pairs = stored(pairs.withColumn("right", F.coalesce("right", F.lit(-1))), "pairs")
        names = _named(pairs.select("left", "right", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(2))))), ["left", "right"])
        level = stored(pairs.join(names, ["left", "right"]).select(*keys, F.col("pair").alias("pos"), "name", "copies"), "level")
        width *= 2


def _groups(docs: DataFrame, base: DataFrame, named: DataFrame) -> DataFrame:
    named = stored(named, "named")
    best = F.struct(F.col("n_raw"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("least"))
    groups = named.groupBy("n_blocks", "name").agg(
        F.sum("copies").alias("group_size"), F.max(best).alias("best")
    )
    groups = stored(
        groups.select("n_blocks", "name", "group_size", (-F.col("best.least")).alias("keep_id"), F.col("best.n_raw").alias("keep_raw")),
        "groups",
    )
    members = named.join(groups, ["n_blocks", "name"]).select("doc_id", "sha", "n_raw", "keep_id", "keep_raw", "group_size")
    rows = base.select("doc_id", "sha", "n_raw").alias("a").join(
        members.alias("m"),
        F.col("a.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("a.sha") == F.col("m.sha")) & (F.col("a.n_raw") == F.col("m.n_raw")),
        "left",
    )
    in_group = F.col("m.sha").isNotNull()
    chosen = F.col("a.doc_id").eqNullSafe(F.col("m.keep_id")) & (F.col("a.n_raw") == F.col("m.keep_raw"))
    return rows.select(
        "a.doc_id",
        F.when(in_group, F.col("m.keep_id")).otherwise(F.col("a.doc_id")).alias("keep_id"),
        F.coalesce("m.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(in_group, chosen).otherwise(F.lit(True)).alias("kept"),
        F.col("a.sha").alias("text_sha256"),
        F.col("a.n_raw").alias("n_chars_raw"),
    )
