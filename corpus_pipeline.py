"""A training corpus from ``documents`` in five stages: each reads what its predecessor kept, as a written table.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.llm import exact_dedup, language_id, minhash, packing, pii
from sparkdense.llm.common import stored
from sparkdense.llm.queries import table, tokenizer_path

# SQL can express neither compression sizes nor boosted trees. Tests run the stages on odd rows and compare the packed
# documents with those that the stages keep one by one; a comparison with plain Python row by row is still open.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin; null texts and texts without a letter go, too."""
    found = language_id.identify(docs, language_id.learn_dictionaries(docs))
    return found.where("NOT rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the longest stays, then the one with the least id.

    Of rows that agree in this, too, such as wholly repeated ones, only the one with the least text stays.
    """
    stays = exact_dedup.exact_groups(docs).where("kept").select("doc_id", "text_sha256", "n_chars_raw").distinct()
    sha = F.sha2(exact_dedup.normalised().cast("binary"), 256)
    keyed = docs.withColumn("own_sha", sha).withColumn("own_raw", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    same = keyed["doc_id"].eqNullSafe(stays["doc_id"]) & (F.col("own_sha") == F.col("text_sha256"))
    kept = keyed.join(stays, same & (F.col("own_raw") == F.col("n_chars_raw")), "left_semi")
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    return kept.groupBy("doc_id", "own_sha").agg(F.min(row).alias("own_row")).select(*[F.col("own_row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links of similarity 0.8 on five-word shingles, the one with the least id stays."""
    goes = minhash.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars follows the text where that changed."""
    found = pii.detect(docs, pii.learn(docs), with_redacted=True)
    changed = F.col("spans") != ""
    columns = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted")).otherwise(F.col("n_chars"))}
    kinds = dict(docs.dtypes)
    return found.select(*[columns.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
