"""The registered queries of the subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.llm import (
    alignment,
    bpe,
    embedding_dedup,
    exact_dedup,
    html_text,
    language_id,
    merkle,
    minhash,
    packing,
    pii,
    repeats,
    secrets,
    toxicity,
)
from sparkdense.llm.common import crc32_of

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of(F.col("doc_id")) % 5 == 0
    dictionaries = language_id.learn_dictionaries(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.learn(docs)).drop("text")


def op3_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of(F.col("doc_id")) % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken")).drop("text")


def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = crc32_of(F.col("doc_id")) % 2 == 0
    return merkle.verify(docs, even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment_statistics(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


SQL_OP10 = r"""
WITH normal AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_raw,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_raw DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_raw DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM normal
"""

# Levels that the SQL unrolls for each tree: enough for 3^11 leaves of a source and as many sources.
SQL_LEVELS = 11


def _sql_tree(name: str, leaves: str, group: str) -> str:
    """Levels ``{name}0`` to ``{name}11`` over ``leaves`` (group, idx, n, hash), each with the siblings of its nodes."""
    run = f"PARTITION BY {group}, idx // 3 ORDER BY idx ROWS BETWEEN"
    parts = []
    for level in range(SQL_LEVELS + 1):
        source = leaves
        if level:
            source = f"""(SELECT {group}, idx // 3 AS idx, (n + 2) // 3 AS n,
                CASE WHEN n = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY idx)) END AS hash
                FROM {name}{level - 1} GROUP BY {group}, idx // 3, n)"""
        parts.append(f"""{name}{level} AS (SELECT {group}, idx, n, hash,
            coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
            coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
            FROM {source})""")
    return ",\n".join(parts)


def _sql_paths(name: str, start: str, tree: str, group: str) -> str:
    """Rows of ``start`` (group, idx, n, proof, folded and others) taken up the levels of ``tree`` one by one."""
    parts = [f"{name}0 AS ({start})"]
    for level in range(SQL_LEVELS):
        parts.append(f"""{name}{level + 1} AS (SELECT p.* REPLACE (p.idx // 3 AS idx, (p.n + 2) // 3 AS n,
            p.proof || t.lefts || t.rights AS proof,
            CASE WHEN p.n = 1 THEN p.folded ELSE sha256(t.lefts || p.folded || t.rights) END AS folded)
            FROM {name}{level} p JOIN {tree}{level} t ON p.idx = t.idx AND p.{group} IS NOT DISTINCT FROM t.{group})""")
    return ",\n".join(parts)


def _sql_leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_SQL_CRC = """list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT FOR i IN range(8)]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

SQL_OP11 = f"""
WITH leaves AS (
    SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
           CASE WHEN {_SQL_CRC} & 1 = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS later
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS n
    FROM leaves
),
{_sql_tree("s", "(SELECT source, idx, n, leaf AS hash FROM placed)", "source")},
subroots AS (
    SELECT 0 AS tree, source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
    FROM s{SQL_LEVELS}
),
{_sql_tree("t", "(SELECT tree, idx, n, hash FROM subroots)", "tree")},
{_sql_paths("p", "SELECT doc_id, source, leaf, idx, n, '' AS proof, later AS folded FROM placed", "s", "source")},
{_sql_paths("q", f"""SELECT p.doc_id, p.leaf, r.tree, r.hash AS subroot, r.idx, r.n, p.proof, p.folded
    FROM p{SQL_LEVELS} p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source""", "t", "tree")}
SELECT q.doc_id, q.leaf, q.subroot, r.hash AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root,
       q.folded = r.hash AS verified
FROM q{SQL_LEVELS} q, t{SQL_LEVELS} r
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_linear_grouping": op3_linear_grouping,
    "op4_noisy_channel": op4_noisy_channel,
    "op5_bpe": op5_bpe,
    "op6_host_paths": op6_host_paths,
    "op7_minhash": op7_minhash,
    "op8_best_fit": op8_best_fit,
    "op9_metric_join": op9_metric_join,
    "op10_block_naming": op10_block_naming,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_secrets": op13_secrets,
}
ORACLES: dict[str, str] = {"op10_block_naming": SQL_OP10, "op11_merkle": SQL_OP11}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
