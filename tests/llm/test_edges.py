"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkdense.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    html_text,
    language_id,
    minhash,
    packing,
    pii,
    repeats,
    toxicity,
)
from sparkdense.llm.queries import tokenizer_path

LONG = "word " * 60_000
TEXTS = [
    (1, "the cat sat on the mat and the dog ran"), (2, "the cat sat on the mat and the dog ran"), (2, "the cat sat on the mat and the dog ran"),
    (3, None), (4, ""), (5, " \n "), (None, "le chat est sur la table et le chien court"), (6, LONG), (7, LONG), (8, "123 456"), (9, "a"),
]
# names that operators use inside or give to their results
CLASH = ["score", "ids", "spans", "key", "component", "offset", "h", "rep", "lang_pred", "kept", "html", "bytes", "name"]
MULTI, PLAIN = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def odd_documents(spark):
    rows = [(i, t, "en" if t and "the" in t else "fr", None, 5) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


def run_all(docs):
    """Every operator on documents, as (name, result with one row for each document)."""
    dictionaries = language_id.learn_dictionaries(docs)
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    return {
        "language_id": language_id.identify(docs, dictionaries),
        "pii": pii.detect(docs, pii.learn(docs), with_redacted=True),
        "repeats": repeats.remove_repeats(docs, with_kept=True),
        "toxicity": toxicity.score(docs, model),
        "bpe": bpe.decode_documents(bpe.encode_documents(docs, tokenizer_path(MULTI)), tokenizer_path(MULTI)),
        "minhash": minhash.near_duplicates(docs, words=5),
        "exact": exact_dedup.exact_groups(docs),
    }


@pytest.fixture(scope="module")
def results(spark):
    return {k: v.collect() for k, v in run_all(odd_documents(spark)).items()}


def test_every_row_has_a_result(results):
    assert {k: len(v) for k, v in results.items()} == dict.fromkeys(results, len(TEXTS))


def test_empty_tables(spark):
    none = odd_documents(spark).where("1 = 0")
    assert {k: v.count() for k, v in run_all(none).items()} == dict.fromkeys(run_all(none), 0)
    assert packing.pack_documents(none, tokenizer_path(PLAIN)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vectors).count() == 0


def test_languages(results):
    found = {r["doc_id"]: r for r in results["language_id"]}
    assert found[1]["lang_pred"] == "en" and found[None]["lang_pred"] == "fr"
    for i in (3, 4, 5, 8):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)


def test_no_personal_data(results):
    assert all(r["spans"] == "" and r["redacted"] == r["text"] for r in results["pii"])


def test_repeats_of_long_texts(results):
    found = {r["doc_id"]: r for r in results["repeats"]}
    assert found[6]["n_removed"] == len(LONG) == found[7]["n_removed"]
    assert found[6]["n_spans"] == 1 and found[3]["n_bytes"] == 0 and found[1]["n_removed"] == 0


def test_round_trip(results):
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in results["bpe"])


def test_near_copies(results):
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in results["minhash"]}
    assert found[1] == (1, True) and found[2] == (1, False) and found[7] == (6, False)
    assert found[3] == (3, True) and found[5] == (5, True) and found[None] == (None, True)
    assert {r["n_shingles"] for r in results["minhash"] if r["doc_id"] in (3, 4, 5)} == {0}


def test_exact_copies(results):
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in results["exact"]}
    assert found[1] == (1, 3, True) and found[2] == (1, 3, False) and found[7] == (6, 2, False)
    # of equal texts the longest original stays: two spaces and a newline against nothing
    assert found[5] == (5, 3, True) and found[3] == (5, 3, False) and found[None] == (None, 1, True)


def test_embeddings(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1),
        (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [0.0, 1.0], 1), (13, [1.0, 0.1], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x"))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert found[1] == (3, 1, True) and found[2] == (3, 1, False) and found[3] == (3, 1, False) and found[13] == (3, 1, False)
    assert all(found[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))


def test_pages(spark):
    article = "<html><body><nav>menu menu</nav><article><p>First &amp;  second\n words here.<p>Third</article><div class='comments'><p>me too</div></body>"
    rows = [(1, "http://a/1", article), (1, "http://a/1", article), (2, None, None), (3, "", ""), (4, "odd", "no tags at all"), (5, "http://a/2", "<p>cut <b>off")]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x"))).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 6 and texts[1] == "First & second words here.\nThird" and texts[2] == texts[3] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_pipeline(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {1, 6, None} | {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "a  bc"), (2, "abc"), (3, "own"), (None, "x y"), (None, "x y"), (4, "z"), (4, "other"), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(map(tuple, kept.collect()), key=str)
    assert found == sorted([(1, "a  bc", "s"), (3, "own", "s"), (None, "x y", "s"), (4, "z", "s"), (4, "other", "s"), (5, None, "s")], key=str)
