"""Text classification queries on the documents that carry a quality label."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.ml import text as M
from sparkdense.registry import query, table

LABELS = {"0": 0, "1": 1}

LABELLED_SQL = "SELECT doc_id AS id, text, quality::INTEGER AS label FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IN (0, 1)"
BUCKET_SQL = "(('0x' || substr(md5(id::VARCHAR || '/0'), 1, 8))::BIGINT % 1000)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    outcomes = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("outcome"))
    return M.labelled_texts(documents.join(outcomes, "doc_id", "left"), "doc_id", "text", "outcome", LABELS)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as features, all coordinates; low label numbers against high ones."""
    embeddings = table(spark, sf, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    features = array_to_vector(F.col("embedding").cast("array<double>"))
    return embeddings.select(
        F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), features.alias("features")
    )


@query(
    "ml_tokenize",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s'), lambda x: x <> ''))::INTEGER AS n_words
        FROM documents""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    words = Tokenizer(inputCol="text", outputCol="words").transform(table(spark, sf, "documents"))
    return words.select("doc_id", F.size(F.filter("words", lambda w: w != "")).alias("n_words"))


@query("ml_hashed_terms")
def _(spark: SparkSession, sf: str) -> DataFrame:
    words = Tokenizer(inputCol="text", outputCol="words").transform(labelled(spark, sf))
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 10).transform(words)
    return hashed.select("id", F.size("words").alias("n_words"), F.col("features").cast("string").alias("features"))


@query(
    "ml_label_prep",
    "SELECT id, length(text)::INTEGER AS n_chars, label FROM (" + LABELLED_SQL + ")",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("id", F.length("text").alias("n_chars"), "label")


@query("ml_label_counts", "SELECT label, count(*) AS n FROM (" + LABELLED_SQL + ") GROUP BY label")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query("ml_split", f"SELECT id, {BUCKET_SQL} < 800 AS training FROM ({LABELLED_SQL})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(labelled(spark, sf), "id", 0.8)
    marked = training.select("id", F.lit(True).alias("training"))
    return marked.unionByName(test.select("id", F.lit(False).alias("training")))


@query("ml_lr_predict")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(vectors(spark, sf), "id", 0.8)
    model = M.fit_logistic(training)
    return model.transform(test).select("id", "label", "prediction")


@query("ml_lr_overrides")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(vectors(spark, sf), "id", 0.8)
    model = M.fit_logistic(training, maxIter=30, regParam=0.1, threshold=0.55, probabilityCol="myProbability")
    return model.transform(test).select("id", "prediction", F.col("myProbability").cast("string").alias("probability"))


@query("ml_pipeline")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(labelled(spark, sf), "id", 0.8)
    return M.linear_pipeline().fit(training).transform(test).select("id", "label", "prediction")


@query("ml_dag_pipeline")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(labelled(spark, sf), "id", 0.8)
    return M.branching_pipeline().fit(training).transform(test).select("id", "label", "prediction")


@query("ml_accuracy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(labelled(spark, sf), "id", 0.8)
    return M.accuracy(M.linear_pipeline(reg_param=0.01).fit(training).transform(test))


@query("ml_cv")
def _(spark: SparkSession, sf: str) -> DataFrame:
    training, test = M.split_rows(labelled(spark, sf), "id", 0.8)
    model = M.cross_validate(training, M.linear_pipeline(reg_param=0.01), (10, 100, 1000), (0.1, 0.01))
    return M.accuracy(model.transform(test.withColumn("fold", F.lit(0))))


@query(
    "ml_rank_area",
    "WITH l AS (" + LABELLED_SQL + """), p AS (SELECT length(text) AS s FROM l WHERE label = 1), n AS (SELECT length(text) AS s FROM l WHERE label = 0)
       SELECT n_positive, n_negative, twice_wins::BIGINT AS twice_wins, twice_wins / (2.0::DOUBLE * n_positive * n_negative) AS area
       FROM (SELECT sum((p.s > n.s)::INT + (p.s >= n.s)::INT) AS twice_wins FROM p, n),
            (SELECT count(*) AS n_positive FROM p), (SELECT count(*) AS n_negative FROM n)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How well the length of a text tells its quality, as area under the ROC curve."""
    found = M.rank_area(labelled(spark, sf).select(F.length("text").alias("score"), "label"))
    return found.withColumn("twice_wins", F.col("twice_wins").cast("bigint"))
