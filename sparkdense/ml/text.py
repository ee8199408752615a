"""Text classification on MLlib: label preparation, repeatable splits, pipelines, evaluation, model selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, Tokenizer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdense.operators.sequence import prefix_sum
from sparkdense.session import cut_lineage

# Inspection outcomes and the labels they stand for; other outcomes have no label.
OUTCOMES = {"Fail": 0, "Pass": 1, "Pass w/ Conditions": 1}


def mapped_label(outcome: str, labels: Mapping[object, int] = OUTCOMES) -> Column:
    """The label of an outcome, NULL where none is given."""
    column = F.lit(None).cast("int")
    for value, label in labels.items():
        column = F.when(F.col(outcome) == value, label).otherwise(column)
    return column


def labelled_texts(df: DataFrame, key: str, text: str, outcome: str, labels: Mapping[object, int] = OUTCOMES) -> DataFrame:
    """(id, text, label) of the rows that have a text and an outcome with a label."""
    prepared = df.where(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.col(text).alias("text"), mapped_label(outcome, labels).alias("label")
    )
    return prepared.where("label >= 0")


def bucket(key: str, buckets: int, seed: int = 0) -> Column:
    """A number in [0, buckets) from a seeded hash of the key: the same on every run and every engine."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def split_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts of about ``share`` and ``1 - share`` of the rows."""
    chosen = bucket(key, 1000, seed) < round(share * 1000)
    return df.where(chosen), df.where(~chosen)


def linear_pipeline(max_iter: int = 10, reg_param: float = 0.001, num_features: int | None = None) -> Pipeline:
    """Words, hashed term counts, logistic regression."""
    words = Tokenizer(inputCol="text", outputCol="words")
    counts = HashingTF(inputCol="words", outputCol="features")
    if num_features:
        counts.setNumFeatures(num_features)
    return Pipeline(stages=[words, counts, LogisticRegression(maxIter=max_iter, regParam=reg_param)])


def branching_pipeline(
    sizes: Sequence[int | None] = (None, 1 << 10), max_iter: int = 10, reg_param: float = 0.001
) -> Pipeline:
    """Words, several hashed term counts side by side, all assembled into one vector, logistic regression.

    ``None`` takes the hasher's own default of 2^18. The assembled column describes every position in its metadata,
    which is shipped with each task: 2^14 instead of 2^18 halves the time on small tables.
    """
    stages: list = [Tokenizer(inputCol="text", outputCol="words")]
    branches = []
    for i, size in enumerate(sizes):
        counts = HashingTF(inputCol="words", outputCol=f"counts{i}")
        stages.append(counts.setNumFeatures(size) if size else counts)
        branches.append(counts.getOutputCol())
    stages.append(VectorAssembler(inputCols=branches, outputCol="features"))
    stages.append(LogisticRegression(maxIter=max_iter, regParam=reg_param))
    return Pipeline(stages=stages)


def fit_logistic(df: DataFrame, base: LogisticRegression | None = None, **overrides) -> LogisticRegressionModel:
    """Fit on columns ``features`` and ``label``; keyword arguments override parameters for this fit only."""
    estimator = base or LogisticRegression(maxIter=10, regParam=0.01)
    return estimator.fit(df, {estimator.getParam(name): value for name, value in overrides.items()})


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: rows seen, rows predicted right and their share."""
    right = F.count_if(F.col("label") == F.col("prediction"))
    return predictions.agg(F.count("*").alias("n"), right.alias("n_right"), (right / F.count("*")).alias("accuracy"))


def area_under_roc(predictions: DataFrame) -> float:
    return BinaryClassificationEvaluator().evaluate(predictions)


def rank_area(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: n_positive, n_negative, twice_wins and area, the exact area under the ROC curve.

    The area is the share of pairs of a positive (label 1) and a negative row (label 0) in which the positive one has
    the higher score; a tie is half a win. Rows are counted for each score first, then negatives below it come from
    sums of blocks of scores, so neither pairs nor a window over all rows arise. Rows without a score (null, NaN) or
    with another label do not count; the area is NULL when a class is missing.
    """
    known = df.select(F.col(score).cast("double").alias("s"), F.col(label).alias("l")).where("s IS NOT NULL AND NOT isnan(s) AND l IN (0, 1)")
    counts = cut_lineage(known.groupBy("s").agg(F.count_if(F.col("l") == 1).alias("pos"), F.count_if(F.col("l") == 0).alias("neg")))
    wide = "decimal(19,0)"
    twice_below = 2 * F.col("up_to") - F.col("neg")
    wins = F.coalesce(F.sum(F.col("pos").cast(wide) * twice_below.cast(wide)), F.lit(0)).alias("twice_wins")
    positive, negative = (F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("pos", "n_positive"), ("neg", "n_negative")))
    out = prefix_sum(counts, "s", "neg", "up_to").agg(positive, negative, wins)
    pairs = 2.0 * F.col("n_positive").cast("double") * F.col("n_negative").cast("double")
    return out.withColumn("area", F.when(pairs > 0, F.col("twice_wins").cast("double") / pairs))


def cross_validate(
    df: DataFrame,
    pipeline: Pipeline,
    num_features: Sequence[int],
    reg_params: Sequence[float],
    folds: int = 3,
    key: str = "id",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Try every pair of parameters on every fold and refit the best pair on all rows.

    Folds come from a hash of the key, so they do not change between runs. Texts are split and hashed once, for all
    sizes side by side, and every fit and evaluation reads the stored vectors.
    """
    *before, _ = pipeline.getStages()
    stages = {type(stage): stage for stage in pipeline.getStages()}
    hashing, regression = stages[HashingTF], stages[LogisticRegression]
    prepared = df.withColumn("fold", bucket(key, folds, seed=1))
    for stage in before:
        if stage is not hashing:
            prepared = stage.transform(prepared)
    columns = {size: f"{hashing.getOutputCol()}_{size}" for size in num_features}
    for size, column in columns.items():
        prepared = hashing.copy({hashing.numFeatures: size, hashing.outputCol: column}).transform(prepared)
    prepared = cut_lineage(prepared.select(regression.getLabelCol(), "fold", *columns.values()))
    grid = (
        ParamGridBuilder()
        .addGrid(regression.featuresCol, list(columns.values()))
        .addGrid(regression.regParam, list(reg_params))
        .build()
    )
    validator = CrossValidator(
        estimator=regression,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    validated = validator.fit(prepared)
    best = validated.bestModel
    size = next(size for size, column in columns.items() if column == best.getFeaturesCol())
    chosen = hashing.copy({hashing.numFeatures: size})
    transformers = [chosen if stage is hashing else stage for stage in before]
    validated.bestModel = PipelineModel([*transformers, best.setFeaturesCol(hashing.getOutputCol())])
    return validated


def fitted_regression(model: PipelineModel) -> LogisticRegressionModel:
    return model.stages[-1]
