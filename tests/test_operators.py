"""Sequences, sources, text, K-means and small relational operators against plain Python."""

import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkdense.functions import columns as C
from sparkdense.ml import text as M
from sparkdense.operators import relational as R
from sparkdense.operators.association import adjacent_pairs, pmi
from sparkdense.operators.kmeans import fit_centres, nearest_centre
from sparkdense.operators.sequence import kth_smallest, max_subarray, positions, prefix_sum, successors
from sparkdense.session import cut_lineage, scratch_path
from sparkdense.sources import readers as S

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def sequence(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos bigint, v bigint").repartition(3)


def best_run(values):
    return max(sum(values[i:j]) for i, j in itertools.combinations(range(len(values) + 1), 2))


def test_sequence_golden(spark):
    sums = prefix_sum(sequence(spark, [2, -2, 9, 10, 0, 5]), "pos", "v", blocks=4).orderBy("pos")
    assert [r["prefix_sum"] for r in sums.collect()] == [2, 0, 9, 19, 19, 24]
    assert max_subarray(sequence(spark, [4, -6, 3, 3, -1, 2, -9, 6]), "pos", "v", blocks=4).first()[0] == 7
    assert kth_smallest(sequence(spark, [60, 10, 30, 20, 50, 40]), "v", 2).first()[0] == 30


@FEW
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=40), blocks=st.integers(1, 6))
def test_sequence_properties(spark, values, blocks):
    df = sequence(spark, values)
    sums = prefix_sum(df, "pos", "v", blocks=blocks).orderBy("pos").collect()
    assert [r["prefix_sum"] for r in sums] == list(itertools.accumulate(values))
    assert max_subarray(df, "pos", "v", blocks=blocks).first()[0] == best_run(values)
    k = len(values) // 2
    assert kth_smallest(df, "v", k, select_rows=2).first()[0] == sorted(values)[k]


def test_selection_with_one_value_in_most_rows(spark):
    values = [7] * 200 + list(range(100))
    df = sequence(spark, values)
    for k in (0, 50, 107, 150, 299):
        assert kth_smallest(df, "v", k, select_rows=5).first()[0] == sorted(values)[k]
    with pytest.raises(ValueError):
        kth_smallest(df, "v", 300)


def test_positions_and_successors(spark):
    df = spark.createDataFrame([(v * 3,) for v in range(50)], "k bigint").repartition(5)
    assert sorted((r["k"], r["pos"]) for r in positions(df, "k", blocks=7).collect()) == [(v * 3, v) for v in range(50)]
    hot = spark.createDataFrame([(1 if i < 40 else i, i) for i in range(60)], "g bigint, i bigint").repartition(5)
    nxt = {r["i"]: r["next"]["i"] if r["next"] else None for r in successors(hot, ["g", "i"], []).collect()}
    assert nxt == {i: i + 1 if i < 59 else None for i in range(60)}


def test_successors_of_distinct_rows(spark):
    rows = [(None if i < 20 else 1, i % 30, None if i % 4 else "x") for i in range(60)]
    twice = spark.createDataFrame(rows + rows, "g bigint, i bigint, s string").repartition(5)
    found = successors(twice, ["g", "i", "s"], [], distinct=True).select("g", "i", "s", "next").collect()
    order = sorted(set(rows), key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r))
    assert sorted(map(str, ((r[:3], r["next"] and tuple(r["next"])) for r in found))) == sorted(
        map(str, ((a, b) for a, b in zip(order, [*order[1:], None], strict=True)))
    )


def test_composites_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "SIEVE_BLOCK", 7)
    found = {r[0] for r in R.composites(spark, 200).collect()}
    assert found == {n for n in range(2, 200) if any(n % d == 0 for d in range(2, n))}
    assert {r[0] for r in R.composites(spark, 5).collect()} == {4}


def test_two_word_lines(spark):
    lines = spark.createDataFrame([("a  b",), ("a b",), ("a b c",), ("a",)], "line string")
    assert R.two_word_lines(lines, "line").count() == 2
    assert R.two_word_lines(lines, "line", runs=False).count() == 1


def test_distinct_with_null(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "v int")
    row = df.agg(R.distinct_with_null("v").alias("a"), F.count_distinct("v").alias("b")).first()
    assert tuple(row) == (2, 1)


def test_bag_difference_keeps_duplicates(spark):
    left, right = (spark.createDataFrame([(v,) for v in vs], "k int") for vs in ([1, 1, 2, 3], [2]))
    assert sorted(r[0] for r in R.bag_difference(left, right, "k").collect()) == [1, 1, 3]


def test_join_to_pairs(spark):
    tools = spark.createDataFrame([(7, "saw"), (8, "plane"), (9, "rasp")], "id int, name string")
    loans = spark.createDataFrame([(7, 3, "back"), (9, 14, "out"), (7, 1, "out"), (6, 2, "back")], "id int, days int, state string")
    joined = tools.join(loans.select("id", F.struct("days", "state").alias("r")), "id")
    pairs = joined.select("id", F.struct("name", "r").alias("pair")).collect()
    assert sorted((r["id"], r["pair"]["name"], r["pair"]["r"]["days"]) for r in pairs) == [(7, "saw", 1), (7, "saw", 3), (9, "rasp", 14)]


def test_boxes(spark):
    one = spark.range(1).select(
        C.box(F.lit([-4.0, -3.0]), F.lit([-2.0, -1.0])).alias("a"), C.box(F.lit([-3.0, -5.0]), F.lit([0.0, -2.0])).alias("b")
    )
    left, right = C.box_split(F.col("a"), 1, F.lit(-2.0))
    r = one.select(
        C.box_union(F.col("a"), F.col("b")).alias("u"),
        C.box_intersection(F.col("a"), F.col("b")).alias("i"),
        left.alias("l"),
        right.alias("r"),
        C.box_expand(F.col("a"), 1.0).alias("grown"),
        C.box_expand(F.col("a"), F.lit([1.0, 2.0])).alias("vector"),
        C.box_expand(F.col("a"), 0.5, "multiply").alias("scaled"),
        C.box_contains(F.col("a"), F.lit([-2.0, -1.0])).alias("corner"),
        C.box_contains(F.col("a"), F.lit([-1.9, -1.0])).alias("outside"),
        C.box_contains(C.all_space(2), F.lit([-1e300, 1e300])).alias("space"),
    ).first()
    assert (r["u"]["lower"], r["u"]["upper"]) == ([-4, -5], [0, -1])
    assert (r["i"]["lower"], r["i"]["upper"]) == ([-3, -3], [-2, -2])
    assert (r["l"]["upper"], r["r"]["lower"]) == ([-2, -2], [-4, -2])
    assert (r["grown"]["lower"], r["vector"]["upper"], r["scaled"]["lower"]) == ([-5, -4], [-1, 1], [-5, -4])
    assert r["corner"] and not r["outside"] and r["space"]


def test_readers(spark):
    assert S.range_table(spark, 2, 10, 4).count() == 8
    frame = S.literal_table(spark, [(1, "a")], ["id", "name"])
    assert frame.columns == ["id", "name"]
    assert S.literal_table(spark, [Row(port="north", depth=18)], "port string, depth int").first()["depth"] == 18
    mixed = S.literal_table(spark, [("18",), ("4 m",)], "depth string").select(S.conforming("depth", "int").alias("depth"))
    assert [r["depth"] for r in mixed.collect()] == [18, None]
    path = scratch_path(spark, "json")
    spark.createDataFrame([('{"dimensions": {"height": 2.5}, "tags": ["cold"], "w": {"latitude": -1.0}}',),
                           ('{"dimensions": {"height": 1.0}, "tags": [], "w": {"latitude": -1.0}}',)], "v string").write.text(path)
    cold = S.read_json(spark, path).where((F.get("tags", F.lit(0)) == "cold") & (F.col("w.latitude") < 0))
    assert [r["height"] for r in cold.select("dimensions.height").collect()] == [2.5]


def test_pmi(spark):
    texts = spark.createDataFrame([("a b a b",), ("a  c",), ("x",)], "text string")
    pairs = adjacent_pairs(texts, "text")
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a")]
    found = {(r["first"], r["second"]): r["pmi"] for r in pmi(pairs, 2).collect()}
    assert found == {("a", "b"): pytest.approx(math.log2(2 * 4 / (3 * 2)))}
    top = pmi(pairs, 1, top=2).collect()
    assert [(r["first"], r["second"]) for r in top] == [("b", "a"), ("a", "c")]


def test_kmeans(spark):
    rows = [(i, float(i % 2) * 10 + i * 0.01, 0.0) for i in range(20)]
    points = spark.createDataFrame(rows, "id bigint, x double, y double")
    centres = fit_centres(points, ("x", "y"), [(0.0, 0.0), (9.0, 0.0), (99.0, 0.0)])
    assert centres[0][0] == pytest.approx(0.09) and centres[1][0] == pytest.approx(10.1) and centres[2] == (99.0, 0.0)
    tie = spark.createDataFrame([(5.0, 0.0)], "x double, y double")
    assert tie.select(nearest_centre(("x", "y"), [(0.0, 0.0), (10.0, 0.0)])).first()[0] == 0


def test_text_pipelines(spark):
    training = spark.createDataFrame(
        [(0, "warm bread and clear soup", 1), (1, "cold soup", 0), (2, "warm rice with beans", 1), (3, "stale cake", 0)],
        "id bigint, text string, label int",
    )
    test = spark.createDataFrame([(4, "warm pie now"), (5, "cold tea"), (6, "warm soup warm")], "id bigint, text string")
    scores = M.linear_pipeline().fit(training).transform(test).collect()
    found = {r["id"]: r["prediction"] for r in scores}
    chance = {r["id"]: float(r["probability"][1]) for r in scores}
    assert found[6] == 1.0 and found[5] == 0.0 and chance[5] < chance[4] < chance[6]
    branched = M.branching_pipeline((1 << 12, 1 << 10)).fit(training).transform(test).collect()
    assert len(branched[0]["features"]) == (1 << 12) + (1 << 10)
    assert {r["id"]: r["prediction"] for r in branched}[6] == 1.0
    scored = M.accuracy(M.linear_pipeline(num_features=1 << 12).fit(training).transform(training)).first()
    assert (scored["n"], scored["accuracy"]) == (4, 1.0)


def test_logistic_overrides(spark):
    rows = [(int(i < 6), Vectors.dense([-1.0 if i < 6 else 1.0, 0.2 * (i % 3)])) for i in range(12)]
    training = spark.createDataFrame(rows, ["label", "features"])
    model = M.fit_logistic(training, maxIter=30, regParam=0.1, threshold=0.55, probabilityCol="p")
    assert "p" in model.transform(training).columns and model.getThreshold() == 0.55
    assert M.fit_logistic(training).coefficients[0] < 0


def test_labels_from_outcomes(spark):
    df = spark.createDataFrame([(1, "t", "Fail"), (2, "t", "Pass"), (3, "t", "Other"), (4, None, "Pass"),
                                (5, "t", "Pass w/ Conditions")], "k int, v string, r string")
    assert sorted((r["id"], r["label"]) for r in M.labelled_texts(df, "k", "v", "r").collect()) == [(1, 0), (2, 1), (5, 1)]


def test_length_udf_keeps_null(spark):
    df = spark.createDataFrame([("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(C.text_length_plus_two("s")).collect()] == [5, None]


def test_task_functions_travel_by_value():
    from pyspark import cloudpickle

    assert "sparkdense" in cloudpickle.list_registry_pickle_by_value()


@pytest.mark.parametrize("values", [30, 3])
def test_rank_area(spark, values):
    rows = [(float(i * 7 % 31 % values), int(i * i % 5 < 2)) for i in range(90)]
    found = M.rank_area(spark.createDataFrame(rows + [(None, 1), (float("nan"), 0), (1.0, 7)], "score double, label int")).first()
    positive, negative = [s for s, k in rows if k == 1], [s for s, k in rows if k == 0]
    wins = sum((p > n) + (p >= n) for p in positive for n in negative)
    assert (found["n_positive"], found["n_negative"], found["twice_wins"]) == (len(positive), len(negative), wins)
    assert found["area"] == pytest.approx(wins / 2 / len(positive) / len(negative))
    vectors = spark.createDataFrame([(Vectors.dense(-s, s), float(k)) for s, k in rows], ["rawPrediction", "label"])
    assert found["area"] == pytest.approx(M.area_under_roc(vectors))


def test_rank_area_of_one_class(spark):
    found = M.rank_area(spark.createDataFrame([(1.0, 1)], "score double, label int")).first()
    assert tuple(found) == (1, 0, 0, None)
    assert M.rank_area(spark.createDataFrame([], "score double, label int")).first()["area"] is None


def test_named_rows(spark):
    rows = [(1, {"age": "7", "name": "ann"}), (2, {"age": "seven"}), (3, {}), (4, None), (5, {"age": None, "more": "1"})]
    records = spark.createDataFrame(rows, "k long, fields map<string,string>")
    found = S.named_rows(records, "fields", {"name": "string", "age": "int"})
    assert found.columns == ["k", "name", "age"]
    assert [tuple(r) for r in found.orderBy("k").collect()] == [(1, "ann", 7), (2, None, None), (3, None, None), (4, None, None), (5, None, None)]


def test_pairs_split_each_text_once(spark):
    texts = spark.createDataFrame([(" a b\tc ",), ("",), (None,), ("one",), ("x x x",)], "text string")
    pairs = adjacent_pairs(texts, "text")
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("b", "c"), ("x", "x"), ("x", "x")]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_cross_validation_equals_one_that_splits_texts_for_every_fit(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9)) + (" good" if i % 3 else " bad"), int(i % 3 > 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    pipeline = M.linear_pipeline(max_iter=5)
    _, hashing, regression = pipeline.getStages()
    grid = ParamGridBuilder().addGrid(hashing.numFeatures, [4, 50]).addGrid(regression.regParam, [0.1, 0.01]).build()
    plain = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=3, foldCol="fold")
    plain = plain.fit(df.withColumn("fold", M.bucket("id", 3, seed=1)))
    stored = []
    monkeypatch.setattr(M, "cut_lineage", lambda table: stored.append(cut_lineage(table)) or stored[-1])
    model = M.cross_validate(df, pipeline, (4, 50), (0.1, 0.01))
    assert model.avgMetrics == pytest.approx(plain.avgMetrics)
    assert M.fitted_regression(model.bestModel).coefficients.toArray() == pytest.approx(plain.bestModel.stages[-1].coefficients.toArray())
    assert model.transform(df).select("prediction").collect() == plain.transform(df).select("prediction").collect()
    assert len(stored) == 1 and "text" not in stored[0].columns
