import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hazardflow.functions.scalar import hazard_probability, predicted_probability
from hazardflow.models import score, train
from hazardflow.operators import split
from hazardflow.operators.relate import hazard_index
from hazardflow.functions.scalar import cut
from hazardflow.schema import FEATURES, HAZARD_WEIGHTS, TARGET
from hazardflow.session import written


@pytest.fixture(scope="module")
def rows(spark):
    """Readings drawn by hash, labelled by the hazard index without noise."""
    spans = [(1, 30), (2, 8), (10, 1000), (5, 500), (0, 5), (20, 2000), (10, 800), (0, 6)]
    unit = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_000)) / 100_000
    drawn = spark.range(800).select("id", *[(lo + unit(i) * (hi - lo)).alias(c) for i, (c, (lo, hi)) in enumerate(zip(FEATURES, spans))])
    labelled = hazard_index(drawn, HAZARD_WEIGHTS).withColumn(TARGET, cut(F.col("hazard"), [0.4, 0.7], [0, 1, 2]))
    table = written(labelled.drop("hazard"), "sensor")
    return written(split.stratified_split(table, TARGET, "id"), "split")


@pytest.fixture(scope="module")
def forest(rows):
    return train.pipeline("forest", weight="weight", numTrees=30, maxDepth=8).fit(
        train.add_class_weights(rows.where("NOT is_test"))
    )


def test_forest_quality(rows, forest):
    accuracy, f1 = train.evaluate(forest, rows.where("is_test"))
    assert accuracy > 0.8 and f1 > 0.8


@pytest.mark.parametrize("kind, params, least", [("svm", {"maxIter": 30}, 0.6), ("boosting", {"maxIter": 3, "maxDepth": 3}, 0.6), ("logistic", {}, 0.85)])
def test_other_kinds(rows, kind, params, least):
    model = train.pipeline(kind, **params).fit(rows.where("NOT is_test"))
    assert train.accuracy_of(model, rows.where("is_test")).first().accuracy > least


def test_unknown_kind():
    with pytest.raises(ValueError):
        train.pipeline("oracle")


def test_score_columns(rows, forest):
    out = score.score(forest, rows, ts="2024-01-01 00:00:00", version="v2")
    assert out.count() == rows.count()
    bad = out.where("probability < 0 OR probability > 1 OR confidence > 1 OR risk_level IS NULL OR model_version <> 'v2'")
    assert bad.count() == 0
    share = score.score(forest, rows, hazard_classes=[0, 1, 2]).agg(F.min("probability")).first()[0]
    assert share == pytest.approx(1.0)


def test_save_and_load(spark, rows, forest, tmp_path):
    train.save_model(forest, str(tmp_path / "m"), "2024-01-01T00:00:00")
    loaded, meta = train.load_model(str(tmp_path / "m"))
    assert meta["feature_names"] == FEATURES and meta["class_names"][3] == "High"
    a = [r.prediction for r in forest.transform(rows).orderBy("id").collect()]
    assert a == [r.prediction for r in loaded.transform(rows).orderBy("id").collect()]


def test_importances(forest):
    table = train.importances(forest).collect()
    assert {r.feature for r in table} == set(FEATURES)
    assert sum(r.importance for r in table) == pytest.approx(1.0)
    assert [r.importance for r in table] == sorted((r.importance for r in table), reverse=True)
    assert set(r.feature for r in table[:4]) == set(HAZARD_WEIGHTS)


def test_compare(rows):
    fit = written(split.stratified_folds(rows.where("NOT is_test"), TARGET, "id", k=3), "folds")
    out = train.compare({"logistic": train.pipeline("logistic")}, fit, rows.where("is_test"), "fold", k=3).collect()
    assert out[0].model == "logistic" and 0.8 < out[0].cv_mean <= 1 and out[0].cv_std < 0.1


def test_classes_are_fitted_side_by_side_with_equal_models(rows):
    fit = rows.where("NOT is_test")
    for kind, params in (("svm", {"maxIter": 3}), ("boosting", {"maxIter": 2, "maxDepth": 2})):
        estimator = train.pipeline(kind, **params)
        assert estimator.getStages()[-1].getParallelism() == 4
        alone = train.pipeline(kind, **params)
        alone.getStages()[-1].setParallelism(1)
        both = [[r.prediction for r in e.fit(fit).transform(fit).orderBy("id").collect()] for e in (estimator, alone)]
        assert both[0] == both[1]


def test_standardise(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, same double")
    out = train.standardise(frame, frame, ["x", "same"]).orderBy("x").collect()
    assert [r.x for r in out] == pytest.approx([-1.224745, 0.0, 1.224745]) and out[0].same == 0.0


def test_probability_helpers_and_soft_vote(spark):
    frame = spark.createDataFrame([(Vectors.dense(0.2, 0.5, 0.3), Vectors.dense(0.1, 0.0, 0.9), 1.0)], ["p", "q", "c"])
    row = frame.select(predicted_probability(F.col("p"), F.col("c")).alias("a"), hazard_probability(F.col("p"), [1, 2]).alias("b")).first()
    assert (row.a, row.b) == (0.5, 0.8)
    assert train.vote(frame, ["p", "q"], "soft").first().prediction == 2


def test_feedback(spark):
    frame = spark.createDataFrame([(1, 2), (1, 1)], "predicted_class int, corrected_class int")
    assert [r.target for r in train.feedback_labels(frame).collect()] == [2, 1]
    assert train.agreement(frame).first().agreement == 0.5


def test_vote_with_any_code(spark):
    frame = spark.createDataFrame([(5, 5, 5), (7, 9, 9), (8, 6, 7), (None, 4, None), (None, None, None)], "a int, b int, c int")
    assert [r.prediction for r in train.vote(frame, ["a", "b", "c"]).collect()] == [5, 9, 6, 4, None]


def test_no_row_is_lost(rows, forest):
    gaps = rows.withColumn(FEATURES[0], F.when(F.col("id") % 4 != 0, F.col(FEATURES[0])))
    scored = score.score(forest, gaps)
    lost = score.rejects(scored)
    assert scored.count() == rows.count()
    assert lost.count() == rows.where("id % 4 = 0").count()
    assert {tuple(r.missing_fields) for r in lost.collect()} == {(FEATURES[0],)}
    assert score.score(forest, rows).where("prediction IS NULL").count() == 0
    with pytest.raises(Exception, match="null|NULL|NaN"):
        train.pipeline("logistic").fit(gaps)
