"""Training, comparison, scoring and voting over the whole sensor view.

Forests and boosting have no SQL twin; tests/test_models.py bounds their
accuracy and checks their tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardflow.models import registry, score, train
from hazardflow.operators import metrics, split
from hazardflow.plans.registry import query
from hazardflow.plans.score_queries import SENSOR_CTE
from hazardflow.plans.views import sensor
from hazardflow.schema import FEATURES, TARGET
from hazardflow.session import scratch_path, written
from hazardflow.sources import writers
from hazardflow.streaming import streams

# Settings of the registered queries; the library defaults are in models/train.py.
FOREST = {"numTrees": 50, "maxDepth": 8}
BOOST = {"maxIter": 5, "maxDepth": 4}


def _parts(spark, sf):
    """Train and test rows of the stratified split, written once for the many passes of a fit."""
    rows = written(sensor(spark, sf), "sensor")
    table = written(split.stratified_split(rows, TARGET, "sensor_id"), "training")
    return table.where("NOT is_test"), table.where("is_test")


def _forest(train_rows):
    weighted = train.add_class_weights(train_rows)
    return train.pipeline("forest", weight="weight", **FOREST).fit(weighted)


@query("train_report")
def train_report(spark, sf):
    fit, test = _parts(spark, sf)
    predictions = _forest(fit).transform(test)
    out = metrics.class_report(predictions.select(F.col(TARGET).alias("label"), "prediction"))
    return out.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


@query("feature_importances")
def feature_importances(spark, sf):
    fit, _ = _parts(spark, sf)
    return train.importances(_forest(fit))


@query("top_features")
def top_features(spark, sf):
    """The four most important features, and the accuracy of a forest that has only these."""
    fit, test = _parts(spark, sf)
    best = [r["feature"] for r in train.top_features(train.importances(_forest(fit)), 4).collect()]
    model = train.pipeline("forest", best, **FOREST).fit(fit)
    return train.accuracy_of(model, test).select(
        F.lit(",".join(sorted(best))).alias("features"), F.round("accuracy", 4).alias("accuracy")
    )


@query("compare_models")
def compare_models(spark, sf):
    fit, test = _parts(spark, sf)
    folded = written(split.stratified_folds(fit, TARGET, "sensor_id", k=3), "folds")
    kinds = {
        "forest": train.pipeline("forest", **FOREST),
        "svm": train.pipeline("svm", maxIter=20),
        "boosting": train.pipeline("boosting", **BOOST),
        "logistic": train.pipeline("logistic"),
    }
    return train.compare(kinds, folded, test, "fold", k=3)


def _scored(spark, sf):
    rows = written(sensor(spark, sf), "sensor")
    table = written(split.stratified_split(rows, TARGET, "sensor_id"), "training")
    return score.score(_forest(table.where("NOT is_test")), rows, ts="2024-02-01 00:00:00")


@query(
    "score_rejects",
    f"""WITH {SENSOR_CTE}, r AS (SELECT *, user_id % 3 = 0 OR Energy_Unit_log < 3 AS bad FROM sensor)
        SELECT count(*) AS rows, count(*) FILTER (NOT bad) AS scored, count(*) FILTER (bad) AS rejected,
               count(*) FILTER (user_id % 3 = 0) AS without_duration, TRUE AS consistent FROM r""",
)
def score_rejects(spark, sf):
    """Readings with features taken away by rule: every row is scored or rejected with its missing fields."""
    whole = written(sensor(spark, sf), "sensor")
    gaps = whole.withColumns(
        {
            "Duration_days": F.when(F.col("user_id") % 3 != 0, F.col("Duration_days")),
            "Energy_Unit_log": F.when(F.col("Energy_Unit_log") < 3, float("nan")).otherwise(F.col("Energy_Unit_log")),
        }
    )
    scored = written(score.score(_forest(whole), gaps, ts="2024-02-01 00:00:00"), "scored")
    rejected = score.rejects(scored)
    wrong = scored.where("prediction IS NOT NULL AND (probability NOT BETWEEN 0 AND 1 OR confidence > 1 OR risk_level IS NULL)")
    return scored.agg(F.count("*").alias("rows"), F.count("prediction").alias("scored")).select(
        "rows",
        "scored",
        rejected.agg(F.count("*")).scalar().alias("rejected"),
        rejected.where(F.array_contains("missing_fields", "Duration_days")).agg(F.count("*")).scalar().alias("without_duration"),
        (wrong.agg(F.count("*")).scalar() == 0).alias("consistent"),
    )


@query(
    "train_checks",
    f"""WITH {SENSOR_CTE} SELECT count(*) AS rows, ceil(count(*) * 2 / 10)::BIGINT AS test_rows,
        TRUE AS accurate, TRUE AS ranked, TRUE AS votes_hold FROM sensor""",
)
def train_checks(spark, sf):
    """Bounds of the weighted forest on the held-out rows: accuracy and F1, importances, and its votes."""
    fit, test = _parts(spark, sf)
    model = _forest(fit)
    accuracy, f1 = train.evaluate(model, test)
    ranked = [r["importance"] for r in train.importances(model).collect()]  # one row per feature
    voted = model.transform(test).withColumnRenamed("prediction", "own")
    soft = train.vote(voted, ["probability", "probability"], "soft")
    return test.agg(F.count("*").alias("test_rows")).select(
        (F.lit(fit.count()) + F.col("test_rows")).alias("rows"),
        "test_rows",
        F.lit(accuracy > 0.7 and f1 > 0.7).alias("accurate"),
        F.lit(ranked == sorted(ranked, reverse=True) and abs(sum(ranked) - 1) < 1e-6).alias("ranked"),
        (soft.where("own <> prediction").agg(F.count("*")).scalar() == 0).alias("votes_hold"),
    )


@query(
    "log_batches",
    f"""WITH {SENSOR_CTE} SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id, count(*) AS rows,
        count(*) - 1 AS last FROM sensor GROUP BY 1""",
)
def log_batches(spark, sf):
    """Two batches of one second, one of them logged twice: the same id replaces, another adds."""
    folder, rows = scratch_path(spark, "log"), _scored(spark, sf)
    scored = written(rows, "scored")
    for name, rest in (("even", 0), ("odd", 1), ("even", 0)):
        own = scored.where(F.pmod("user_id", F.lit(2)) == rest)
        writers.append_predictions(own, folder, "batch", name, ts="2024-02-01 00:00:00", order=["sensor_id"])
    log = spark.read.parquet(folder)
    return log.groupBy("run_id").agg(F.count("*").alias("rows"), F.max(F.col("batch_index").cast("bigint")).alias("last"))


@query("batch_scoring")
def batch_scoring(spark, sf):
    return _scored(spark, sf).select(
        "sensor_id", "prediction", "probability", "risk_level", "confidence", "model_version"
    )


@query("batch_scoring_summary")
def batch_scoring_summary(spark, sf):
    return score.batch_summary(_scored(spark, sf), high=[3], low=[0], ts="2024-02-01 00:00:00")


@query("ensemble_votes")
def ensemble_votes(spark, sf):
    """Accuracy of a hard and a soft vote of three candidates on the test rows."""
    fit, test = _parts(spark, sf)
    voted = test.select("sensor_id", TARGET, *FEATURES)
    for name, estimator in {
        "forest": train.pipeline("forest", **FOREST),
        "logistic": train.pipeline("logistic"),
        "small": train.pipeline("forest", seed=7, numTrees=10, maxDepth=4),
    }.items():
        voted = (
            estimator.fit(fit)
            .transform(voted)
            .withColumnsRenamed({"prediction": f"class_{name}", "probability": f"probability_{name}"})
            .drop("raw_features", "features", "rawPrediction")
        )
    hard = train.vote(voted, ["class_forest", "class_logistic", "class_small"])
    soft = train.vote(voted, ["probability_forest", "probability_logistic", "probability_small"], "soft")
    hit = F.round(F.avg((F.col(TARGET) == F.col("prediction")).cast("double")), 4).alias("accuracy")
    return hard.agg(F.lit("hard").alias("how"), hit).unionByName(soft.agg(F.lit("soft").alias("how"), hit))


@query("model_roundtrip", f"WITH {SENSOR_CTE} SELECT count(*) AS rows, count(*) AS same FROM sensor")
def model_roundtrip(spark, sf):
    """A saved and loaded model scores every row alike."""
    fit, _ = _parts(spark, sf)
    model, folder = _forest(fit), scratch_path(spark, "model")
    train.save_model(model, folder, "2024-02-01T00:00:00")
    loaded, _ = train.load_model(folder)
    rows = sensor(spark, sf)
    first = model.transform(rows).select("sensor_id", F.col("prediction").alias("a"))
    second = loaded.transform(rows).select("sensor_id", F.col("prediction").alias("b"))
    return first.join(second, "sensor_id").agg(F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("retrain_and_promote")
def retrain_and_promote(spark, sf):
    """Train, measure, decide against the current model and record the run."""
    fit, test = _parts(spark, sf)
    accuracy, f1 = train.evaluate(_forest(fit), test)
    folder = scratch_path(spark, "runs")
    run = spark.createDataFrame([(accuracy, f1)], "accuracy double, f1 double").withColumns(
        {"train_size": F.lit(fit.count()), "val_size": F.lit(test.count())}
    )
    registry.promote(registry.gate(run)).write.parquet(folder)
    return spark.read.parquet(folder).select("accuracy", "f1", "train_size", "val_size", "improvement", "deploy", "status")


@query(
    "stream_scoring",
    f"""WITH {SENSOR_CTE} SELECT CAST(day AS DATE) AS day, count(*) AS rows, count(*) FILTER (user_id % 3 <> 0) AS scored,
        count(*) FILTER (user_id % 3 <> 0) AS with_risk FROM sensor GROUP BY 1""",
)
def stream_scoring(spark, sf):
    """The sensor rows as a stream, a third without a feature, scored into the prediction log."""
    fit, _ = _parts(spark, sf)
    model, folder = _forest(fit), scratch_path(spark, "scoring")
    rows = sensor(spark, sf).withColumn("ts", F.col("day").cast("timestamp"))
    rows = rows.withColumn("Duration_days", F.when(F.col("user_id") % 3 != 0, F.col("Duration_days")))
    rows.write.parquet(f"{folder}/in")
    stream = streams.ingest_stream(spark, f"{folder}/in", rows.schema)
    streams.score_stream(stream, model, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{folder}/log")
    return log.groupBy(F.col("date").cast("date").alias("day")).agg(F.count("*").alias("rows"), F.count("prediction").alias("scored"), F.count("risk_level").alias("with_risk"))
