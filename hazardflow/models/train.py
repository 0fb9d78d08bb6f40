"""Classifier pipelines, cross-validation, comparison, importances, votes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.models import forest_table
from hazardflow.operators.lookup import attach
from hazardflow.operators.metrics import class_weights, cv_stats, weighted_f1
from hazardflow.schema import CLASS_NAMES, FEATURES, TARGET

# The forest settings in use at training and at retraining.
TRAIN_FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2}
RETRAIN_FOREST = {"numTrees": 100, "maxDepth": 8}
BOOSTING = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1}
# Classes fitted at a time, one against rest: their many short jobs share the cores; each keeps its rows cached.
CLASSES_AT_ONCE = 4


def _classifier(kind: str, label: str, weight: str | None, seed: int, params: Mapping):
    common = {"labelCol": label, "featuresCol": "features"}
    weighted = {"weightCol": weight} if weight else {}
    if kind == "forest":
        options = {"featureSubsetStrategy": "sqrt", "seed": seed, **params}
        return RandomForestClassifier(**common, **weighted, **options)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(**params), parallelism=CLASSES_AT_ONCE, **common, **weighted)
    if kind == "boosting":
        base = GBTClassifier(**{**BOOSTING, "seed": seed, **params})
        return OneVsRest(classifier=base, parallelism=CLASSES_AT_ONCE, **common, **weighted)
    if kind == "logistic":
        return LogisticRegression(family="multinomial", **common, **weighted, **params)
    raise ValueError(f"unknown model kind {kind}")


def missing_fields(features: Sequence[str] = tuple(FEATURES)) -> Column:
    """Names of the features that are NULL or NaN."""
    gone = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in features]
    return F.array_compact(F.array(*gone))


def split_complete(frame: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> tuple[DataFrame, DataFrame]:
    """Rows with all features, and the others with `missing_fields`."""
    missing = missing_fields(features)
    return frame.where(F.size(missing) == 0), frame.withColumn("missing_fields", missing).where(F.size("missing_fields") > 0)


def features_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def pipeline(
    kind: str,
    features: Sequence[str] = tuple(FEATURES),
    label: str = TARGET,
    weight: str | None = None,
    seed: int = 42,
    **params,
) -> Pipeline:
    """Assemble, scale and classify; the scaler is fitted with the model.

    kind is forest, svm (linear, one against rest), boosting (one against rest)
    or logistic. Rows without a feature are an error here: `split_complete` tells
    them apart, so that none vanishes uncounted.
    """
    assemble = VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[assemble, scale, _classifier(kind, label, weight, seed, params)])


def standardise(fit: DataFrame, frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale by mean and population deviation of `fit`; constant columns only shift."""
    stats = fit.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
        )
    ).scalar()
    return frame.withColumns(
        {
            c: (F.col(c) - stats.getField(f"mean_{c}"))
            / F.when(stats.getField(f"std_{c}") == 0, 1.0).otherwise(stats.getField(f"std_{c}"))
            for c in columns
        }
    )


def add_class_weights(frame: DataFrame, label: str = TARGET, name: str = "weight") -> DataFrame:
    weights = class_weights(frame, label).select(label, F.col("weight").alias(name))
    return attach(frame, weights, [label])


def accuracy_of(model: PipelineModel, frame: DataFrame, label: str = TARGET) -> DataFrame:
    """Accuracy over the rows with all features."""
    hit = (F.col(label) == F.col("prediction")).cast("double")
    complete, _ = split_complete(frame, features_of(model))
    return model.transform(complete).agg(F.avg(hit).alias("accuracy"))


def cross_validate(estimator: Pipeline, frame: DataFrame, fold: str, k: int, label: str = TARGET) -> DataFrame:
    """(fold, accuracy) for k fits, each tested on its own fold."""
    scores = []
    for i in range(k):
        model = estimator.fit(frame.where(F.col(fold) != i))
        scores.append(
            accuracy_of(model, frame.where(F.col(fold) == i), label).select(F.lit(i).alias("fold"), "accuracy")
        )
    return reduce(DataFrame.unionByName, scores)


def compare(
    kinds: Mapping[str, Pipeline], train: DataFrame, test: DataFrame, fold: str, k: int = 5, label: str = TARGET
) -> DataFrame:
    """One row per candidate: train, test and cross-validated accuracy, rounded to 4."""
    rows = []
    for name, estimator in kinds.items():
        model = estimator.fit(train)
        folds = cv_stats(cross_validate(estimator, train, fold, k, label))
        rows.append(
            accuracy_of(model, train, label).select(
                F.lit(name).alias("model"),
                F.round("accuracy", 4).alias("train_accuracy"),
                F.round(accuracy_of(model, test, label).scalar(), 4).alias("test_accuracy"),
                F.round(folds.select("mean").scalar(), 4).alias("cv_mean"),
                F.round(folds.select("std").scalar(), 4).alias("cv_std"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def importances(model: PipelineModel, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """(feature, importance) in falling order, for tree models."""
    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    else:
        values = sum(m.featureImportances.toArray() for m in fitted.models) / len(fitted.models)
    spark = SparkSession.getActiveSession()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def top_features(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy(F.desc("importance"), "feature").limit(k)


def vote(predictions: DataFrame, columns: Sequence[str], how: str = "hard") -> DataFrame:
    """Ensemble prediction from one column per candidate, whatever the class codes.

    hard: most frequent class, the smallest on ties, from predicted classes; NULL
    is no ballot. soft: class with the highest mean probability, the smallest on
    ties, from probability vectors of equal length.
    """
    if how == "hard":
        ballots = F.array_compact(F.array(*[F.col(c).cast("int") for c in columns]))
        counted = F.transform(
            F.array_distinct(ballots),
            lambda code: F.struct((-F.size(F.filter(ballots, lambda b: b == code))).alias("rank"), code.alias("code")),
        )
        return predictions.withColumn("prediction", F.array_min(counted)["code"])
    sums = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [vector_to_array(F.col(c)) for c in columns])
    return predictions.withColumn("prediction", (F.array_position(sums, F.array_max(sums)) - 1).cast("int"))


def feedback_labels(feedback: DataFrame) -> DataFrame:
    return feedback.withColumn("target", F.col("corrected_class"))


def agreement(feedback: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    same = (F.col("predicted_class") == F.col("corrected_class")).cast("double")
    return feedback.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(same).alias("agreement"))


def evaluate(model: PipelineModel, frame: DataFrame, label: str = TARGET) -> tuple[float, float]:
    """Accuracy and weighted F1 over the rows with all features of a test table."""
    predicted = model.transform(split_complete(frame, features_of(model))[0]).select(label, "prediction")
    pairs = predicted.groupBy(label, "prediction").agg(F.count("*").alias("n"))
    hits = F.sum(F.when(F.col(label) == F.col("prediction"), F.col("n")).otherwise(0))
    score = pairs.agg((hits / F.sum("n")).alias("accuracy")).first()["accuracy"]
    return score, weighted_f1(predicted, label).first()["f1"]


def save_model(
    model: PipelineModel,
    path: str,
    trained_at,
    features: Sequence[str] = tuple(FEATURES),
    target: str = TARGET,
    class_names: Mapping[int, str] = CLASS_NAMES,
) -> None:
    """Save the fitted pipeline and beside it one JSON row of metadata, and a forest's nodes as a table."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    if isinstance(model.stages[-1], RandomForestClassificationModel):
        forest_table.exported(spark, f"{path}/model").write.mode("overwrite").parquet(f"{path}/nodes")
    row = (list(features), target, json.dumps(dict(class_names)), str(trained_at))
    schema = "feature_names array<string>, target_name string, class_names string, last_training_time string"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.getActiveSession()
    schema = "feature_names array<string>, target_name string, class_names string, last_training_time string"
    meta = spark.read.schema(schema).json(f"{path}/metadata").first().asDict()
    meta["class_names"] = {int(k): v for k, v in json.loads(meta["class_names"]).items()}
    return PipelineModel.load(f"{path}/model"), meta
