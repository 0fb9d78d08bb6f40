"""Batch scoring, batch summaries and the recent view of the prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.functions.scalar import (
    batch_id,
    confidence,
    hazard_probability,
    predicted_probability,
    risk_level,
)
from hazardflow.models.train import features_of, missing_fields
from hazardflow.schema import FEATURES, RISK_LEVELS


def score(
    model: PipelineModel,
    frame: DataFrame,
    accuracy: float = 0.95,
    ts=None,
    version: str = "v1.0.0",
    hazard_classes: Sequence[int] | None = None,
) -> DataFrame:
    """Prediction, probability, risk level and confidence per row; lazy and shuffle-free.

    Every row comes back: one without all features has NULL results and is told by
    `rejects`. The risk level follows the probability of the predicted class, or with
    `hazard_classes` the summed probability of those classes.
    """
    keeping = model.copy()
    keeping.stages[0].setHandleInvalid("keep")
    known = F.size(missing_fields(features_of(model))) == 0
    out = keeping.transform(frame)
    vector, code = F.col("probability"), F.col("prediction")
    p = hazard_probability(vector, hazard_classes) if hazard_classes else predicted_probability(vector, code)
    return (
        out.withColumn("_p", F.when(known, p))
        .withColumn("prediction", F.when(known, code.cast("int")))
        .withColumns(
            {
                "probability": F.round("_p", 4),
                "risk_level": risk_level(F.col("_p")),
                "confidence": F.round(confidence(F.col("_p"), accuracy), 4),
                "prediction_time": F.lit(ts).cast("timestamp"),
                "model_version": F.lit(version),
            }
        )
        .drop("_p", "raw_features", "features", "rawPrediction")
    )


def rejects(scored: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """The rows that could not be scored, with the names of their missing fields."""
    return scored.withColumn("missing_fields", missing_fields(features)).where("prediction IS NULL")


def risk_of(level: str) -> Column:
    """Test for a risk band; Critical is the old name of Intense."""
    return F.col("risk_level").isin("Intense", "Critical") if level == "Intense" else F.col("risk_level") == level


def batch_summary(
    scored: DataFrame, high: Sequence[int] = (1,), low: Sequence[int] = (0,), ts=None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per batch: class counts, mean probability and confidence, risk buckets."""
    out = scored.groupBy(*by).agg(
        F.count("*").alias("total_predictions"),
        F.count_if(F.col("prediction").isin(list(high))).alias("total_high_risk"),
        F.count_if(F.col("prediction").isin(list(low))).alias("total_low_risk"),
        F.round(F.avg(F.round("probability", 4)), 4).alias("average_probability"),
        F.round(F.avg(F.round("confidence", 4)), 4).alias("average_confidence"),
        *[F.count_if(risk_of(level)).alias(f"risk_{level.lower()}") for level in RISK_LEVELS],
    )
    if ts is not None:
        out = out.withColumn("batch_id", batch_id(F.lit(ts).cast("timestamp"), F.col("total_predictions")))
    return out


def risk_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_level").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "risk_level")


def recent(scored: DataFrame, now: Column, last: str = "24 hours") -> DataFrame:
    return scored.where((F.col("ts") > now - F.expr(f"INTERVAL {last}")) & (F.col("ts") <= now))


def recent_summary(scored: DataFrame, now: Column, last: str = "24 hours") -> DataFrame:
    return recent(scored, now, last).agg(
        F.count("*").alias("predictions"), F.count_if(F.col("risk_level") == "High").alias("high_risk")
    )
