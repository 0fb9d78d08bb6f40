"""Promotion decisions over the model_runs table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.schema import MODEL_RUNS_SCHEMA

# Accuracy to beat when no model is deployed, and the least gain.
BASELINE_ACCURACY = 0.82
IMPROVEMENT = 0.01
_ROUNDING = 1e-9


def gate_columns(current: Column, new: Column, threshold: float = IMPROVEMENT) -> dict[str, Column]:
    """Deploy when the new accuracy is better by the threshold or more."""
    gain = new - current
    return {
        "improvement": F.round(gain, 6),
        "threshold": F.lit(threshold),
        "deploy": gain >= threshold - _ROUNDING,
    }


def gate(runs: DataFrame, current: Column | None = None, threshold: float = IMPROVEMENT) -> DataFrame:
    base = F.lit(BASELINE_ACCURACY) if current is None else current
    return runs.withColumns(gate_columns(base, F.col("accuracy"), threshold))


def promote(decided: DataFrame) -> DataFrame:
    """Status and reason of each decision."""
    return decided.withColumn("status", F.when(F.col("deploy"), "deployed").otherwise("skipped")).withColumn(
        "reason", F.when(~F.col("deploy"), "Insufficient improvement")
    )


def append_run(spark: SparkSession, path: str, row: tuple, run_id: str | None = None) -> None:
    """Add one row to model_runs.

    The same run_id replaces its earlier row; without one the row is always added.
    """
    run = spark.createDataFrame([row], MODEL_RUNS_SCHEMA)
    run.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run_id or uuid.uuid4().hex}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_RUNS_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def current_model(model_runs: DataFrame) -> DataFrame:
    """The last deployed run; `accuracy` of it is what a new model must beat."""
    names = [f.name for f in MODEL_RUNS_SCHEMA.fields if f.name != "run_ts"]
    return (
        model_runs.where("status = 'deployed'")
        .agg(F.max_by(F.struct("run_ts", *names), "run_ts").alias("last"))
        .where("last IS NOT NULL")
        .select("last.*")
    )


def current_accuracy(model_runs: DataFrame) -> Column:
    return F.coalesce(current_model(model_runs).select("accuracy").scalar(), F.lit(BASELINE_ACCURACY))


def retrain_due(model_runs: DataFrame, rows: Column, now: Column, hours: int = 24, min_rows: int = 100) -> DataFrame:
    """Whether enough time has passed since the last run and enough rows wait."""
    last = F.max("run_ts")
    old = F.coalesce(last <= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))
    return model_runs.agg(last.alias("last_run"), (old & (rows >= min_rows)).alias("due"))
