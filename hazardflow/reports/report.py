"""Run summaries and the two JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.operators.quality import next_action_list, recommendation_list
from hazardflow.schema import FILE_KEY


def _pct(part, whole):
    return F.when(whole > 0, F.round(part * 100 / whole, 2)).otherwise(0.0)


def storage_summary(stored: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") != "error")
    return stored.agg(
        F.count("*").alias("total_files"),
        ok.alias("successful_files"),
        F.count_if(F.col("status") == "error").alias("failed_files"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("total_points"),
        _pct(ok, F.count("*")).alias("completion_rate"),
    )


def ingest_summary(stages: DataFrame) -> DataFrame:
    """Totals over the joined stage table (one row per found file).

    Expects status, rows_before, rows_after, rows_removed, points and
    storage_status, with NULL where a file did not reach a stage.
    """
    stored = F.count_if(F.col("points").isNotNull() & (F.coalesce("storage_status", F.lit("ok")) != "error"))
    before = F.sum("rows_before")
    return stages.agg(
        F.count("*").alias("files_found"),
        F.count_if(F.col("status") != "error").alias("files_validated"),
        F.count_if(F.col("rows_before").isNotNull()).alias("files_cleaned"),
        stored.alias("files_stored"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("records"),
        _pct(stored, F.count("*")).alias("success_rate"),
        F.coalesce(_pct(F.sum("rows_removed"), before), F.lit(0.0)).alias("data_reduction_pct"),
    )


def quality_report(
    validation: DataFrame, summary: DataFrame, run_ts, name: str = "sensor_ingestion"
) -> DataFrame:
    """Report head: metadata, summaries, recommendations, next actions.

    The stage tables have a row per file and stay tables of their own (write
    them with write_report); the head holds only totals, whatever the number of
    files.
    """
    totals = validation.select(F.struct("*")).scalar()
    head = summary.withColumn("_validation", totals).select("*", "_validation.*")
    ts = F.lit(run_ts).cast("timestamp")
    return head.select(
        F.struct(
            F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("report_generation_time"),
            F.date_format(ts, "yyyy-MM-dd").alias("run_date"),
            F.lit(name).alias("name"),
            F.lit("1.0.0").alias("report_version"),
        ).alias("report_metadata"),
        F.struct(*[F.col(c) for c in summary.columns]).alias("execution_summary"),
        F.struct(*[F.col(c) for c in validation.columns]).alias("validation_summary"),
        F.lit("success").alias("overall_status"),
        recommendation_list().alias("recommendations"),
        next_action_list().alias("next_actions"),
    )


def stage_report(stages: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """One JSON-ready row per file with its stage results."""
    return stages.select(key, F.struct(*[c for c in stages.columns if c != key]).alias("stages"))


def retrain_report(model_runs: DataFrame, run_date: str) -> DataFrame:
    """The runs of one day as training, validation and deployment sections."""
    day = model_runs.where(F.to_date("run_ts") == F.lit(run_date).cast("date"))
    return day.select(
        F.lit(run_date).alias("execution_date"),
        F.struct("model_path", "accuracy", "f1", "train_size", "val_size").alias("model_training"),
        F.struct("deploy", "accuracy", "improvement").alias("validation"),
        F.struct("status", "model_path").alias("deployment"),
    )
