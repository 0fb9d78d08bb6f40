"""The three end-to-end jobs: ingest a folder, retrain and promote, score and log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.models import registry, score, train
from hazardflow.operators import clean, quality, relate, split
from hazardflow.operators.lookup import attach
from hazardflow.operators.profile import by_value, range_check, row_copies
from hazardflow.reports import report
from hazardflow.schema import EXTRA_CELL, FEATURES, FILE_KEY, TARGET
from hazardflow.session import written
from hazardflow.sources import points as pts
from hazardflow.sources import readers, writers


def ingest(
    spark: SparkSession, folder: str, out: str, run_id: str, now: str, measurement: str = "sensors", suffix: str = ".csv"
) -> dict[str, DataFrame]:
    """Read, validate, clean, store and report every CSV file of a folder.

    Writes <out>/clean, <out>/points and <out>/reports for the run; gives the
    stage tables (one row per file), the summary and the report head.
    """
    rows, files = readers.read_csv_files(spark, folder, suffix=suffix)
    copies = written(row_copies(by_value(rows)), "copies")
    checked = written(quality.validate_files(copies, files), "validated")

    good = relate.only_ok(copies.drop(EXTRA_CELL), checked.where("status = 'error'"))
    accepted = checked.where("status <> 'error'").select(FILE_KEY, "columns")
    cleaned, stats = clean.clean_table(good, files=files)
    cleaned, stats = written(cleaned, "cleaned"), written(relate.for_every(accepted, stats), "stats")
    outputs = writers.write_clean(cleaned, f"{out}/clean/run_id={run_id}", run_id, files=accepted)
    typed = attach(cleaned, checked.select(FILE_KEY, F.col("data_types").alias("_types")), [FILE_KEY])
    points = pts.to_points(typed, measurement, now=now, types="_types")
    stored = relate.for_every(accepted, writers.write_points(points, f"{out}/points", run_id))
    stored = written(stored.na.fill({"status": "success"}), "stored")

    stages = relate.join_stages(checked, stats, stored.withColumnRenamed("status", "storage_status"))
    validation = quality.validation_summary(checked)
    summary = report.ingest_summary(stages)
    head = report.quality_report(validation, summary, now)
    writers.write_report(head, f"{out}/reports/run_id={run_id}/head")
    writers.write_report(report.stage_report(stages), f"{out}/reports/run_id={run_id}/files")
    return {
        "validated": checked,
        "cleaned": cleaned,
        "stats": stats,
        "outputs": outputs,
        "stored": stored,
        "stages": stages,
        "summary": summary,
        "report": head,
    }


def retrain(
    spark: SparkSession,
    base: DataFrame,
    feedback: DataFrame,
    runs_path: str,
    model_path: str,
    run_ts,
    key: str,
    features: Sequence[str] = tuple(FEATURES),
    run_id: str | None = None,
    **forest,
) -> DataFrame:
    """Join base rows and corrected feedback, train, compare with the current model, record the run.

    `base` has the features, the target and a row key; `feedback` has the
    features, the key and `corrected_class`. Rows without all features or the
    target are written to `model_path`/skipped. Gives the recorded run; a repeat
    with the same run_id replaces it.
    """
    labelled = train.feedback_labels(feedback).withColumnRenamed("target", TARGET)
    names = [key, *features, TARGET]
    every = written(relate.union_all(base.select(*names), labelled.select(*names)), "every")
    rows, skipped = train.split_complete(every, [*features, TARGET])
    skipped.write.mode("overwrite").parquet(f"{model_path}/skipped")
    parts = written(split.stratified_split(rows, TARGET, key), "split")
    fit, test = parts.where("NOT is_test"), parts.where("is_test")
    settings = {**train.RETRAIN_FOREST, **forest}
    model = train.pipeline("forest", features, weight="weight", **settings).fit(train.add_class_weights(fit))
    accuracy, f1 = train.evaluate(model, test)
    train.save_model(model, model_path, run_ts, features)

    try:
        current = registry.current_accuracy(registry.read_runs(spark, runs_path))
    except Exception as problem:  # no run recorded yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        current = None
    measured = spark.createDataFrame([(accuracy,)], "accuracy double")
    decided = registry.promote(registry.gate(measured, current)).first()
    run = (run_ts, model_path, accuracy, f1, fit.count(), test.count(), decided.deploy, decided.improvement, decided.status)
    run_id = run_id or uuid.uuid4().hex
    registry.append_run(spark, runs_path, run, run_id)
    return registry.read_runs(spark, f"{runs_path}/run={run_id}")


def score_batch(
    spark: SparkSession,
    model_path: str,
    frame: DataFrame,
    log: str,
    now: str,
    order: Sequence[str],
    version: str = "v1.0.0",
    batch_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score the rows inside the bounds, add them to the prediction log, summarise the batch.

    Gives the summary and the rejected rows with the names of the bad fields
    (out of bounds, NULL or NaN). The same batch_id replaces its rows in the log;
    without one the batch is always added.
    """
    model, _ = train.load_model(model_path)
    good, out = quality.split_valid(range_check(frame))
    complete, missing = train.split_complete(good, train.features_of(model))
    rejected = out.unionByName(missing.withColumnRenamed("missing_fields", "violations"))
    scored = written(score.score(model, complete, ts=now, version=version), "scored")
    writers.append_predictions(scored, log, "batch", batch_id or uuid.uuid4().hex, ts=now, order=order)
    return score.batch_summary(scored, ts=now), rejected
