"""Metrics, relations, registry, reports and recommendations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardflow.models import registry, score, train
from hazardflow.operators import metrics, quality, relate
from hazardflow.reports import report
from hazardflow.schema import MODEL_RUNS_SCHEMA


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


def test_class_report_with_an_unpredicted_and_an_unknown_class(spark):
    frame = pairs(spark, [(0, 0)] * 3 + [(1, 0)] + [(2, 2)] * 2 + [(2, 3)])
    got = {r.name: r for r in metrics.class_report(frame).collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.0, 0.0, 0.0, 1)
    assert (got["3"].precision, got["3"].support) == (0.0, 0)
    assert got["0"].precision == 0.75 and got["0"].recall == 1.0
    assert got["accuracy"].f1 == pytest.approx(5 / 7)
    assert got["macro avg"].recall == pytest.approx((1 + 0 + 2 / 3 + 0) / 4)
    assert got["weighted avg"].recall == pytest.approx(5 / 7)


def test_published_report(spark):
    """The confusion counts behind a published report give its figures."""
    frame = pairs(spark, [(0, 0)] * 68 + [(1, 1)] * 285 + [(2, 2)] * 35 + [(2, 1)] * 12)
    lines = {r.name: r.line.split() for r in metrics.report_text(metrics.class_report(frame)).collect()}
    assert lines["0"] == ["0", "1.00", "1.00", "1.00", "68"]
    assert lines["1"] == ["1", "0.96", "1.00", "0.98", "285"]
    assert lines["2"] == ["2", "1.00", "0.74", "0.85", "47"]
    assert lines["macro avg"][2:] == ["0.99", "0.91", "0.94", "400"]
    assert lines["accuracy"] == ["accuracy", "0.97", "400"]
    row = {r.name: r for r in metrics.class_report(frame).collect()}["weighted avg"]
    assert [round(v, 4) for v in (row.f1, row.precision, row.recall)] == [0.9681, 0.9712, 0.97]


def test_one_class(spark):
    frame = pairs(spark, [(1, 1)] * 4)
    assert metrics.class_weights(frame, "label").first().weight == 1.0
    assert metrics.accuracy(frame).first().accuracy == 1.0
    assert [r.predicted_1 for r in metrics.confusion(frame, [0, 1]).collect()] == [4]


def test_class_weights(spark):
    frame = pairs(spark, [(0, 0)] * 6 + [(1, 0)] * 2)
    assert {r.label: r.weight for r in metrics.class_weights(frame, "label").collect()} == {0: 8 / 12, 1: 2.0}


def test_cv_stats_use_population_deviation(spark):
    row = metrics.cv_stats(spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, accuracy double")).first()
    assert (row.folds, row["mean"], row["std"]) == (2, 2.0, 1.0)


def test_attach_risk_and_latest(spark):
    numeric = spark.createDataFrame([(1, 0.5), (2, 0.9)], "ts int, probability double")
    text = spark.createDataFrame([(1, "High"), (1, "Low"), (3, "High")], "ts int, value string")
    assert sorted(map(tuple, relate.attach_risk(numeric, text).collect())) == [(1, 0.5, "Low"), (2, 0.9, "Unknown")]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, relate.latest_per_key(rows, ["k"], ["o"]).collect())) == [("a", 2, "y"), ("b", 1, None)]


def test_only_ok_keeps_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "_file string, x int")
    errors = spark.createDataFrame([("b",), ("b",), (None,)], "_file string")
    assert sorted(r.x for r in relate.only_ok(rows, errors).collect()) == [1, 3]


def test_top_rows(spark):
    frame = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.1)], "model string, acc double")
    assert {r.model for r in relate.top_rows(frame, "acc").collect()} == {"a", "b"}
    assert [r.model for r in relate.top_rows(frame, "acc", ties=False, order=["model"]).collect()] == ["a"]


def test_union_and_align(spark):
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    b = spark.createDataFrame([(3.0, 4, "z")], "y double, x int, z string")
    assert sorted(map(tuple, relate.union_all(a, b).collect())) == [(1, 2.0), (4, 3.0)]
    assert relate.align_features(a, ["y", "q", "x"]).first() == (2.0, 0.0, 1)


def test_hazard_index_with_a_zero_column(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "a double, b double")
    assert [r.hazard for r in relate.hazard_index(frame, {"a": 0.5}).orderBy("a").collect()] == [0.25, 0.5]
    assert [r.hazard for r in relate.hazard_index(frame, {"a": 0.5, "b": 0.5}).collect()] == [None, None]


def test_gate_borders(spark):
    runs = spark.createDataFrame([(0.83,), (0.8299,), (0.82,)], "accuracy double")
    out = registry.promote(registry.gate(runs)).orderBy(F.desc("accuracy")).collect()
    assert [r.deploy for r in out] == [True, False, False]
    assert [r.status for r in out] == ["deployed", "skipped", "skipped"]
    assert out[1].reason == "Insufficient improvement" and out[0].reason is None


def test_registry(spark, tmp_path):
    path = str(tmp_path / "runs")
    day = dt.datetime(2024, 1, 1)
    registry.append_run(spark, path, (day, "m1", 0.90, 0.9, 80, 20, True, 0.08, "deployed"))
    later = (day + dt.timedelta(days=1), "m2", 0.905, 0.9, 80, 20, False, 0.005, "skipped")
    for _ in range(2):  # a repeat replaces the row
        registry.append_run(spark, path, later, "second")
    registry.append_run(spark, str(tmp_path / "other"), later)
    registry.append_run(spark, str(tmp_path / "other"), later)
    assert registry.read_runs(spark, str(tmp_path / "other")).count() == 2  # one second, two runs
    runs = registry.read_runs(spark, path)
    assert runs.count() == 2
    assert registry.current_model(runs).first().model_path == "m1"
    decided = registry.gate(spark.createDataFrame([(0.905,)], "accuracy double"), registry.current_accuracy(runs))
    assert decided.first().deploy is False
    empty = runs.where("false")
    assert registry.gate(spark.createDataFrame([(0.83,)], "accuracy double"), registry.current_accuracy(empty)).first().deploy
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert registry.retrain_due(runs, F.lit(100), now).first().due is True
    assert registry.retrain_due(runs, F.lit(99), now).first().due is False
    assert registry.retrain_due(runs, F.lit(100), F.lit("2024-01-02 23:00:00").cast("timestamp")).first().due is False
    assert registry.retrain_due(empty, F.lit(100), now).first().due is True
    previous = relate.previous_run(runs, F.lit(day + dt.timedelta(days=1))).first().previous_run
    assert previous == day
    assert relate.run_intervals(runs.withColumn("model_path", F.lit("m"))).where("previous_run IS NULL").count() == 1
    assert report.retrain_report(runs, "2024-01-01").count() == 1
    assert runs.schema == MODEL_RUNS_SCHEMA


def summary(spark, warnings, missing, reduction, rate=100.0):
    return spark.createDataFrame(
        [(warnings, missing, reduction, rate)],
        "files_with_warnings int, total_missing_values int, data_reduction_pct double, success_rate double",
    )


def test_recommendations_and_actions(spark):
    names = lambda frame: [r.category for r in quality.recommendations(frame).collect()]
    assert names(summary(spark, 0, 0, 20.0)) == []
    assert names(summary(spark, 1, 1, 20.01)) == ["data_quality", "data_completeness", "data_efficiency"]
    done = [r.action for r in quality.next_actions(summary(spark, 0, 0, 0.0)).collect()]
    failed = [r.action for r in quality.next_actions(summary(spark, 0, 0, 0.0, 99.0)).collect()]
    assert done == quality.AFTER_SUCCESS + quality.ALWAYS and failed == quality.AFTER_FAILURE + quality.ALWAYS


def test_reports_without_files(spark):
    stages = spark.createDataFrame(
        [], "_file string, status string, rows_before int, rows_after int, rows_removed int, points int, storage_status string"
    )
    row = report.ingest_summary(stages).first()
    assert (row.files_found, row.success_rate, row.data_reduction_pct, row.records) == (0, 0.0, 0.0, 0)
    assert report.storage_summary(stages).first().completion_rate == 0.0


def test_with_errors(spark):
    table = spark.createDataFrame([("a", "ok", None), ("b", "ok", None)], "_file string, status string, error string")
    errors = spark.createDataFrame([("b", "boom")], "_file string, error string")
    assert {r._file: r.status for r in quality.with_errors(table, errors).collect()} == {"a": "ok", "b": "error"}


def test_votes(spark):
    frame = spark.createDataFrame([(0, 1, 1), (2, 1, 0), (3, 3, 0)], "a int, b int, c int")
    assert [r.prediction for r in train.vote(frame, ["a", "b", "c"]).collect()] == [1, 0, 3]


def test_batch_summary_counts_critical_as_intense(spark):
    frame = spark.createDataFrame(
        [(1, 0.9, 0.8, "Critical"), (0, 0.1, 0.7, "Intense"), (2, 0.5, 0.0, "Medium")],
        "prediction int, probability double, confidence double, risk_level string",
    )
    row = score.batch_summary(frame, ts="2024-01-01 02:03:04").first()
    assert (row.risk_intense, row.risk_medium, row.risk_high, row.total_high_risk) == (2, 1, 0, 1)
    assert row.batch_id == "batch_20240101_020304_3" and row.average_probability == 0.5
