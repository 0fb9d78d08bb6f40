import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardflow.functions.scalar import cut
from hazardflow.models import registry
from hazardflow.operators.relate import hazard_index, latest
from hazardflow.plans import flows
from hazardflow.schema import FEATURES, HAZARD_WEIGHTS, REQUIRED, TARGET
from hazardflow.session import written
from hazardflow.sources.readers import read_csv_files, read_points, read_predictions

HEADER = ",".join(REQUIRED)


def test_ingest(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text(f",{HEADER}\n" + "0,1,2,3,4,5,6,7,8,1\n0,1,2,3,4,5,6,7,8,1\n1,0,0,0,0,0,0,0,0,0\n")
    (inbox / "b.CSV").write_text(f"{HEADER},note,depth,flag\n9,2,3,4,5,6,7,8,2,x,1.5,True\n")
    (inbox / "bad.csv").write_text("")
    for _ in range(2):  # a repeated run replaces itself
        out = flows.ingest(spark, str(inbox), str(tmp_path / "out"), "r1", "2024-01-02 00:00:00")
    row = out["summary"].first()
    assert (row.files_found, row.files_validated, row.files_stored, row.records) == (3, 2, 2, 2)
    assert row.success_rate == 66.67
    head = out["report"].first()
    assert [r.category for r in head.recommendations] == ["data_quality", "data_efficiency"]
    assert len(head.next_actions) == 6
    assert out["stages"].count() == 3
    points = read_points(spark, str(tmp_path / "out/points"), "sensors", ["Duration_days"], "2024-01-02 00:00:00")
    assert sorted(r.value for r in points.collect()) == [1.0, 9.0]
    stored = spark.read.parquet(str(tmp_path / "out/points"))
    extra = {r.fields["Duration_days"]: (r.tags, r.fields.get("depth")) for r in stored.collect()}
    assert extra == {1.0: ({}, None), 9.0: ({"note": "x"}, 1.5)}
    again, listed = read_csv_files(spark, str(tmp_path / "out/clean/run_id=r1/layout=*/output_name=*"))
    headers = {len(r.columns) for r in listed.collect()}
    assert again.count() == 2 and headers == {10, 12}  # the index column stays


@pytest.fixture(scope="module")
def readings(spark):
    spans = [(1, 30), (2, 8), (10, 1000), (5, 500), (0, 5), (20, 2000), (10, 800), (0, 6)]
    unit = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_000)) / 100_000
    drawn = spark.range(600).select(
        "id", *[(lo + unit(i) * (hi - lo)).alias(c) for i, (c, (lo, hi)) in enumerate(zip(FEATURES, spans))]
    )
    labelled = hazard_index(drawn, HAZARD_WEIGHTS).withColumn(TARGET, cut(F.col("hazard"), [0.4, 0.7], [0, 1, 2]))
    return written(labelled.drop("hazard"), "readings")


def test_retrain_then_score(spark, readings, tmp_path):
    runs, model = str(tmp_path / "runs"), str(tmp_path / "model")
    base = readings.where("id < 500")
    feedback = readings.where("id >= 500").withColumnRenamed(TARGET, "corrected_class")
    day = dt.datetime(2024, 1, 1)
    first = flows.retrain(spark, base, feedback, runs, model, day, "id", numTrees=20).first()
    assert first.train_size + first.val_size == 600 and first.val_size == 120
    assert first.accuracy > 0.7 and first.deploy == (first.accuracy - 0.82 >= 0.01 - 1e-9)
    second = flows.retrain(spark, base, feedback, runs, model, day + dt.timedelta(days=1), "id", numTrees=20).first()
    current = first.accuracy if first.deploy else 0.82
    assert second.improvement == round(second.accuracy - current, 6)
    assert second.status == ("deployed" if second.accuracy - current >= 0.01 - 1e-9 else "skipped")
    assert registry.read_runs(spark, runs).count() == 2

    rows = readings.withColumn("Duration_days", F.when(F.col("id") == 7, 1000.0).otherwise(F.col("Duration_days")))
    for _ in range(2):
        summary, rejected = flows.score_batch(spark, model, rows, str(tmp_path / "log"), "2024-01-03 00:00:00", ["id"], batch_id="a")
    assert [r.id for r in rejected.collect()] == [7]
    assert summary.first().total_predictions == 599
    log = read_predictions(spark, str(tmp_path / "log"), "2024-01-03 00:00:00")
    other, _ = flows.score_batch(spark, model, rows.where("id < 9"), str(tmp_path / "log"), "2024-01-03 00:00:00", ["id"])
    assert read_predictions(spark, str(tmp_path / "log"), "2024-01-03 00:00:00").count() == 599 + 8
    assert log.count() == 599 and len(latest(log, 5).collect()) == 5


def test_ingest_of_odd_files(spark, tmp_path):
    """Equal numbers spelled apart, quoted line breaks, dotted headers, an index column, no feature at all."""
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("Duration_days,Energy_Unit_log\n1.0,2\n1.00,2\n3,4\n")
    (folder / "b.csv").write_text('Duration_days,note\n5,"x\ny"\n6,z\n')
    (folder / "c.csv").write_text("temp.max,temp.max\n7,8\n")
    (folder / "d.csv").write_text(",Duration_days\n0,9\n1,9\n")
    (folder / "e.csv").write_text("")
    out = flows.ingest(spark, str(folder), str(tmp_path / "out"), "r", "2024-01-01 00:00:00")
    rows = {r._file.rsplit("/", 1)[1]: r for r in out["stages"].collect()}
    assert (rows["a.csv"].rows, rows["a.csv"].duplicates_removed, rows["a.csv"].rows_after) == (3, 1, 2)
    assert (rows["b.csv"].rows, rows["b.csv"].rows_after, rows["b.csv"].duplicates_removed) == (2, 2, 0)
    assert rows["c.csv"].rows_after == 1 and rows["e.csv"].status == "error"
    assert (rows["d.csv"].rows_after, rows["d.csv"].duplicates_removed) == (2, 0)


def test_ingest_without_any_feature(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n")
    out = flows.ingest(spark, str(folder), str(tmp_path / "out"), "r", "2024-01-01 00:00:00")
    assert out["summary"].count() == 1 and out["stages"].first().rows_after == 1


def test_ingest_of_bad_files_only(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("")
    out = flows.ingest(spark, str(folder), str(tmp_path / "out"), "r", "2024-01-01 00:00:00")
    assert [r.status for r in out["validated"].collect()] == ["error"]


def test_ingest_of_names_that_differ_in_case(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("Duration_days,Note\n1,x\n")
    (folder / "b.csv").write_text("duration_days,note\n2,y\n")
    flows.ingest(spark, str(folder), str(tmp_path / "out"), "r", "2024-01-01 00:00:00")
    heads = {p.read_text().split("\n")[0] for p in (tmp_path / "out" / "clean").rglob("*.csv")}
    assert heads == {"Duration_days,Note", "duration_days,note"}
    stored = {tuple(sorted({**r.fields, **r.tags})) for r in spark.read.parquet(str(tmp_path / "out/points")).collect()}
    assert stored == {("Duration_days", "Note"), ("duration_days", "note")}
