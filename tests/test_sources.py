import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardflow.functions.scalar import base_name
from hazardflow.operators import clean, quality, relate
from hazardflow.operators.profile import row_copies
from hazardflow.schema import EXTRA_CELL, FILE_KEY, REQUIRED
from hazardflow.sources import points as pts
from hazardflow.sources import readers, writers

HEADER = ",".join(REQUIRED)


@pytest.fixture
def folder(tmp_path):
    def write(files):
        for name, text in files.items():
            (tmp_path / name).write_text(text)
        return str(tmp_path)

    return write


def test_list_inputs_ignores_case_and_others(spark, folder):
    path = folder({"a.csv": "x\n1\n", "B.CSV": "x\n", "c.txt": "no"})
    got = {r["path"].rsplit("/", 1)[1]: r["bytes"] for r in readers.list_inputs(spark, path).collect()}
    assert got == {"a.csv": 4, "B.CSV": 2}


def test_mixed_headers(spark, folder):
    path = folder(
        {
            "one.csv": "a,b\n1,2\n3,NA\n",
            "two.csv": 'b,"c, d"\n5,"x ""y"""\n',
            "index.csv": ",a\n0,7\n",
            "head only.csv": "a,b\n",
            "empty.csv": "",
            "case.csv": "a,A\n1,2\n",
            "long.csv": "a,b\n1,2\n1,2,3\n",
        }
    )
    rows, files = readers.read_csv_files(spark, path)
    table = {base_of(r): r for r in files.withColumn(FILE_KEY, base_name(F.col(FILE_KEY))).collect()}
    assert table["empty.csv"].status == "error" and table["case.csv"].status == "error"
    assert table["index.csv"].columns == ["Unnamed: 0", "a"]
    assert table["two.csv"].columns == ["b", "c, d"]
    got = {(base_name_of(r), r["a"], r["b"], r["c, d"]) for r in rows.where(f"{EXTRA_CELL} IS NULL").collect()}
    assert ("one.csv", "3", None, None) in got and ("two.csv", None, "5", 'x "y"') in got
    assert "Unnamed: 0" not in readers.drop_index_column(rows).columns

    checked = quality.validate_files(rows, files, required=["a", "b"], features=["a", "b"])
    by_file = {base_of(r): r for r in checked.withColumn(FILE_KEY, base_name(F.col(FILE_KEY))).collect()}
    assert len(by_file) == 7
    assert by_file["long.csv"].status == "error" and by_file["one.csv"].status == "ok"
    head = by_file["head%20only.csv"] if "head%20only.csv" in by_file else by_file["head only.csv"]
    assert (head.rows, head.empty_columns, head.categorical_columns) == (0, ["a", "b"], ["a", "b"])
    assert by_file["two.csv"].missing_columns == ["a"] and by_file["two.csv"].missing_total == 0
    assert by_file["one.csv"].data_types["b"] == "float64" and by_file["one.csv"].missing_total == 1
    summary = quality.validation_summary(checked).first()
    assert (summary.total_files, summary.files_with_errors) == (7, 3)


def base_of(row):
    return row[FILE_KEY]


def base_name_of(row):
    return row[FILE_KEY].rsplit("/", 1)[1]


def test_header_names():
    assert readers.header_names("﻿a,,a,a,b") == ["a", "Unnamed: 1", "a.1", "a.2", "b"]
    assert readers.header_names('"x, y",z') == ["x, y", "z"]


def test_no_files(spark, folder):
    rows, files = readers.read_csv_files(spark, folder({"note.txt": "x"}))
    assert rows.count() == 0 and files.count() == 0
    assert quality.validation_summary(quality.validate_files(rows, files)).first().total_rows == 0


def test_every_null_token_and_infinity(spark, folder):
    from hazardflow.schema import NULL_TOKENS

    lines = "\n".join(f"{i},{t}" for i, t in enumerate(NULL_TOKENS))
    path = folder({"n.csv": f"i,x\n{lines}\n98,inf\n99,text\n"})
    rows, files = readers.read_csv_files(spark, path)
    assert rows.where("x IS NULL").count() == len(NULL_TOKENS)
    row = quality.validate_files(rows, files).first()
    assert row.missing_per_column["x"] == len(NULL_TOKENS) and row.data_types["x"] == "object"


def test_warnings_text(spark, folder):
    path = folder({"w.csv": f"{HEADER},note\n" + "1,2,3,4,5,6,bad,8,1,\n" * 2 + "1,,,,5,6,7,8,0,\n"})
    rows, files = readers.read_csv_files(spark, path)
    assert quality.validate_files(rows, files).first().warnings == [
        "Extra columns found (will be ignored): ['note']",
        "Column Volume_m3_per_day_sqr should be numeric but is object",
        "High missing values percentage: 20.00%",
        "Duplicate rows found: 1 (33.33%)",
        "Completely empty columns: ['note']",
    ]


def test_ingest_end_to_end(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    path = folder(
        {
            "a.csv": f"{HEADER}\n" + "1,2,3,4,5,6,7,8,1\n" * 3 + "0,0,0,0,0,0,0,0,0\n,2,3,4,5,6,7,8,\n",
            "b.csv": f"{HEADER}\n1,2,3,4,5,6,7,8,2\n",
            "bad.csv": "",
        }
    )
    rows, files = readers.read_csv_files(spark, path)
    checked = quality.validate_files(rows, files)
    good = relate.only_ok(rows.drop(EXTRA_CELL), checked.where("status = 'error'"))
    cleaned, stats = clean.clean_table(good, files=files)
    named = writers.write_clean(cleaned, f"{out}/clean", "20240101_000000")
    assert {r.output_name for r in named.where("output_bytes > 0").collect()} == {
        "a_preprocessed_20240101_000000",
        "b_preprocessed_20240101_000000",
    }
    points = pts.to_points(cleaned, "sensors", now="2024-01-01 00:00:00")
    stored = writers.write_points(points, f"{out}/points", "r1", batch=1)
    stored = writers.write_points(points, f"{out}/points", "r1", batch=1)  # a repeat replaces the run
    got = {base_name_of(r): (r.points, r.batches) for r in stored.collect()}
    assert got == {"a.csv": (2, 2), "b.csv": (1, 1)}
    stages = relate.join_stages(checked, stats, stored.withColumnRenamed("status", "storage_status"))
    from hazardflow.reports.report import ingest_summary

    row = ingest_summary(stages).first()
    assert (row.files_found, row.files_validated, row.files_stored, row.records) == (3, 2, 2, 3)
    assert row.success_rate == 66.67 and row.data_reduction_pct == 50.0


def test_to_points_picks_time_and_drops_nulls(spark):
    ts = dt.datetime(2024, 1, 1, 1)
    frame = spark.createDataFrame(
        [(1, None, "x", ts, float("nan")), (2, 2.5, None, None, 1.0)],
        "n int, v double, tag string, event_time timestamp, w double",
    )
    first, second = pts.to_points(frame, "m", now="2024-02-02 00:00:00").collect()
    assert (first.fields, first.tags, first.ts) == ({"n": 1.0}, {"tag": "x"}, ts)
    assert (second.fields, second.tags) == ({"n": 2.0, "v": 2.5, "w": 1.0}, {})
    assert second.ts == dt.datetime(2024, 2, 2)
    assert pts.time_column(frame) == "event_time" and pts.time_column(frame.select("n")) is None


def test_points_text(spark):
    frame = spark.createDataFrame([(1, "b", "a")], "n int, z string, y string")
    line = pts.points_text(pts.to_points(frame, "m", now="2024-02-02 00:00:00")).first().value
    assert line == "m,y=a,z=b n=1.0 2024-02-02T00:00:00.000000"


def test_point_reads_are_pruned(spark, tmp_path):
    frame = spark.createDataFrame(
        [("f", float(i), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(96)],
        f"{FILE_KEY} string, v double, ts timestamp",
    )
    writers.write_points(pts.to_points(frame, "m", "ts"), str(tmp_path / "p"), "r1")
    recent = readers.read_points(spark, str(tmp_path / "p"), "m", ["v", "other"], "2024-01-03 12:00:00")
    assert recent.count() == 24
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_prediction_log(spark, tmp_path):
    frame = spark.createDataFrame(
        [(i, 0.5, 1, 0.9, "Intense", 0.7, "v1") for i in range(5)],
        "id int, Duration_days double, prediction int, probability double, risk_level string, confidence double, model_version string",
    )
    path = str(tmp_path / "log")
    for _ in range(2):
        writers.append_predictions(frame, path, "batch", "r1", ts="2024-01-01 05:00:00", order=["id"])
    writers.append_predictions(frame.limit(1), path, "single", "r2", ts="2024-01-01 06:00:00")
    log = readers.read_predictions(spark, path, "2024-01-01 07:00:00")
    assert log.count() == 6
    assert {r.batch_index for r in log.where("prediction_type = 'batch'").collect()} == set("01234")
    assert log.where("prediction_type = 'single' AND batch_index IS NULL").count() == 1


def test_feedback_since(spark, tmp_path):
    rows = [(dt.datetime(2024, 12, 31), b"x", 1, 2, "e"), (dt.datetime(2025, 1, 2), b"y", 1, 1, "e")]
    spark.createDataFrame(rows, "timestamp timestamp, sensor_data binary, predicted_class int, corrected_class int, engineer_id string").write.parquet(str(tmp_path / "f"))
    assert readers.read_feedback(spark, str(tmp_path / "f")).count() == 1


def test_validate_uses_given_copies(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1)], f"{FILE_KEY} string, x int")
    assert quality.validate_files(row_copies(frame), required=["x"], features=["x"]).first().duplicates == 1
