import pytest
import time
import datetime as dt

from pyspark.sql import functions as F

from hazardflow.streaming import streams

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, user string, value double, probability double, risk_level string"


def rows_at(*entries):
    """(id, minutes) entries as scored rows."""
    return [(i, DAY + dt.timedelta(minutes=m), "u", float(i), 0.8, "High") for i, m in entries]


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def source(spark, folder, schema=SCHEMA):
    return streams.ingest_stream(spark, f"{folder}/*", spark.createDataFrame([], schema).schema)


def run(frame, folder):
    query = streams.run_to_table(frame, f"{folder}/table", f"{folder}/checkpoint")
    query.awaitTermination()
    return query


def test_only_new_files_are_read(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, inbox, 1, rows_at((1, 0)))
    run(source(spark, inbox), out)
    put(spark, inbox, 2, rows_at((2, 1)))
    run(source(spark, inbox), out)
    run(source(spark, inbox), out)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/table").collect()) == [1, 2]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    windows = lambda: streams.risk_windows(source(spark, inbox), "10 minutes", late="10 minutes")
    put(spark, inbox, 1, rows_at((1, 1), (2, 2), (3, 60)))
    run(windows(), out)
    put(spark, inbox, 2, rows_at((4, 3), (5, 61), (6, 100)))
    late = streams.LateRows()
    spark.streams.addListener(late)
    try:
        query = run(windows(), out)
        for _ in range(100):
            if late.of(query):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    assert late.of(query) >= 1
    got = {(r.window_start - DAY).seconds // 60: r.predictions for r in spark.read.parquet(f"{out}/table").collect()}
    assert got == {0: 2, 60: 2}


def test_duplicates_inside_and_outside_the_watermark(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    unique = lambda: streams.dedupe_stream(source(spark, inbox), ["id"], "10 minutes")
    put(spark, inbox, 1, rows_at((1, 0), (1, 5), (2, 90)))
    run(unique(), out)
    put(spark, inbox, 2, rows_at((1, 95), (2, 91)))
    run(unique(), out)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/table").collect()) == [1, 1, 2]


def test_windows_of_each_shape_match_batch(spark, tmp_path):
    inbox = str(tmp_path / "in")
    put(spark, inbox, 1, rows_at((1, 0), (2, 4), (3, 12), (4, 40), (5, 200)))
    for name, shape in {
        "tumbling": {"size": "10 minutes"},
        "sliding": {"size": "10 minutes", "slide": "5 minutes"},
        "session": {"gap": "10 minutes"},
    }.items():
        out = str(tmp_path / name)
        run(streams.sensor_windows(source(spark, inbox), "user", "value", late="1 minute", **shape), out)
        closed = F.lit(DAY + dt.timedelta(minutes=199)).cast("timestamp")
        batch = streams.sensor_windows(spark.read.schema(SCHEMA).parquet(f"{inbox}/1"), "user", "value", **shape)
        wanted = sorted(map(tuple, batch.where(F.col("window_end") <= closed).collect()))
        assert sorted(map(tuple, spark.read.parquet(f"{out}/table").collect())) == wanted and wanted


def test_quarantine(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, inbox, 1, rows_at((1, 0), (50, 1)))
    streams.validate_stream(source(spark, inbox), f"{out}/good", f"{out}/bad", f"{out}/c", {"value": (0, 10)}).awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{out}/good").collect()] == [1]
    assert [(r.id, r.violations) for r in spark.read.parquet(f"{out}/bad").collect()] == [(50, ["value"])]


def test_alerts(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, inbox, 1, rows_at((1, 0)) + [(2, DAY, "u", 1.0, 0.69, "High")])
    streams.alerts(source(spark, inbox), 0.7, f"{out}/t", f"{out}/c").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{out}/t").collect()] == [1]


@pytest.mark.parametrize("batches", [1, 3])
def test_quality_alerts(spark, tmp_path, batches):
    """The same alerts for one and for several micro-batches; the second day has no fault."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    next_day = DAY + dt.timedelta(days=1)
    rows = rows_at((1, 0)) * 2 + [(2, DAY, None, None, 0.1, "Low"), (3, next_day, 1, 1.0, 0.1, "Low"), (4, next_day + dt.timedelta(days=2), 1, 1.0, 0.1, "Low")]
    for i in range(batches):
        put(spark, inbox, i, rows[i * len(rows) // batches : (i + 1) * len(rows) // batches])
        streams.quality_alerts(source(spark, inbox), ["id", "user", "value"], f"{out}/t", f"{out}/c").awaitTermination()
    found = spark.read.parquet(f"{out}/t").collect()
    assert [(r.rows, r.duplicates, r.missing_pct) for r in found] == [(3, 1, 22.22)]
