import datetime as dt

from hazardflow.streaming import late, streams

SCHEMA = "id int, k string, ts timestamp"


def at(hour):
    return None if hour is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    arrivals = [
        [(1, "a", 10), (2, "a", 2), (3, None, 5), (4, "b", None)],
        [(5, "a", 8), (6, "a", 9), (7, None, 3), (8, "b", 1), (9, "a", 20), (10, "new", 0)],
        [(11, "a", 18), (12, "a", 19), (13, "b", None), (14, "a", 9)],
    ]
    for i, rows in enumerate(arrivals):
        frame = spark.createDataFrame([(n, k, at(h)) for n, k, h in rows], SCHEMA)
        frame.write.parquet(str(tmp_path / f"in/arrival={i}"))
        stream = streams.ingest_stream(spark, str(tmp_path / "in/*"), frame.schema)
        late.split_late(stream, ["k"], str(tmp_path / "out"), str(tmp_path / "checkpoint"), "1 HOUR").awaitTermination()
    found = {(r.id, r.batch): r.limit for r in spark.read.parquet(str(tmp_path / "out/late")).collect()}
    assert found == {(5, 1): at(9), (7, 1): at(4), (11, 2): at(19), (14, 2): at(19)}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [1, 2, 3, 4, 6, 8, 9, 10, 12, 13]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(1))], SCHEMA)
    frame.write.parquet(str(tmp_path / "in/arrival=0"))
    for checkpoint in ("c1", "c2"):  # a lost checkpoint runs batch 0 again
        stream = streams.ingest_stream(spark, str(tmp_path / "in/*"), frame.schema)
        late.split_late(stream, ["k"], str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/late")).count() == 0
