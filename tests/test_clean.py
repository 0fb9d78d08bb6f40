import pytest

from hazardflow.operators import clean, profile
from hazardflow.operators.profile import range_check
from hazardflow.schema import BOUNDS, FEATURES, REQUIRED

NAN, INF = float("nan"), float("inf")


def test_clean_table_order_and_counts(spark):
    """Dedupe, then median and mode, then dead rows; a zero row with a NULL is filled first."""
    rows = [
        ("a", 1.0, 1.0, 1), ("a", 1.0, 1.0, 1), ("a", 1.0, 1.0, 1),
        ("a", 0.0, 0.0, 2), ("a", 0.0, None, 2), ("a", 5.0, NAN, None), ("a", 4.0, 8.0, 1),
        ("b", 1.0, 1.0, 1),
        ("c", None, 0.0, None), ("c", None, 0.0, None),
    ]
    frame = spark.createDataFrame(rows, "_file string, x double, y double, t int")
    cleaned, stats = clean.clean_table(frame, ["x", "y"], "t")
    got = sorted(map(tuple, cleaned.collect()), key=str)
    assert got == sorted(
        [("a", 1.0, 1.0, 1), ("a", 0.0, 1.0, 2), ("a", 5.0, 1.0, 1), ("a", 4.0, 8.0, 1), ("b", 1.0, 1.0, 1), ("c", None, 0.0, 0)],
        key=str,
    )
    by_file = {r._file: r.asDict() for r in stats.collect()}
    assert by_file["a"] == {
        "_file": "a", "rows_before": 7, "rows_after": 4, "duplicates_removed": 2, "zero_rows_removed": 1,
        "missing_before": 3, "missing_after": 0, "rows_removed": 3,
    }
    assert by_file["c"]["missing_before"] == 4 and by_file["c"]["missing_after"] == 1
    assert dict(cleaned.dtypes) == {"_file": "string", "x": "float", "y": "float", "t": "int"}


def test_a_column_a_file_lacks_is_not_missing_and_not_alive(spark):
    rows = [("a", "0", None, "1"), ("a", "2", None, "1"), ("b", "0", "3", "1")]
    frame = spark.createDataFrame(rows, "_file string, x string, y string, t string")
    files = spark.createDataFrame([("a", ["x", "t"]), ("b", ["x", "y", "t"])], "_file string, columns array<string>")
    cleaned, stats = clean.clean_table(frame, ["x", "y"], "t", files=files)
    assert sorted(map(tuple, cleaned.collect()), key=str) == [("a", 2.0, None, 1), ("b", 0.0, 3.0, 1)]
    assert {r._file: (r.missing_before, r.zero_rows_removed) for r in stats.collect()} == {"a": (0, 1), "b": (0, 0)}


def test_dedupe_keeps_equal_rows_of_two_files(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", NAN), ("b", NAN), ("b", None), ("b", None)], "_file string, x double")
    assert clean.dedupe(frame).count() == 4


def test_drop_all_zero(spark):
    frame = spark.createDataFrame([(0.0, 0.0), (0.0, None), (-0.0, 0.0), (0.0, 1.0)], "x double, y double")
    assert clean.drop_all_zero(frame, ["x", "y"]).count() == 2
    assert clean.drop_all_zero(frame, []).count() == 4


def test_impute(spark):
    frame = spark.createDataFrame([("a", 1.0, "u"), ("a", None, None), ("a", 3.0, "v"), ("b", None, None)], "_file string, x double, m string")
    out = clean.impute_mode(clean.impute_median(frame, ["x"]), "m", "none")
    assert sorted(map(tuple, out.collect()), key=str) == [
        ("a", 1.0, "u"), ("a", 2.0, "u"), ("a", 3.0, "v"), ("b", None, "none"),
    ]


def test_narrow(spark):
    frame = spark.createDataFrame([("1.5", "2", 1e12), ("x", "3.9", 5.0)], "f string, i string, big double")
    out = clean.narrow(frame, ["f"], ["i", "big"])
    assert list(map(tuple, out.collect())) == [(1.5, 2, None), (None, 3, 5)]


def test_clean_summary(spark):
    stats = spark.createDataFrame([(80, 60, 20, "ok"), (20, 20, 0, "ok"), (None, None, None, "error")], "rows_before int, rows_after int, rows_removed int, status string")
    row = clean.clean_summary(stats).first()
    assert (row.total_original_rows, row.total_final_rows, row.data_reduction_pct, row.files_with_errors) == (100, 80, 20.0, 1)
    assert clean.clean_summary(stats.limit(0)).first().data_reduction_pct == 0.0


def test_profile_metrics(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, "1", None), ("a", INF, "2", None), ("a", NAN, "x", None), ("a", None, None, None)],
        "_file string, d double, s string, e string",
    )
    got = {r.column: r for r in profile.profile(frame).collect()}
    assert (got["d"].missing, got["d"].infinite, got["d"].data_type) == (2, 1, "float64")
    assert (got["s"].missing, got["s"].data_type, got["s"].numeric) == (1, "object", False)
    assert (got["e"].empty, got["e"].data_type) == (True, "float64")


@pytest.mark.parametrize(
    "texts, kind",
    [(["1", "2"], "int64"), (["1", None], "float64"), (["1", "2.5"], "float64"), (["True", "false"], "bool"),
     (["inf", "1"], "float64"), (["1d"], "object"), (["a"], "object")],
)
def test_inferred_types(spark, texts, kind):
    frame = spark.createDataFrame([("f", t) for t in texts], "_file string, x string")
    assert profile.profile(frame).first().data_type == kind


def test_duplicate_rows_with_null_and_nan(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", None), ("a", None), ("a", NAN), ("a", NAN)], "_file string, x double")
    row = profile.duplicate_rows(frame).first()
    assert (row.rows, row.duplicates, row.duplicate_pct) == (7, 4, 57.14)


def test_range_check_borders_and_nulls(spark):
    low = tuple(lo for lo, _ in BOUNDS.values())
    high = tuple(hi for _, hi in BOUNDS.values())
    bad = (0.09,) + low[1:7] + (None,)
    frame = spark.createDataFrame([low, high, bad, (NAN,) + low[1:]], ", ".join(f"{c} double" for c in FEATURES))
    out = range_check(frame).collect()
    assert [r.valid for r in out] == [True, True, False, False]
    assert out[2].violations == ["Duration_days", "Energy_per_Volume_log"]


def test_describe_and_range(spark):
    frame = spark.createDataFrame([(1.0, 5), (2.0, 6), (4.0, None)], "x double, n int")
    got = {r.column: r for r in profile.describe(frame, ["x", "n"]).collect()}
    assert (got["x"].q25, got["x"].q50, got["x"].q75) == (1.5, 2.0, 3.0)
    assert (got["n"]["count"], got["n"].q50) == (2, 5.5)
    row = profile.global_range(frame, ["x", "n"]).first()
    assert (row.low, row.high) == (1.0, 6.0)


def test_available(spark):
    frame = spark.createDataFrame([(1, 2)], "Duration_days int, extra int")
    assert clean.available(frame, REQUIRED) == ["Duration_days"]
