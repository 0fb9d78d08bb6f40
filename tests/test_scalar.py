import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardflow.functions import scalar
from hazardflow.schema import CLASS_NAMES, NULL_TOKENS


def apply(spark, values, kind, expr):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_risk_level_borders(spark):
    values = [0.0, 0.3999, 0.40, 0.55, 0.75, 1.0, None]
    assert apply(spark, values, "double", scalar.risk_level) == [
        "Low", "Low", "Medium", "High", "Intense", "Intense", None,
    ]


def test_confidence(spark):
    assert apply(spark, [0.0, 0.5, 1.0], "double", scalar.confidence) == pytest.approx([0.95, 0.0, 0.95])
    assert apply(spark, [1.0], "double", lambda c: scalar.confidence(c, 1.2)) == [1.0]


def test_cut_is_closed_on_the_right(spark):
    values = [0.4, 0.4000001, 0.7, 0.71, float("-inf"), float("inf"), None, float("nan")]
    assert apply(spark, values, "double", lambda c: scalar.cut(c, [0.4, 0.7], [0, 1, 2])) == [
        0, 1, 1, 2, 0, 2, None, None,
    ]


def test_null_tokens(spark):
    kept = ["0", "na", "Null", " NA", "none"]
    out = apply(spark, NULL_TOKENS + kept, "string", scalar.null_if_token)
    assert out == [None] * len(NULL_TOKENS) + kept


def test_as_number(spark):
    texts = ["1", " 2.5 ", "1e3", ".5", "-inf", "Infinity", "1d", "2f", "0x10", "1,000", "abc", "", None]
    out = apply(spark, texts, "string", scalar.as_number)
    inf = float("inf")
    assert out == [1.0, 2.5, 1000.0, 0.5, -inf, inf, None, None, None, None, None, None, None]


def test_names(spark):
    assert apply(spark, ["a.csv", "b.c.CSV", "plain", ".hidden"], "string", scalar.file_stem) == [
        "a", "b.c", "plain", ".hidden",
    ]
    assert apply(spark, ["/x/y/in.csv"], "string", lambda c: scalar.output_name(c, F.lit("20240101_000000"))) == [
        "in_preprocessed_20240101_000000"
    ]
    assert apply(spark, ["Critical", "Intense", "Odd"], "string", scalar.risk_text) == [
        "INTENSE RISK", "INTENSE RISK", "ODD RISK",
    ]
    assert apply(spark, [0, 3, 9, None], "int", lambda c: scalar.class_name(c, CLASS_NAMES)) == [
        "None", "High", None, None,
    ]


def test_times(spark):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    assert apply(spark, [ts], "timestamp_ntz", scalar.clock) == ["03:04"]
    assert apply(spark, [ts], "timestamp_ntz", scalar.stamp) == ["20240102_030405"]
    assert apply(spark, [ts], "timestamp_ntz", scalar.iso) == ["2024-01-02T03:04:05.000678"]


def test_threshold_and_coercion(spark):
    assert apply(spark, [0.69, 0.7, None], "double", scalar.over_threshold) == [False, True, None]
    assert apply(spark, ["1", "x"], "string", lambda c: scalar.coerce(c, "int")) == [1, None]
