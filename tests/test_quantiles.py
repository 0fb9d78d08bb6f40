import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow.operators import quantiles
from hazardflow.operators.quantiles import exact_mode, exact_quantiles, medians


def rows_of(spark, data):
    return spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "g string, x double")


@pytest.mark.parametrize("small_group, held_values, one_task",
    [(100_000, 10**6, 10**6), (100_000, 0, 10**6), (100_000, 0, 0), (5, 0, 10**6), (5, 0, 0)],
)
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_numpy(spark, seed, small_group, held_values, one_task):
    """held_values=0 takes the brackets, small_group=5 the sketch, one_task=0 the bins."""
    rng = np.random.default_rng(seed)
    data = {
        "even": list(rng.normal(size=400)),
        "odd": list(rng.normal(size=401)),
        "heavy": [7.0] * 300 + list(rng.uniform(0, 10, size=150)),
        "few": [3.0, 1.0],
        "one": [5.0],
    }
    fractions = [0.1, 0.25, 0.5, 0.9]
    out = exact_quantiles(rows_of(spark, data), ["x"], fractions, ["g"], 200, small_group, held_values, one_task)
    got = {(r.g, r.fraction): r.value for r in out.collect()}
    for g, values in data.items():
        if small_group == 5 and len(values) <= 5:
            continue
        for f in fractions:
            assert got[g, f] == pytest.approx(np.quantile(values, f))


@pytest.mark.parametrize("held_values", [0, 10**6])
def test_null_nan_and_empty_columns(spark, held_values):
    frame = spark.createDataFrame(
        [("a", 1.0, None), ("a", float("nan"), None), ("a", 4.0, None), ("b", None, 2.0)], "g string, x double, y double"
    )
    got = {r.g: (r.x, r.y) for r in medians(frame, ["x", "y"], ["g"], held_values=held_values).collect()}
    assert got == {"a": (2.5, None), "b": (None, 2.0)}


def test_null_key_is_a_group(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 9.0)], "g string, x double")
    assert {r.g: r.x for r in medians(frame, ["x"], ["g"]).collect()} == {None: 2.0, "a": 9.0}


def test_whole_table(spark):
    frame = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert medians(frame, ["x"]).first().x == 500.0


def test_mode_ties_take_the_smallest_and_nulls_do_not_vote(spark):
    frame = spark.createDataFrame(
        [("a", 2), ("a", 2), ("a", 1), ("a", 1), ("a", None), ("a", None), ("a", None), ("b", None)], "g string, x int"
    )
    assert {r.g: r.x for r in exact_mode(frame, "x", ["g"]).collect()} == {"a": 1, "b": None}


@pytest.mark.parametrize("options", [{}, {"held_values": 0}, {"held_values": 0, "one_task": 0}, {"held_values": 0, "small_group": 0}, {"held_values": 0, "small_group": 0, "one_task": 0}])
def test_infinite_ends(spark, options):
    inf = float("inf")
    data = {"low": [-inf, -inf, 1, 2], "high": [1, 2, inf, inf], "all": [inf] * 3, "mid": [-inf, 1, 3, inf]}
    got = {r.g: r.x for r in medians(rows_of(spark, data), ["x"], ["g"], **options).collect()}
    assert got == {"low": -inf, "high": inf, "all": inf, "mid": 2.0}


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    """Brackets that hold nothing: the second round finds every rank."""
    whole = quantiles._brackets

    def wrong(numbers, columns, fractions, key, accuracy, small_group):
        out = whole(numbers, columns, fractions, key, accuracy, small_group)
        if small_group is None:
            return out
        far = F.transform("_brackets", lambda b: F.struct(b["n"].alias("n"), F.transform(b["lo"], lambda x: x - 1e6).alias("lo"), F.transform(b["hi"], lambda x: x - 1e6).alias("hi")))
        return out.withColumn("_brackets", far)

    monkeypatch.setattr(quantiles, "_brackets", wrong)
    frame = rows_of(spark, {"a": list(range(101)), "b": [1, 2]})
    got = {r.g: r.x for r in medians(frame, ["x"], ["g"], held_values=0).collect()}
    assert got == {"a": 50.0, "b": 1.5}
