import hashlib

import pytest
from pyspark.sql import functions as F

from hazardflow.models import forest_table, train
from hazardflow.plans.views import sensor
from hazardflow.schema import FEATURES, TARGET
from hazardflow.session import scratch_path, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return written(sensor(spark, SF), "sensor")


@pytest.fixture(scope="module")
def saved(spark, rows):
    model = train.pipeline("forest", weight="weight", numTrees=7, maxDepth=6).fit(train.add_class_weights(rows))
    folder = scratch_path(spark, "model")
    train.save_model(model, folder, "2024-02-01")
    return model, spark.read.parquet(f"{folder}/nodes")


def test_saved_nodes_walk_like_the_model(rows, saved):
    model, nodes = saved
    own = model.transform(rows).select("sensor_id", F.col("prediction").cast("int").alias("a"), "probability")
    walked = forest_table.scored(nodes, forest_table.scaled(model, rows), "sensor_id", x=F.col("x"))
    both = own.join(walked.select("sensor_id", "prediction", F.col("votes")), "sensor_id").collect()
    assert len(both) == rows.count()
    for r in both:
        assert r.a == r.prediction
        assert [v / sum(r.votes) for v in r.votes] == pytest.approx(list(r.probability), abs=1e-8)


def test_saved_nodes_have_the_importances(saved):
    model, nodes = saved
    got = {r.feature: r.importance for r in forest_table.importances(nodes).collect()}
    want = {r.feature: r.importance for r in train.importances(model).collect()}
    assert got == pytest.approx(want)


def test_grown_forest_is_good_and_the_same_each_time(rows):
    held = F.pmod(F.xxhash64("sensor_id"), F.lit(5)) == 0
    nodes = forest_table.grow(rows.where(~held), "sensor_id", trees=15, depth=6)
    again = forest_table.grow(rows.where(~held).repartition(3), "sensor_id", trees=15, depth=6)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, again.collect()))
    test = rows.where(held)
    judged = forest_table.scored(nodes, test, "sensor_id").join(test.select("sensor_id", TARGET), "sensor_id")
    assert judged.agg(F.avg((F.col("prediction") == F.col(TARGET)).cast("double"))).first()[0] > 0.7
    leaves = nodes.where("feature IS NULL")
    assert nodes.where("feature IS NOT NULL AND left = 2 * node AND cut IS NOT NULL").count() + leaves.count() == nodes.count()
    assert nodes.groupBy("tree").agg((F.count("feature") * 2 + 1 == F.count("*")).alias("whole")).where("NOT whole").count() == 0


def test_rows_without_a_feature_keep_their_place(rows, saved):
    model, nodes = saved
    gaps = rows.withColumn("Duration_days", F.when(F.col("user_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("Duration_days")))
    got = forest_table.scored(nodes, forest_table.scaled(model, gaps), "sensor_id", x=F.col("x"))
    assert got.count() == rows.count()
    assert got.where("prediction IS NULL").count() == gaps.where("user_id % 2 = 0").count() == got.where("risk_level IS NULL").count()


def test_odd_tables(spark, rows):
    assert forest_table.grow(rows.limit(0), "sensor_id", trees=2, depth=2).count() == 0
    one = forest_table.grow(rows.withColumn(TARGET, F.lit(1)), "sensor_id", trees=3, depth=4)
    assert one.count() == 3 and one.where("feature IS NULL AND votes[0] = 0 AND votes[1] > 0").count() == 3
    alike = rows.withColumns({f: F.lit(1.0) for f in FEATURES})
    assert forest_table.grow(alike, "sensor_id", trees=2, depth=4).where("feature IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        forest_table.grow(rows.withColumn(TARGET, F.lit(None).cast("int")), "sensor_id", trees=1)


def test_draws_are_those_of_the_digits_and_made_once(spark):
    """An MD5 inside the comparing lambda was made once per limit."""
    keys = spark.range(300).select(F.concat(F.lit("k-"), F.col("id").cast("string")).alias("key"))
    drawn = keys.select("key", forest_table._draws(F.col("key"), 7, 42).alias("draws"))
    for r in drawn.collect():
        numbers = [int(hashlib.md5(f"42/{tree}/{r.key}".encode()).hexdigest()[:8], 16) for tree in range(7)]
        assert r.draws == [sum(limit <= n for limit in forest_table.drawn_limits()) for n in numbers]
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "filter(" not in plan


def test_bins_count_the_cuts_below(spark):
    cuts = {"x": [-1.0, 0.0, 0.5, 2.0, 9.0], "y": []}
    values = [None, float("nan"), float("-inf"), float("inf"), -1.0, -0.0, 0.4, 0.5, 0.6, 9.0, 9.1]
    rows = spark.createDataFrame([(v, 1.0) for v in values], "x double, y double")
    got = [r[0] for r in rows.select(forest_table._bins(cuts, ["x", "y"])).collect()]
    assert got == [[0 if v is None else 5 if v != v else sum(c < v for c in cuts["x"]), 0] for v in values]


def test_nodes_are_found_by_number_or_by_struct(spark):
    at = spark.range(200).select((F.col("id") % 5).cast("int").alias("tree"), (F.col("id") % 8).alias("node"), "id")
    table = written(spark.range(20).select((F.col("id") % 4).cast("int").alias("tree"), (F.col("id") % 5).alias("node"), F.col("id").alias("place")).distinct(), "nodes")
    narrow, wide = (forest_table._at_nodes(at, table, bits) for bits in (3, 40))
    assert narrow.columns == wide.columns == ["tree", "node", "id", "place"]
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan
