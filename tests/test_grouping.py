"""Positions, splits, folds and lookups, with one group that holds most rows."""

from collections import Counter, defaultdict
from math import ceil

import pytest
from pyspark.sql import functions as F

from hazardflow.operators import numbering, split
from hazardflow.operators.lookup import attach
from hazardflow.operators.numbering import batch_index, position_in_group, write_batch
from hazardflow.session import shared_dir


def check_positions(frame, group, order, out):
    got = {tuple(r[c] for c in frame.columns): r["position"] for r in out.collect()}
    wanted, seen = {}, defaultdict(int)
    for r in sorted(frame.collect(), key=lambda r: [(r[c] is not None, r[c]) for c in order]):
        g = tuple(r[c] for c in group)
        wanted[tuple(r)] = seen[g]
        seen[g] += 1
    assert got == wanted


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_positions_of_a_hot_group_with_a_heavy_value(spark, buckets):
    """Two thirds of the rows are one group, and half of all share one time."""
    frame = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).alias("g"),
        F.when(F.col("id") % 2 == 0, 50).otherwise((F.col("id") * 7919) % 211).alias("t"),
        "id",
    )
    check_positions(frame, ["g"], ["t", "id"], position_in_group(frame, ["g"], ["t", "id"], buckets=buckets))


def test_positions_by_text_and_with_null_group(spark):
    names = ["", "a", "ab", "abcdefgh", "abcdefgz", "b", "é", "z", "zz"]
    frame = spark.createDataFrame([(g, n) for g in (None, "x") for n in names], "g string, n string")
    check_positions(frame, ["g"], ["n"], position_in_group(frame, ["g"], ["n"], buckets=4))


def test_batch_index_and_write_batch(spark):
    frame = spark.range(2500).select(F.lit("f").alias("f"), "id")
    assert batch_index(frame, ["f"], ["id"]).agg(F.max("batch_index")).first()[0] == 2499
    sizes = Counter(r.write_batch for r in write_batch(frame, ["f"], ["id"]).collect())
    assert sizes == {0: 1000, 1: 1000, 2: 500}


def classes_of(spark, counts):
    return spark.createDataFrame([((i,), n) for i, n in enumerate(counts)], "_class struct<value: int>, n long")


@pytest.mark.parametrize("test", [0.1, 0.2, 0.25, 0.5])
@pytest.mark.parametrize("counts", [[1], [1, 2, 3, 4, 990], [7] * 30, [500, 1, 499, 3]])
def test_split_sizes(spark, counts, test):
    rows = split.test_sizes(classes_of(spark, counts), test).collect()
    assert sum(r.test_rows for r in rows) == ceil(round(test * sum(counts), 9))
    for r in rows:
        assert abs(r.test_rows - test * r.n) < 2 and 0 <= r.test_rows <= r.n


@pytest.mark.parametrize("counts, k", [([1], 2), ([5, 1, 9, 2], 3), ([60, 59, 58], 7), ([2, 2, 2, 2], 5)])
def test_fold_sizes(spark, counts, k):
    """The same as dealing the sorted rows in turn."""
    dealt = [[0] * k for _ in counts]
    for row, c in enumerate(c for c, n in enumerate(counts) for _ in range(n)):
        dealt[c][row % k] += 1
    rows = split.fold_sizes(classes_of(spark, counts), k).collect()
    assert [r.fold_rows for r in sorted(rows, key=lambda r: r._class)] == dealt


def test_split_counts_and_stability(spark):
    """Classes of 1 to 4 rows beside a large one."""
    labels = [0] * 1 + [1] * 2 + [2] * 3 + [3] * 4 + [4] * 990
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "id int, c int")
    once = split.stratified_split(frame, "c", "id")
    again = split.stratified_split(frame.repartition(5), "c", "id")
    assert once.count() == len(labels)
    assert once.where("is_test").count() == 200
    assert set(once.where("is_test").collect()) == set(again.where("is_test").collect())
    other = split.stratified_split(frame, "c", "id", seed=7)
    assert set(once.where("is_test").collect()) != set(other.where("is_test").collect())


def test_folds_cover_every_row_once(spark):
    frame = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("c"))
    folds = split.stratified_folds(frame, "c", "id", k=5)
    sizes = Counter(r.fold for r in folds.collect())
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_folds_more_than_rows_of_a_class(spark):
    frame = spark.createDataFrame([(i, 0 if i < 2 else 1) for i in range(12)], "id int, c int")
    folds = split.stratified_folds(frame, "c", "id", k=5)
    assert folds.count() == 12 and {r.fold for r in folds.collect()} == set(range(5))


def test_null_label_rows_are_kept(spark):
    frame = spark.createDataFrame([(i, None if i < 5 else 1) for i in range(20)], "id int, c int")
    out = split.stratified_split(frame, "c", "id")
    assert out.count() == 20 and out.where("is_test IS NULL").count() == 0


def test_many_classes(spark):
    frame = spark.range(20_600).select("id", (F.col("id") % 10_300).alias("c"))
    out = split.stratified_split(frame, "c", "id")
    assert out.count() == 20_600 and out.where("is_test").count() == 4120
    assert out.where("is_test").groupBy("c").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("large", [0, 60, 1_000])
def test_many_classes_are_placed_like_few(spark, large):
    """Ranks of small classes, cuts of large ones: the same parts, with null classes and keys that repeat."""
    frame = spark.range(3000).select(
        F.when(F.col("id") % 13 != 0, F.sqrt("id").cast("int") % 40).alias("c"), (F.col("id") - F.col("id") % 3).alias("k"), F.create_map("id", F.lit("x")).alias("m")
    )

    def halves(classes):
        return split.test_sizes(classes, 0.3).withColumn("_targets", F.array("test_rows"))

    def thirds(classes):
        return split.fold_sizes(classes, 3).withColumn("_targets", F.array(F.col("fold_rows")[0], F.col("fold_rows")[0] + F.col("fold_rows")[1]))

    for parts, cuts in ((halves, 1), (thirds, 2)):
        few = split._by_hash_rank(frame, "c", "k", 1, parts, cuts, "part")
        many = split._by_hash_rank(frame, "c", "k", 1, parts, cuts, "part", many_classes=4, large_class=large)
        assert few.columns == many.columns == ["c", "k", "m", "part"]
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_many_classes_need_no_histogram(spark):
    """A histogram of many small classes is as large as the table, and cuts for each were copied once per salt."""
    frame = spark.range(15_000).select((F.col("id") % 5000).alias("c"), "id")
    out = split.stratified_split(frame, "c", "id")
    folder = shared_dir(spark)
    assert out.groupBy("is_test").count().where("is_test").first()["count"] == 3000
    read = [f for f in out.inputFiles()]
    assert read and not any("/cuts-" in f for f in read) and folder in read[0].replace("file://", "")


def test_positions_by_names_with_a_common_start(spark):
    frame = spark.range(20_000).select(F.format_string("sensor-%010d", F.col("id") * 7919 % 20_000).alias("n"), F.lit(None).cast("string").alias("z"))
    out = position_in_group(frame, [], ["z", "n"], buckets=16)
    assert out.where("position <> cast(substring(n, 8) as long)").count() == 0
    sizes = [r["count"] for r in numbering._ranged(frame, [], ["z", "n"], 16).groupBy("_part").count().collect()]
    assert max(sizes) < 2 * 20_000 / 16


def test_attach_with_maps_and_dots(spark):
    frame = spark.createDataFrame([(1, {"a": 1}, 2.0), (2, {}, 3.0)], "k int, m map<string, int>, `t.max` double")
    stats = spark.createDataFrame([(1, {"x": "y"}, 5)], "k int, s map<string, string>, `v.w` int")
    for limit in (0, 1 << 20):
        rows = {r["k"]: (r["t.max"], r["v.w"]) for r in attach(frame, stats, ["k"], limit=limit, salts=3).collect()}
        assert rows == {1: (2.0, 5), 2: (3.0, None)}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_attach_keeps_every_row(spark, limit):
    """limit=0 takes the salted path. NULL keys meet NULL keys, lone keys get NULL."""
    frame = spark.createDataFrame([(None, 1), ("hot", 2), ("hot", 3), ("hot", 3), ("lone", 4)], "g string, x int")
    stats = spark.createDataFrame([(None, 10), ("hot", 20)], "g string, s int")
    out = attach(frame, stats, ["g"], limit=limit, salts=4)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(None, 1, 10), ("hot", 2, 20), ("hot", 3, 20), ("hot", 3, 20), ("lone", 4, None)], key=str
    )
