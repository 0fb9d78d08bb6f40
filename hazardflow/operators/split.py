"""Stratified splits and folds with exact class counts."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardflow.operators.lookup import attach_written
from hazardflow.operators.numbering import position_in_group, running_total
from hazardflow.session import written

# Beyond so many classes a histogram per class is no smaller than the table; a class of more rows than the second
# is never sorted in one task.
MANY_CLASSES = 4096
LARGE_CLASS = 1_000_000


def test_sizes(classes: DataFrame, test: float) -> DataFrame:
    """Add `test_rows` to a table of classes (_class, n): ceil(test x all) in all, shared by largest remainder."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    train = total - ceil(Fraction(str(test)) * total)
    whole = F.expr(f"cast(n as decimal(19, 0)) * cast({train} as decimal(19, 0))")
    size = F.lit(max(total, 1)).cast("decimal(19, 0)")
    shares = classes.withColumns({"_rest": whole % size, "_kept": F.floor((whole - whole % size) / size).cast("bigint")})
    shares = written(shares.withColumn("_less", -F.col("_rest")), "shares")
    more = train - (shares.agg(F.sum("_kept")).first()[0] or 0)
    placed = position_in_group(shares, [], ["_less", "_class"], "_turn")
    kept = F.col("_kept") + (F.col("_turn") < more).cast("bigint")
    return placed.select("_class", "n", (F.col("n") - kept).alias("test_rows"))


def fold_sizes(classes: DataFrame, k: int) -> DataFrame:
    """Add `fold_rows` (k numbers) to a table of classes: the rows, sorted by class, are dealt in turn."""
    placed = running_total(classes, [], ["_class"], F.col("n"), "_end")

    def dealt(stop: Column, fold: int) -> Column:
        """Rows of the fold among the first `stop`."""
        return F.floor((stop - 1 - fold - F.pmod(stop - 1 - fold, F.lit(k))) / k).cast("bigint") + 1

    end = F.col("_end")
    return placed.select("_class", "n", F.array(*[dealt(end, i) - dealt(end - F.col("n"), i) for i in range(k)]).alias("fold_rows"))


def _hashed(frame: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    return frame.select(
        F.struct(F.col(label).alias("value")).alias("_class"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("hash"),
        F.col(key).alias("key"),
    ).withColumn("bucket", F.shiftright("hash", 48))


def _by_hash_rank(
    frame: DataFrame,
    label: str,
    key: str,
    seed: int,
    parts: Callable[[DataFrame], DataFrame],
    cuts: int,
    name: str,
    many_classes: int = MANY_CLASSES,
    large_class: int = LARGE_CLASS,
) -> DataFrame:
    """Number the parts of each class, taken in the order of a seeded hash.

    Classes are counted first. `parts` gives _class and `_targets`, the ranks of the
    last rows of all parts but the final one. Few classes are placed by cuts, without
    a shuffle of the table. Of many classes only the large ones are; the rest of the
    table is shuffled once by class and ranked there. Both ways give equal parts. The
    frame is read several times: give a table, not a long plan. The number of classes
    is not bounded.
    """
    one = F.struct(F.col(label).alias("value")).alias("_class")
    classes = written(frame.groupBy(one).agg(F.count("*").alias("n")), "classes")
    targets = written(parts(classes).select("_class", "n", "_targets"), "targets")
    if targets.count() <= many_classes:
        return _placed_by_cuts(frame, label, key, seed, targets, cuts, name)
    ranked = _placed_by_rank(frame, label, key, seed, targets.where(F.col("n") <= large_class), name)
    large = written(targets.where(F.col("n") > large_class), "large")  # at most one per large_class rows
    if large.isEmpty():
        return ranked
    rows = frame.withColumn("_class", one).join(F.broadcast(large.select("_class")), "_class", "left_semi").select(*frame.columns)
    return ranked.unionByName(_placed_by_cuts(rows, label, key, seed, large, cuts, name))


def _placed_by_rank(frame: DataFrame, label: str, key: str, seed: int, targets: DataFrame, name: str) -> DataFrame:
    """The rows of the classes of `targets`, each class ranked by hash in one task."""
    rows = frame.withColumn("_class", F.struct(F.col(label).alias("value"))).drop(label).join(targets.select("_class", "_targets"), "_class")
    own = F.col("_class.value" if key == label else key)
    order = W.partitionBy("_class").orderBy(F.xxhash64(F.lit(seed), own), own)
    ranked = rows.withColumn("_rank", F.rank().over(order))  # rows that share a key share the rank
    part = F.size(F.filter("_targets", lambda t: t < F.col("_rank"))).alias(name)
    return ranked.withColumn(label, F.col("_class.value")).select(*frame.columns, part)


def _placed_by_cuts(frame: DataFrame, label: str, key: str, seed: int, targets: DataFrame, cuts: int, name: str) -> DataFrame:
    """The rows of the classes of `targets`, placed by comparing their hash with the cuts of their class.

    A histogram of the hash per class gives the bucket that holds each cut. Only the
    rows of those buckets are sorted. Small tables are broadcast by their size.
    """
    hashed = _hashed(frame, label, key, seed)
    histogram = written(hashed.groupBy("_class", "bucket").agg(F.count("*").alias("n")), "histogram")
    wanted = targets.select("_class", F.posexplode("_targets").alias("part", "target"))
    running = W.partitionBy("_class").orderBy("bucket")
    reached = F.sum("n").over(running.rowsBetween(W.unboundedPreceding, W.currentRow))
    located = written(
        histogram.withColumn("end", reached)
        .withColumn("start", F.col("end") - F.col("n"))
        .join(wanted, "_class")
        .where((F.col("target") > F.col("start")) & (F.col("target") <= F.col("end")))
        .select("_class", "part", "bucket", (F.col("target") - F.col("start")).alias("rank")),
        "located",
    )
    in_bucket = W.partitionBy("_class", "bucket").orderBy("hash", "key")
    last = (
        hashed.join(located.select("_class", "bucket").distinct(), ["_class", "bucket"], "left_semi")
        .withColumn("rank", F.row_number().over(in_bucket).cast("bigint"))
        .join(located, ["_class", "bucket", "rank"])
        .groupBy("_class")
        .agg(F.collect_list(F.struct("hash", "key")).alias("_cuts"))
    )
    none = F.size(F.filter("_targets", lambda t: t == 0))
    table = written(targets.select("_class", none.alias("_empty")).join(last, "_class", "left"), "cuts")
    own = F.struct(F.xxhash64(F.lit(seed), F.col(key)).alias("hash"), F.col(key).alias("key"))
    placed = attach_written(frame.withColumn("_class", F.struct(F.col(label).alias("value"))), table, ["_class"])
    passed = sum((F.coalesce((F.get("_cuts", F.lit(i)) < own).cast("int"), F.lit(0)) for i in range(cuts)), F.lit(0))
    return placed.withColumn(name, (F.col("_empty") + passed).cast("int")).drop("_class", "_cuts", "_empty")


def stratified_split(
    frame: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Add a boolean column: the row is in the test part.

    `key` must identify a row; rows that share a key stay on one side.
    """

    def parts(classes: DataFrame) -> DataFrame:
        return test_sizes(classes, test).withColumn("_targets", F.array("test_rows"))

    placed = _by_hash_rank(frame, label, key, seed, parts, 1, "_part")
    return placed.withColumn(name, F.col("_part") == 0).drop("_part")


def stratified_folds(
    frame: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add the fold number 0..k-1, balanced within every class and overall."""

    def parts(classes: DataFrame) -> DataFrame:
        sums = [sum((F.get("fold_rows", F.lit(j)) for j in range(1, i + 1)), F.get("fold_rows", F.lit(0))) for i in range(k - 1)]
        return fold_sizes(classes, k).withColumn("_targets", F.array(*sums).cast("array<bigint>"))

    return _by_hash_rank(frame, label, key, seed, parts, k - 1, name)
