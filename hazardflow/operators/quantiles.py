"""Exact quantiles and modes without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardflow.functions.scalar import no_nan
from hazardflow.operators.lookup import attach_written
from hazardflow.session import written

ACCURACY = 50_000
# Groups up to the first size are bracketed by least and greatest value, groups
# up to the second by a wide bracket, others by one as narrow as the sketch allows.
SMALL_GROUP = 2_000
MIDDLE_GROUP = 1_000_000
WIDE = 0.002
ONE_TASK = 5_000_000
BINS = 4096
HELD_VALUES = 10_000_000
# Spark sorts instead of hashing once an aggregate of objects has this many groups open.
OPEN_GROUPS = 128
RESERVED = {"column", "fraction", "item", "n", "value", "zone", "copies", "seen", "bin", "start", "end"}


def exact_quantiles(
    frame: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    key: Sequence[str] = (),
    accuracy: int = ACCURACY,
    small_group: int = SMALL_GROUP,
    held_values: int = HELD_VALUES,
    one_task: int = ONE_TASK,
) -> DataFrame:
    """Linearly interpolated quantiles as (key.., column, fraction, n, value).

    Groups are counted first. If the values that one task can have open at a
    time are at most `held_values`, a plain aggregate holds them. Else a
    mergeable sketch brackets each quantile; a second scan counts the values
    outside the brackets and sorts only the few inside them. The result is
    exact: if a rank lies outside its bracket, the scan is repeated with the
    whole range as bracket. All ways give equal values. Where a bracket may hold more than `one_task` values, it is cut into
    bins first and only the bins with a wanted rank are sorted. The frame is read
    up to three times: give a table, not a long plan.
    """
    key, columns, fractions = list(key), list(columns), sorted(fractions)
    if taken := RESERVED & set(key):
        raise ValueError(f"key columns may not be named {sorted(taken)}")
    numbers = frame.select(*key, *[no_nan(F.col(c).cast("double")).alias(c) for c in columns])
    counts = [F.count(c) for c in columns]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    size = numbers.groupBy(*key).agg(most.alias("n")).agg(F.max("n").alias("largest"), F.count("*").alias("groups")).first()
    largest = size.largest or 0
    if largest * min(size.groups, OPEN_GROUPS) * len(columns) <= held_values:
        return _held(numbers, columns, fractions, key)
    bounds = written(_brackets(numbers, columns, fractions, key, accuracy, small_group), "brackets")
    group = key + ["item", "n"]
    ranks = [(F.col("n") - 1) * F.lit(float(f)) for f in fractions]
    near, wide = _slack(accuracy)
    held = max(small_group, 2 * wide * min(largest, MIDDLE_GROUP), 2 * near * largest)
    found = written(_found(numbers, bounds, key, columns, fractions, held <= one_task), "found")
    missed = [F.col(f"{end}{j}").isNull() | F.isnan(f"{end}{j}") for end in "ab" for j in range(len(fractions))]
    if found.where(reduce(lambda x, y: x | y, missed)).limit(1).count():
        # a rank outside its approximate bracket: once more between the least and the greatest value
        whole = written(_brackets(numbers, columns, fractions, key, accuracy, None), "brackets")
        found = _found(numbers, whole, key, columns, fractions, False)
    names = F.array(*[F.lit(c) for c in columns])
    values = [
        F.struct(F.lit(float(f)).alias("fraction"), _between(F.col(f"a{j}"), F.col(f"b{j}"), ranks[j]).alias("value"))
        for j, f in enumerate(fractions)
    ]
    order = [*key, "column", "fraction", "n", "value"]
    results = found.select(*key, names[F.col("item")].alias("column"), "n", F.inline(F.array(*values))).select(*order)
    without_values = (
        bounds.select(*key, F.posexplode("_brackets").alias("item", "bracket"))
        .where("bracket.n = 0")
        .select(
            *key,
            names[F.col("item")].alias("column"),
            F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"),
            F.lit(0).cast("bigint").alias("n"),
            F.lit(None).cast("double").alias("value"),
        )
    )
    return results.unionByName(without_values)


def _found(
    numbers: DataFrame, bounds: DataFrame, key: list[str], columns: list[str], fractions: list[float], one_sort: bool
) -> DataFrame:
    """Per key and item the values at the ranks below (a) and above (b) each quantile; NaN or NULL outside its bracket."""
    group = key + ["item", "n"]
    bracket = F.col("_brackets")[F.col("item")]
    counted = (
        attach_written(numbers, bounds, key)
        .select(*key, "_brackets", F.posexplode(F.array(*columns)).alias("item", "value"))
        .where("value IS NOT NULL")
        .select(*key, "item", bracket["n"].alias("n"), *_zone(bracket, F.col("value"), len(fractions)))
        .groupBy(*group, "zone", "value")
        .agg(F.count("*").alias("copies"))
    )
    if one_sort:
        ordered = W.partitionBy(*group).orderBy("zone", "value").rowsBetween(W.unboundedPreceding, W.currentRow)
        running = counted.withColumn("seen", F.sum("copies").over(ordered))
    else:
        running = _running_near_ranks(written(counted, "counted"), group, fractions)

    def at(rank: Column) -> Column:
        return F.min_by("value", F.when(F.col("seen") > rank, F.col("seen")))

    ranks = [(F.col("n") - 1) * F.lit(float(f)) for f in fractions]
    return running.groupBy(*group).agg(
        *[at(F.floor(r)).alias(f"a{j}") for j, r in enumerate(ranks)],
        *[at(F.ceil(r)).alias(f"b{j}") for j, r in enumerate(ranks)],
    )


def _slack(accuracy: int) -> tuple[float, float]:
    """Half width of the narrow and the wide bracket, as shares of the group."""
    near = 4.0 / accuracy
    return near, max(near, WIDE)


def _held(numbers: DataFrame, columns: list[str], fractions: list[float], key: list[str]) -> DataFrame:
    """Quantiles of groups that are known to be small."""
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    wide = numbers.groupBy(*key).agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.percentile(c, wanted).alias("values"))
                for c in columns
            ]
        ).alias("_items")
    )
    each = F.arrays_zip(wanted.alias("fraction"), F.col("values").alias("value"))
    missing = F.transform(wanted, lambda f: F.struct(f.alias("fraction"), F.lit(None).cast("double").alias("value")))
    return wide.select(*key, F.inline("_items")).select(
        *key, "column", "n", F.inline(F.when(F.col("n") > 0, each).otherwise(missing))
    ).select(*key, "column", "fraction", "n", "value")


def _brackets(
    numbers: DataFrame, columns: list[str], fractions: list[float], key: list[str], accuracy: int, small_group: int | None
) -> DataFrame:
    """Per key an array over the columns: count, lower and upper ends of each quantile's bracket."""
    count = len(fractions)
    ends = [min(1.0, max(0.0, f + sign * slack)) for slack in _slack(accuracy) for sign in (-1, 1) for f in fractions]
    probes = F.array(*[F.lit(x) for x in ends])
    wide = numbers.groupBy(*key).agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.min(c).alias("least"),
                F.max(c).alias("most"),
                F.percentile_approx(c, probes, accuracy).alias("probe"),
            ).alias(f"_m{i}")
            for i, c in enumerate(columns)
        ]
    )

    def entry(i: int) -> Column:
        m = F.col(f"_m{i}")

        def end(extreme: str, part: int) -> Column:
            near, wide = (F.slice(m["probe"], start * count + 1, count) for start in (part, part + 2))
            small = F.array_repeat(m[extreme], count)
            if small_group is None:
                return small
            return F.when(m["n"] <= small_group, small).when(m["n"] <= MIDDLE_GROUP, wide).otherwise(near)

        return F.struct(m["n"].alias("n"), end("least", 0).alias("lo"), end("most", 1).alias("hi"))

    return wide.select(*key, F.array(*[entry(i) for i in range(len(columns))]).alias("_brackets"))


def _zone(bracket: Column, value: Column, count: int) -> tuple[Column, Column]:
    """How many brackets start at or below the value; the value itself if one holds it, else NaN."""
    zone = sum(((bracket["lo"][j] <= value).cast("int") for j in range(1, count)), (bracket["lo"][0] <= value).cast("int"))
    held = (zone > 0) & (value <= F.get(bracket["hi"], zone - 1))
    return zone.alias("zone"), F.when(held, value).otherwise(float("nan")).alias("value")


def _running_near_ranks(counted: DataFrame, group: list[str], fractions: list[float]) -> DataFrame:
    """Running counts of the values in those bins of each bracket that hold a wanted rank."""
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    ends = counted.groupBy(*group, "zone").agg(
        F.min(finite).alias("first"), F.max(finite).alias("final")
    )
    width = F.col("final") - F.col("first")
    part = F.when(width > 0, (F.col("value") - F.col("first")) / width).otherwise(0.0)
    inner = 1 + F.least(F.floor(part * BINS), F.lit(BINS - 1))  # infinite values have bins of their own
    place = (
        F.when(F.isnan("value"), BINS + 2)
        .when(F.col("value") == float("-inf"), 0)
        .when(F.col("value") == float("inf"), BINS + 1)
        .otherwise(inner)
    )
    binned = attach_written(counted, written(ends, "ends"), group + ["zone"]).withColumn("bin", place.cast("int"))

    sums = binned.groupBy(*group, "zone", "bin").agg(F.sum("copies").alias("inside"))
    ordered = W.partitionBy(*group).orderBy("zone", "bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = sums.withColumn("end", F.sum("inside").over(ordered)).withColumn("start", F.col("end") - F.col("inside"))
    wanted = [
        (F.col("start") <= rank) & (rank < F.col("end"))
        for f in fractions
        for rank in (F.floor((F.col("n") - 1) * F.lit(float(f))), F.ceil((F.col("n") - 1) * F.lit(float(f))))
    ]
    near = spans.where(reduce(lambda a, b: a | b, wanted)).drop("inside", "end")
    same_bin = W.partitionBy(*group, "zone", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = attach_written(binned, written(near, "near"), group + ["zone", "bin"]).where("start IS NOT NULL")
    return found.withColumn("seen", F.col("start") + F.sum("copies").over(same_bin))


def _between(a: Column, b: Column, rank: Column) -> Column:
    """Interpolate between the values at the ranks below and above, with infinite ends as `percentile` has them."""
    part = rank - F.floor(rank)
    return F.when((a == b) | (part == 0), a).otherwise(a * (1 - part) + b * part)


def medians(frame: DataFrame, columns: Sequence[str], key: Sequence[str] = (), **options) -> DataFrame:
    """One row per key, one median column per input column."""
    if not columns:
        return frame.select(*key).distinct()
    rows = exact_quantiles(frame, columns, [0.5], key, **options)
    return rows.groupBy(*key).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )


def exact_mode(frame: DataFrame, column: str, key: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per key, the smallest on ties; NULL when no value exists."""
    counts = frame.groupBy(*key, column).agg(F.count(column).alias("_copies"))
    best = F.min(F.when(F.col(column).isNotNull(), F.struct((-F.col("_copies")).alias("rank"), F.col(column))))
    return counts.groupBy(*key).agg(best[column].alias(column))
