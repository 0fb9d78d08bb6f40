"""Row positions inside a group, also when one group holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardflow.operators.lookup import named
from hazardflow.session import written

PART_ROWS = 1_000_000


def _ranged(frame: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    """The rows in ranges of (group, order), each with the number of its range, written once.

    Ranges follow the real types of all order columns, so common starts, heavy
    values and NULLs of one column are told apart by the next.
    """
    shuffle = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(shuffle, -(-frame.count() // PART_ROWS))
    ranged = frame.withColumn("_group", F.struct(*[named(c) for c in group]) if group else F.lit(0))
    ranged = ranged.repartitionByRange(parts, "_group", *[named(c) for c in order])
    return written(ranged.withColumn("_part", F.spark_partition_id()), "ranged")


def running_total(
    frame: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, parts: int | None = None
) -> DataFrame:
    """Add the sum of `value` over the rows of the group before and with each row.

    Each range is summed alone; the sums of the ranges give every range its start.
    """
    rows = _ranged(frame.withColumn("_value", value), group, order, parts)
    before = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_group", "_part").agg(F.sum("_value").alias("_sum"))
    starts = starts.select(
        F.struct("_group", "_part").alias("_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy("_range").orderBy(*[named(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("_range", F.struct("_group", "_part")).withColumn("_sum", F.sum("_value").over(inside))
    total = (F.col("_start") + F.col("_sum")).alias(name)
    return summed.join(starts, "_range").select(*[named(c) for c in frame.columns], total)


def position_in_group(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    buckets: int | None = None,
) -> DataFrame:
    """Add the zero-based position of each row within its group.

    `order` must identify a row of the group. The table is cut into ranges by
    its size, so one task never holds a whole group.
    """
    one = F.lit(1).cast("bigint")
    placed = running_total(frame, group, order, one, "_position", buckets)
    return placed.withColumn(name, F.col("_position") - 1).drop("_position")


def batch_index(frame: DataFrame, batch: Sequence[str], order: Sequence[str]) -> DataFrame:
    return position_in_group(frame, batch, order, "batch_index")


def write_batch(frame: DataFrame, key: Sequence[str], order: Sequence[str], size: int = 1000) -> DataFrame:
    placed = position_in_group(frame, key, order, "_batch_position")
    return placed.withColumn("write_batch", F.floor(F.col("_batch_position") / size)).drop("_batch_position")
