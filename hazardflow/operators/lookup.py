"""Joining per-group statistics to a large table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardflow.session import written

BROADCAST_BYTES = 8 << 20
SALTS = 64


def named(column: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def attach(
    frame: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Left-join a statistics table with one row per `on` value.

    The statistics are written first, so their size in bytes is known. Up to
    `limit` bytes they are broadcast; beyond it every statistics row is repeated
    once per salt, so that a group holding much of the table is spread over
    `salts` tasks instead of one. NULL keys match NULL keys.
    """
    return attach_written(frame, written(stats, "stats"), on, limit, salts)


def table_bytes(table: DataFrame) -> int:
    """Size of a written table, as the optimizer knows it from the files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def attach_written(
    frame: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    on = list(on)
    key, copy = "_attach_key", "_attach_copy"
    values = [named(c) for c in table.columns if c not in on]
    same = F.struct(*[named(c) for c in on]) if on else F.lit(0)
    keyed = table.select(same.alias(key), *values)
    left = frame.withColumn(key, same)
    if table_bytes(table) <= limit:
        return left.join(F.broadcast(keyed), key, "left").drop(key)
    fields = [named(f.name) for f in frame.schema.fields if _hashable(f.dataType)]
    salted = left.withColumn(copy, F.pmod(F.xxhash64(*fields) if fields else F.monotonically_increasing_id(), F.lit(salts)))
    spread = keyed.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(spread, [key, copy], "left").drop(key, copy)
