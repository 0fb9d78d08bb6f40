"""Joins, set operations, pivots, latest rows and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardflow.operators.lookup import attach
from hazardflow.schema import FILE_KEY


def latest_per_key(frame: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record per key in `order`.

    An aggregate, not a window: copies of a hot key shrink before the shuffle.
    """
    rest = [c for c in frame.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return frame.groupBy(*key).agg(last).select(*key, "_last.*").select(*frame.columns)


def attach_risk(numeric: DataFrame, text: DataFrame, on: str = "ts", order: Sequence[str] = ("value",)) -> DataFrame:
    """Left join of number rows with the last risk text of their time; 'Unknown' without one.

    The text side is reduced to one row per time first, so no key of the join
    is repeated on both sides.
    """
    last = text.groupBy(on).agg(F.max_by("value", F.struct(*order)).alias("risk_level"))
    return numeric.join(last, on, "left").withColumn("risk_level", F.coalesce("risk_level", F.lit("Unknown")))


def join_stages(validated: DataFrame, cleaned: DataFrame, stored: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """Stage tables, one row per file each, side by side for every file."""
    return validated.join(cleaned, key, "left").join(stored, key, "left")


def for_every(files: DataFrame, stage: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """A stage table with a row for every file; files that gave it no rows count zero."""
    return files.select(key).join(stage, key, "left").na.fill(0)


def only_ok(frame: DataFrame, errors: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """Rows of files that are not in the error table; rows do not move unless that table is large."""
    failed = errors.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_failed", F.lit(True))
    return attach(frame, failed, [key]).where("_failed IS NULL").drop("_failed")


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    shared = [c for c in first.columns if c in second.columns]
    return first.select(*shared).unionByName(second.select(*shared))


def pivot_fields(
    points: DataFrame, fields: Sequence[str], key: Sequence[str] = ("ts",), field: str = "field", value: str = "value"
) -> DataFrame:
    """One column per listed field, by one aggregate and one shuffle."""
    return points.groupBy(*key).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def latest(frame: DataFrame, n: int, order: str = "ts") -> DataFrame:
    return frame.orderBy(F.desc(order)).limit(n)


def top_rows(frame: DataFrame, by: str, ties: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """Rows at the maximum of a column: all of them, or the first in `order`."""
    best = frame.where(F.col(by) == frame.agg(F.max(by)).scalar())
    return best if ties else best.orderBy(*order).limit(1)


def align_features(frame: DataFrame, model_columns: Sequence[str]) -> DataFrame:
    """The model's columns in its order; absent ones are 0.0."""
    have = set(frame.columns)
    return frame.select(*[F.col(c) if c in have else F.lit(0.0).alias(c) for c in model_columns])


def hazard_index(frame: DataFrame, weights: dict[str, float], name: str = "hazard") -> DataFrame:
    """Weighted sum of columns, each divided by its greatest value in the table."""
    most = frame.agg(F.struct(*[F.max(c).alias(c) for c in weights])).scalar()
    terms: list[Column] = [F.lit(w) * F.try_divide(F.col(c), most.getField(c)) for c, w in weights.items()]
    return frame.withColumn(name, sum(terms[1:], terms[0]))


def previous_run(model_runs: DataFrame, run_ts: Column) -> DataFrame:
    """Time of the last run before `run_ts`; NULL when there is none."""
    return model_runs.where(F.col("run_ts") < run_ts).agg(F.max("run_ts").alias("previous_run"))


def run_intervals(model_runs: DataFrame, model: str = "model_path") -> DataFrame:
    """Each run with the run before it, per model."""
    return model_runs.withColumn("previous_run", F.lag("run_ts").over(W.partitionBy(model).orderBy("run_ts")))
