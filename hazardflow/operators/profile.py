"""Profiles of columns, files and classes, each from one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardflow.functions.scalar import as_number, looks_integer, number_text
from hazardflow.operators.lookup import attach, named
from hazardflow.operators.quantiles import exact_quantiles
from hazardflow.schema import BOUNDS, FILE_KEY

COPIES = "_copies"


def is_missing(column: str, kind: T.DataType) -> Column:
    c = F.col(f"`{column}`")
    return (c.isNull() | F.isnan(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def is_infinite(column: str, kind: T.DataType) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        c = as_number(c)
    elif not isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.lit(False)
    return F.coalesce(F.abs(c) == float("inf"), F.lit(False))


def data_columns(frame: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in frame.columns if c not in key and c != COPIES]


def row_copies(frame: DataFrame, key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    """Each distinct row once, with its number of copies.

    Copies meet in the map-side combine, so a group of equal rows never reaches
    one task whole. Profiles, duplicate counts and the cleaned table all come
    from this one shuffle.
    """
    columns = [*key, *data_columns(frame, key)]
    return frame.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias(COPIES))


def by_value(frame: DataFrame, key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    """Text columns that hold only numbers in a file get one spelling per number.

    Equal rows of a file are then equal as texts, as they are once a reader has
    parsed them; a column with other texts keeps its spelling. Two scans.
    """
    texts = [f.name for f in frame.schema.fields if f.name not in key and isinstance(f.dataType, T.StringType)]
    if not texts:
        return frame
    held = {c: F.bool_and(named(c).isNull() | as_number(named(c)).isNotNull()) for c in texts}
    whole = {c: F.bool_and(named(c).isNull() | looks_integer(named(c))) for c in texts}
    kinds = [F.when(whole[c], "whole").when(held[c], "number").alias(f"_{i}") for i, c in enumerate(texts)]
    flags = frame.groupBy(*key).agg(F.array(*kinds).alias("_kinds"))
    tagged = attach(frame, flags, key)

    def spelled(i: int, c: str) -> Column:
        kind, text = F.get("_kinds", F.lit(i)), named(c)
        fraction = F.when(as_number(text) == 0, F.lit(0.0)).otherwise(as_number(text)).cast("string")
        return F.when(kind == "whole", number_text(text)).when(kind == "number", fraction).otherwise(text)

    spelled_texts = {c: spelled(i, c) for i, c in enumerate(texts)}
    return tagged.select(*[spelled_texts[c].alias(c) if c in spelled_texts else named(c) for c in frame.columns])


def _inferred_type(column: str, kind: T.DataType, weight: Column) -> Column:
    """Type name a CSV reader gives the column's values."""
    if isinstance(kind, T.StringType):
        c = F.col(f"`{column}`")
        missing = F.sum(F.when(c.isNull(), weight).otherwise(0))
        number = F.bool_and(c.isNull() | as_number(c).isNotNull())
        integer = F.bool_and(c.isNotNull() & looks_integer(c))
        logical = F.bool_and(c.isNotNull() & c.isin("True", "TRUE", "true", "False", "FALSE", "false"))
        return (
            F.when(F.sum(weight) == 0, "object")
            .when(integer & (missing == 0), "int64")
            .when(number, "float64")
            .when(logical, "bool")
            .otherwise("object")
        )
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.lit("float64" if isinstance(kind, T.DoubleType) else "float32")
    if isinstance(kind, T.IntegralType):
        return F.lit("int32" if isinstance(kind, T.IntegerType) else "int64")
    if isinstance(kind, T.BooleanType):
        return F.lit("bool")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("datetime64[us]")
    return F.lit("object")


def column_metrics(frame: DataFrame, key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    """One row per key: rows, duplicates, and an array of metrics per column.

    Accepts plain rows or the output of `row_copies`; only the latter gives the
    number of duplicate rows.
    """
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    counted = COPIES in frame.columns
    weight = F.col(COPIES) if counted else F.lit(1)
    metrics = [
        F.struct(
            F.lit(c).alias("column"),
            F.sum(F.when(is_missing(c, kinds[c]), weight).otherwise(0)).cast("bigint").alias("missing"),
            F.sum(F.when(is_infinite(c, kinds[c]), weight).otherwise(0)).cast("bigint").alias("infinite"),
            _inferred_type(c, kinds[c], weight).alias("data_type"),
        )
        for c in data_columns(frame, key)
    ]
    duplicates = F.sum(weight - 1).cast("bigint") if counted else F.lit(None).cast("bigint")
    return frame.groupBy(*key).agg(
        F.sum(weight).cast("bigint").alias("rows"),
        duplicates.alias("duplicates"),
        F.array(*metrics).alias("metrics"),
    )


def is_numeric_type(name: Column) -> Column:
    return name.isin("int64", "int32", "float64", "float32")


def profile(frame: DataFrame, key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    """One row per key and column: rows, missing, empty, infinite, type, numeric."""
    return column_metrics(frame, key).select(*key, "rows", F.inline("metrics")).select(
        *key,
        "column",
        "rows",
        "missing",
        (F.col("missing") == F.col("rows")).alias("empty"),
        "infinite",
        "data_type",
        is_numeric_type(F.col("data_type")).alias("numeric"),
    )


def duplicate_rows(frame: DataFrame, key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    """Rows that repeat an earlier full row, and their share in percent."""
    return row_copies(frame, key).groupBy(*key).agg(
        F.sum(COPIES).alias("rows"),
        F.sum(F.col(COPIES) - 1).alias("duplicates"),
        F.round(F.sum(F.col(COPIES) - 1) * 100 / F.sum(COPIES), 2).alias("duplicate_pct"),
    )


def describe(frame: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max; one row per column."""
    moments = frame.groupBy(*key).agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(F.col(c).cast("double")).alias("min"),
                    F.max(F.col(c).cast("double")).alias("max"),
                )
                for c in columns
            ]
        ).alias("moments")
    ).select(*key, F.inline("moments"))
    quartiles = (
        exact_quantiles(frame, columns, [0.25, 0.5, 0.75], key)
        .groupBy(*key, "column")
        .agg(
            *[
                F.max(F.when(F.col("fraction") == f, F.col("value"))).alias(name)
                for f, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
            ]
        )
    )
    return moments.join(quartiles, [*key, "column"], "left").select(
        *key, "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def class_distribution(frame: DataFrame, label: str) -> DataFrame:
    """Count and percentage per class, in class order."""
    counts = frame.groupBy(label).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.select(label, "rows", F.round(F.col("rows") * 100 / total, 2).alias("percent")).orderBy(label)


def global_range(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and greatest value over all the columns together."""
    lows = [F.min(c).cast("double") for c in columns]
    highs = [F.max(c).cast("double") for c in columns]
    low = F.least(*lows) if len(columns) > 1 else lows[0]
    high = F.greatest(*highs) if len(columns) > 1 else highs[0]
    return frame.agg(low.alias("low"), high.alias("high"))


def schema_diff(frame: DataFrame, required: Sequence[str], columns: str = "columns") -> DataFrame:
    """Required names a file lacks, and names it has beyond them."""
    wanted = F.array(*[F.lit(c) for c in required])
    return frame.withColumns(
        {
            "missing_columns": F.array_except(wanted, F.col(columns)),
            "extra_columns": F.array_except(F.col(columns), wanted),
        }
    )


def range_check(frame: DataFrame, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Add `violations` (names out of bounds or NULL) and `valid`."""
    failed = [
        F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), F.lit(c)) for c, (lo, hi) in bounds.items()
    ]
    return frame.withColumn("violations", F.array_compact(F.array(*failed))).withColumn(
        "valid", F.size("violations") == 0
    )
