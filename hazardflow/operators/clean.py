"""Cleaning in fixed order: dedupe, impute, drop dead rows, narrow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.functions.scalar import as_number, no_nan
from hazardflow.operators.lookup import attach, named
from hazardflow.operators.profile import COPIES, data_columns, is_missing, row_copies
from hazardflow.operators.quantiles import exact_mode, medians
from hazardflow.schema import FEATURES, FILE_KEY, TARGET
from hazardflow.session import written


def available(frame: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c in frame.columns]


def dedupe(frame: DataFrame, key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    """Distinct rows per file; the file key is part of the row."""
    missing = [k for k in key if k not in frame.columns]
    if missing:
        raise ValueError(f"no key column {missing}")
    return frame.dropDuplicates()


def impute_median(frame: DataFrame, columns: Sequence[str], key: Sequence[str] = (FILE_KEY,)) -> DataFrame:
    stats = medians(frame, columns, key).withColumnsRenamed({c: f"_median_{c}" for c in columns})
    kinds = dict(frame.dtypes)
    filled = {
        c: F.coalesce(
            no_nan(F.col(c)) if kinds[c] in ("double", "float") else F.col(c), F.col(f"_median_{c}")
        )
        for c in columns
    }
    return attach(frame, stats, key).withColumns(filled).select(*[named(c) for c in frame.columns])


def impute_mode(
    frame: DataFrame, column: str, default: object = 0, key: Sequence[str] = (FILE_KEY,)
) -> DataFrame:
    stats = exact_mode(frame, column, key).withColumnRenamed(column, "_mode")
    kind = dict(frame.dtypes)[column]
    filled = F.coalesce(column, "_mode", F.lit(default).cast(kind))
    return attach(frame, stats, key).withColumn(column, filled).select(*[named(c) for c in frame.columns])


def is_all_zero(columns: Sequence[str], own: str | None = None) -> Column:
    """Every column is zero; a NULL counts as not zero.

    `own` names an array of the columns the row's file has; others are ignored.
    """

    def zero(c: str) -> Column:
        test = F.coalesce(named(c) == 0, F.lit(False))
        return test if own is None else test | ~F.array_contains(own, c)

    some = F.lit(bool(columns))
    if own is not None:
        some = F.arrays_overlap(F.col(own), F.array(*[F.lit(c) for c in columns]).cast("array<string>"))
    return reduce(lambda a, b: a & b, [zero(c) for c in columns], some)


def drop_all_zero(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.where(~is_all_zero(columns))


def narrow(frame: DataFrame, float_cols: Sequence[str] = (), int_cols: Sequence[str] = ()) -> DataFrame:
    """Float and int columns; what cannot be read becomes NULL."""
    kinds = dict(frame.dtypes)

    def number(c):
        return as_number(F.col(c)) if kinds[c] == "string" else F.col(c).try_cast("double")

    changes = {c: number(c).cast("float") for c in float_cols}
    changes |= {c: number(c).try_cast("int") for c in int_cols}
    return frame.withColumns(changes) if changes else frame


def clean_table(
    frame: DataFrame,
    features: Sequence[str] = tuple(FEATURES),
    target: str | None = TARGET,
    key: str = FILE_KEY,
    files: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clean every file at once; gives the cleaned rows and one statistics row per file.

    `files` (key, columns) tells which columns each file really has, so that a
    column a file lacks is neither missing nor part of the dead-row test.

    The deduplicated rows are written once with their copy counts: all later
    passes (medians, mode, result, statistics) are narrow scans of that table.
    The input may be plain rows or the output of `row_copies`.
    """
    columns = data_columns(frame, [key])
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    numeric = available(frame, features)
    label = target if target in columns else None
    texts = dict(frame.dtypes)

    own = "_own" if files is not None else None

    def empty_cells(types):
        tests = {c: is_missing(c, types[c]) for c in columns}
        if own:
            tests = {c: test & F.array_contains(own, c) for c, test in tests.items()}
        return sum((F.when(test, 1).otherwise(0) for test in tests.values()), F.lit(0))

    distinct = frame if COPIES in frame.columns else row_copies(frame, [key])
    if files is not None:
        distinct = attach(distinct, files.select(key, F.col("columns").alias(own)), [key])
    distinct = distinct.withColumn("_missing", empty_cells(kinds))
    numbers = {
        c: as_number(F.col(c)) if texts[c] == "string" else no_nan(F.col(c).cast("double")) for c in numeric
    }
    if label:
        code = as_number(F.col(label)) if texts[label] == "string" else F.col(label).cast("double")
        numbers[label] = code.try_cast("int")
    lost = [F.when(~is_missing(c, kinds[c]) & n.isNull(), 1).otherwise(0) for c, n in numbers.items() if texts[c] == "string"]
    if own:
        lost = [F.when(F.array_contains(own, c), n).otherwise(0) for c, n in zip([c for c in numbers if texts[c] == "string"], lost, strict=True)]
    if lost:
        distinct = distinct.withColumn("_coerced", sum(lost, F.lit(0)))
    base = written(distinct.withColumns(numbers), "distinct")

    stats = medians(base, numeric, [key]).withColumnsRenamed({c: f"_fill_{c}" for c in numeric})
    if label:
        modes = exact_mode(base, label, [key]).withColumnRenamed(label, f"_fill_{label}")
        stats = stats.join(modes, key, "full")
    filled = attach(base, stats, [key])
    changes = {c: F.coalesce(c, f"_fill_{c}") for c in numeric}
    if label:
        changes[label] = F.coalesce(label, f"_fill_{label}", F.lit(0))
    filled = filled.withColumns(changes).withColumn("_dead", is_all_zero(numeric, own))

    cleaned = narrow(filled.where("NOT _dead").select(key, *[named(c) for c in columns]), numeric, [label] if label else [])
    left = {f.name: f.dataType for f in filled.schema.fields}
    report = clean_stats(filled.withColumn("_left", empty_cells(left)), key)
    return cleaned, report


def clean_stats(flagged: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """One row per file; tables read as text also tell `coerced`, the cells whose text was no number."""
    alive = ~F.col("_dead")
    coerced = [F.sum(F.col("_coerced") * F.col(COPIES)).alias("coerced")] if "_coerced" in flagged.columns else []
    return (
        flagged.groupBy(key)
        .agg(
            F.sum(COPIES).alias("rows_before"),
            F.count_if(alive).alias("rows_after"),
            F.sum(F.col(COPIES) - 1).alias("duplicates_removed"),
            F.count_if(F.col("_dead")).alias("zero_rows_removed"),
            F.sum(F.col("_missing") * F.col(COPIES)).alias("missing_before"),
            F.sum(F.when(alive, F.col("_left")).otherwise(0)).alias("missing_after"),
            *coerced,
        )
        .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    )


def clean_summary(stats: DataFrame) -> DataFrame:
    """Totals over the files that were cleaned; failed files only count as errors."""
    failed = F.col("status") == "error" if "status" in stats.columns else F.lit(False)
    before, after = F.sum("rows_before"), F.sum("rows_after")
    removed = F.sum("rows_removed")
    zero = F.lit(0).cast("bigint")
    return stats.agg(
        F.coalesce(before, zero).alias("total_original_rows"),
        F.coalesce(after, zero).alias("total_final_rows"),
        F.coalesce(removed, zero).alias("total_rows_removed"),
        F.when(before > 0, F.round(removed * 100 / before, 2)).otherwise(0.0).alias("data_reduction_pct"),
        F.count_if(failed).alias("files_with_errors"),
    )
