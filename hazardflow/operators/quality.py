"""File-level validation: column lists, warnings, errors, recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.functions.scalar import name_list
from hazardflow.operators.profile import column_metrics, is_numeric_type, row_copies, schema_diff
from hazardflow.schema import EXTRA_CELL, FEATURES, FILE_KEY, REQUIRED

# The texts of the warnings.
MISSING_COLUMNS = "Missing required columns: %s"
EXTRA_COLUMNS = "Extra columns found (will be ignored): %s"
NOT_NUMERIC = "Column %s should be numeric but is %s"
HIGH_MISSING = "High missing values percentage: %.2f%%"
DUPLICATES = "Duplicate rows found: %d (%.2f%%)"
EMPTY_COLUMNS = "Completely empty columns: %s"


def _names(metrics: Column, keep) -> Column:
    return F.transform(F.filter(metrics, keep), lambda m: m["column"])


def validate_files(
    frame: DataFrame,
    files: DataFrame | None = None,
    required: Sequence[str] = tuple(REQUIRED),
    features: Sequence[str] = tuple(FEATURES),
    missing_pct: float = 10,
    key: str = FILE_KEY,
) -> DataFrame:
    """One validation row per file.

    `files` is the file table of the CSV reader: it supplies the columns each
    file really has, sizes, header-only files and files that could not be read.
    """
    copies = frame if "_copies" in frame.columns else row_copies(frame, [key])
    measured = column_metrics(copies, [key])
    if files is None:
        every = F.array(*[F.lit(c) for c in frame.columns if c not in (key, "_copies", EXTRA_CELL)])
        table = measured.withColumns(
            {"columns": every, "status": F.lit("ok"), "error": F.lit(None).cast("string")}
        )
    else:
        table = files.join(measured, key, "left")
    present = F.filter(F.coalesce("metrics", F.array()), lambda m: F.array_contains(F.col("columns"), m["column"]))
    overlong = F.filter(
        F.coalesce("metrics", F.array()),
        lambda m: (m["column"] == EXTRA_CELL) & (m["missing"] < F.col("rows")),
    )
    feature_names = F.array(*[F.lit(c) for c in features])
    table = (
        table.withColumn("rows", F.coalesce("rows", F.lit(0)))
        .withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
        .withColumn("_present", present)
        .withColumn(
            "error",
            F.coalesce("error", F.when(F.size(overlong) > 0, "a row has more cells than the header")),
        )
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
        .withColumn("column_count", F.size("columns"))
        .withColumn(
            "missing_total",
            F.aggregate("_present", F.lit(0).cast("bigint"), lambda total, m: total + m["missing"]),
        )
        .withColumn(
            "missing_per_column",
            F.map_from_arrays(_names(F.col("_present"), lambda m: F.lit(True)), F.transform("_present", lambda m: m["missing"])),
        )
        .withColumn(
            "data_types",
            F.map_from_arrays(_names(F.col("_present"), lambda m: F.lit(True)), F.transform("_present", lambda m: m["data_type"])),
        )
        .withColumn("numeric_columns", _names(F.col("_present"), lambda m: is_numeric_type(m["data_type"])))
        .withColumn(
            "categorical_columns",
            F.when(F.col("rows") == 0, F.col("columns")).otherwise(
                _names(F.col("_present"), lambda m: m["data_type"] == "object")
            ),
        )
        .withColumn(
            "empty_columns",
            F.when(F.col("rows") == 0, F.col("columns")).otherwise(
                _names(F.col("_present"), lambda m: m["missing"] == F.col("rows"))
            ),
        )
    )
    table = schema_diff(table, required).withColumn(
        "non_numeric_required",
        F.array_except(F.array_intersect("columns", feature_names), F.col("numeric_columns")),
    )
    return with_warnings(table, missing_pct).drop("_present", "metrics")


def with_warnings(table: DataFrame, missing_pct: float = 10) -> DataFrame:
    """Add the percentages and the list of warnings to a validation table."""
    cells = F.col("rows") * F.col("column_count")
    share = F.when(cells > 0, F.col("missing_total") * 100 / cells)
    repeated = F.when(F.col("rows") > 0, F.col("duplicates") * 100 / F.col("rows"))
    no_texts = F.array().cast("array<string>")
    bad_types = F.transform(
        "non_numeric_required",
        lambda c: F.format_string(NOT_NUMERIC, c, F.coalesce(F.col("data_types")[c], F.lit("object"))),
    )

    def listed(text: str, names: str) -> Column:
        return F.when(F.size(names) > 0, F.format_string(text, name_list(F.col(names))))

    found = F.array(listed(MISSING_COLUMNS, "missing_columns"), listed(EXTRA_COLUMNS, "extra_columns"))
    measured = F.array(
        F.when(share > missing_pct, F.format_string(HIGH_MISSING, share)),
        F.when(F.col("duplicates") > 0, F.format_string(DUPLICATES, F.col("duplicates"), repeated)),
        listed(EMPTY_COLUMNS, "empty_columns"),
    )
    return table.withColumns(
        {
            "missing_pct": F.round(share, 2),
            "duplicate_pct": F.round(repeated, 2),
            "warnings": F.when(
                F.col("status") == "ok", F.concat(F.array_compact(found), bad_types, F.array_compact(measured))
            ).otherwise(no_texts),
        }
    )


def with_errors(table: DataFrame, errors: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """Mark the files of a later stage's error table (key, error) as failed."""
    return (
        table.join(errors.select(key, F.col("error").alias("_error")), key, "left")
        .withColumn("error", F.coalesce("error", "_error"))
        .withColumn("status", F.when(F.col("error").isNull(), F.col("status")).otherwise("error"))
        .drop("_error")
    )


def validation_summary(validated: DataFrame) -> DataFrame:
    ok = F.col("status") != "error"
    return validated.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(ok, F.col("column_count"))), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum(F.when(ok, F.col("missing_total"))), F.lit(0)).alias("total_missing_values"),
        F.count_if(F.size("warnings") > 0).alias("files_with_warnings"),
        F.count_if(~ok).alias("files_with_errors"),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of a range check."""
    return checked.where("valid").drop("valid", "violations"), checked.where("NOT valid").drop("valid")


# What each rule of the quality report advises.
ADVICE = {
    "data_quality": (
        "Data quality warnings detected",
        "Review validation warnings and consider additional data cleaning steps",
        "medium",
    ),
    "data_completeness": (
        "Missing values found in dataset",
        "Implement more sophisticated missing value imputation strategies",
        "low",
    ),
    "data_efficiency": (
        "Significant data reduction during preprocessing",
        "Review data collection processes to reduce duplicate and invalid records",
        "medium",
    ),
}


def _advice(category: str) -> Column:
    names = ("category", "issue", "recommendation", "priority")
    return F.struct(*[F.lit(text).alias(name) for name, text in zip(names, (category, *ADVICE[category]))])


def recommendation_list(reduction_limit: float = 20) -> Column:
    """Advice by rule over files_with_warnings, total_missing_values and data_reduction_pct."""
    rules = {
        "data_quality": F.col("files_with_warnings") > 0,
        "data_completeness": F.col("total_missing_values") > 0,
        "data_efficiency": F.col("data_reduction_pct") > reduction_limit,
    }
    return F.array_compact(F.array(*[F.when(broken, _advice(name)) for name, broken in rules.items()]))


def recommendations(summary: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return summary.withColumn("_advice", recommendation_list()).select(*keep, F.inline("_advice"))


# The follow-up texts of a run.
AFTER_SUCCESS = [
    "Data is ready for feature engineering",
    "Proceed to model training pipeline",
    "Set up automated model retraining schedule",
]
AFTER_FAILURE = [
    "Review failed file processing logs",
    "Fix data quality issues before model training",
    "Consider adjusting preprocessing parameters",
]
ALWAYS = [
    "Monitor InfluxDB data ingestion",
    "Set up data quality alerts",
    "Schedule regular data validation checks",
]


def next_action_list() -> Column:
    def texts(items):
        return F.array(*[F.lit(x) for x in items])

    first = F.when(F.col("success_rate") == 100, texts(AFTER_SUCCESS)).otherwise(texts(AFTER_FAILURE))
    return F.concat(first, texts(ALWAYS))


def next_actions(summary: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return summary.select(*keep, F.posexplode(next_action_list()).alias("step", "action"))
