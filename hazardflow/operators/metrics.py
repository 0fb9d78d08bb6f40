"""Classifier metrics from one confusion count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_weights(frame: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes x rows of the class)."""
    counts = frame.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    total = counts.agg(F.struct(F.sum("rows").alias("rows"), F.count("*").alias("classes"))).scalar()
    weight = total.getField("rows") / (total.getField("classes") * F.col("rows"))
    return counts.select(label, "rows", weight.alias("weight"))


def accuracy(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return frame.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(
    frame: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per actual class that occurs, one column per predicted class."""
    return frame.groupBy(label).agg(
        *[F.count_if(F.col(prediction) == c).alias(f"predicted_{c}") for c in classes]
    )


def _pairs(frame: DataFrame, label: str, prediction: str) -> DataFrame:
    return frame.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count("*").alias("n"))


def class_metrics(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support per class; 0 where a denominator is 0.

    The table is counted once into (actual, predicted) pairs; every metric is
    computed from those few rows.
    """
    cells = _pairs(frame, label, prediction).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("claimed"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("claimed"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    sums = cells.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    hits = F.col("hits")
    return sums.select(
        "class",
        ratio(hits, F.col("claimed")).alias("precision"),
        ratio(hits, F.col("support")).alias("recall"),
        ratio(2 * hits, F.col("claimed") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def class_report(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Metrics per class, then accuracy, macro and weighted averages."""
    per_class = class_metrics(frame, label, prediction)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = per_class.agg(
        total.alias("total"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in names],
    )
    rows = summary.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("accuracy").alias("name"),
                    F.lit(None).cast("double").alias("precision"),
                    F.lit(None).cast("double").alias("recall"),
                    F.col("accuracy").alias("f1"),
                    F.col("total").alias("support"),
                ),
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("name"),
                        *[F.col(f"{kind}_{m}").alias(m) for m in names],
                        F.col("total").alias("support"),
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        )
    )
    classes = per_class.select(F.col("class").cast("string").alias("name"), *names, "support")
    return classes.unionByName(rows)


def report_text(report: DataFrame) -> DataFrame:
    """Fixed-width report lines, two digits."""

    def cell(name: str) -> Column:
        return F.lpad(F.coalesce(F.format_number(name, 2), F.lit("")), 10, " ")

    return report.select(
        "name",
        F.concat(
            F.lpad("name", 12, " "), cell("precision"), cell("recall"), cell("f1"),
            F.lpad(F.col("support").cast("string"), 10, " "),
        ).alias("line"),
    )


def weighted_f1(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return class_metrics(frame, label, prediction).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1")
    )


def cv_stats(scores: DataFrame, score: str = "accuracy", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*by).agg(
        F.count(score).alias("folds"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")
    )
