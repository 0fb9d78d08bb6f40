"""Sinks. Every write has its own run folder, so a repeated run replaces itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.functions.scalar import output_name, own_name
from hazardflow.operators.lookup import attach
from hazardflow.operators.numbering import batch_index
from hazardflow.schema import FEATURES, FILE_KEY
from hazardflow.session import scratch_path
from hazardflow.sources.readers import list_inputs


def write_run(frame: DataFrame, path: str, run_date: str) -> str:
    """Write one run as <path>/run_date=<run_date>; gives the folder of the run."""
    target = f"{path}/run_date={run_date}"
    frame.write.mode("overwrite").parquet(target)
    return target


def output_names(files: DataFrame, run: str, key: str = FILE_KEY) -> DataFrame:
    """(key, output_name) of each file; files whose names would be equal get a mark of their path."""
    named = files.select(key, output_name(F.col(key), F.lit(run)).alias("plain"))
    alike = named.groupBy(F.lower("plain").alias("low")).agg(F.count("*").alias("n")).where("n > 1")
    marked = named.join(alike, F.lower("plain") == F.col("low"), "left")
    own = F.concat_ws("_", "plain", F.when(F.col("n").isNotNull(), F.substring(F.md5(F.col(key).cast("binary")), 1, 8)))
    return marked.select(key, own.alias("output_name"))


def write_clean(frame: DataFrame, path: str, run: str, key: str = FILE_KEY, files: DataFrame | None = None) -> DataFrame:
    """Write each file's cleaned rows as CSV under its output name, with the columns it had.

    Gives (output_name, parts, output_bytes); without rows nothing is written. `files` (key, columns)
    tells the columns of each file. Rows are dealt by layout (a distinct list of columns) once, then
    each layout reads its own part only. They are rebalanced by output, so a large file is spread over
    several parts and small ones are not scattered.
    """
    spark = frame.sparkSession
    nothing = spark.createDataFrame([], "output_name string, parts bigint, output_bytes bigint")
    names = [c for c in frame.columns if c != key]
    if not names or frame.isEmpty():
        return nothing
    named = output_names(frame.select(key).distinct() if files is None else files, run, key)
    if files is None:
        rows, layouts = attach(frame, named, [key]), {0: names}
    else:
        known = files.where("size(columns) > 0").select(key, "columns")
        lists = sorted(r["columns"] for r in known.select("columns").distinct().collect())  # one per distinct header
        number = F.array_position(F.array(*[F.array(*[F.lit(c) for c in own]) for own in lists]), F.col("columns")) - 1
        placed = known.select(key, number.cast("int").alias("layout"))
        rows = attach(frame, named.join(placed, key), [key]).where("layout IS NOT NULL")
        layouts = {i: [c for c in own if c in names] for i, own in enumerate(lists)}
    if len(layouts) > 1:
        dealt = scratch_path(spark, "layouts")
        rows.hint("rebalance", "layout").write.partitionBy("layout").parquet(dealt)
        rows = spark.read.parquet(dealt)
        layouts = {i: layouts[i] for i in sorted(r["layout"] for r in rows.select("layout").distinct().collect())}
    for layout, columns in layouts.items():
        own = rows.where(F.col("layout") == layout) if len(layouts) > 1 else rows
        (
            own.select("output_name", *[F.col(f"`{c}`").alias(own_name(c)) for c in columns])
            .hint("rebalance", "output_name")
            .write.mode("overwrite")
            .partitionBy("output_name")
            .option("header", True)
            .csv(f"{path}/layout={layout}")
        )
    return (
        list_inputs(spark, f"{path}/layout=*/output_name=*")
        .select(F.regexp_extract("path", r"output_name=([^/]+)/", 1).alias("output_name"), "bytes")
        .groupBy("output_name")
        .agg(F.count("*").alias("parts"), F.sum("bytes").alias("output_bytes"))
    )


def write_report(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_points_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str, run_id: str, batch: int = 1000, key: str = FILE_KEY) -> DataFrame:
    """Write points by measurement and date, then report each file from what was written.

    `batch` is the number of points that count as one write batch.
    """
    spark = points.sparkSession
    target = f"{path}/run_id={run_id}"
    dated = points.withColumn("date", F.to_date("ts"))
    dated.hint("rebalance", "measurement", "date").write.mode("overwrite").partitionBy(
        "measurement", "date"
    ).parquet(target)
    return storage_rows(spark.read.schema(dated.schema).parquet(target), batch, key)


def storage_rows(stored: DataFrame, batch: int = 1000, key: str = FILE_KEY) -> DataFrame:
    return stored.groupBy(key).agg(
        F.count("*").alias("points"),
        F.ceil(F.count("*") / batch).alias("batches"),
        F.lit("success").alias("status"),
    )


def prediction_rows(scored: DataFrame, kind: str, ts=None, batch: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Log rows: input_* fields, results and tags.

    For a batch each row also gets its position; `order` identifies a row.
    """
    rows = scored if ts is None else scored.withColumn("ts", F.lit(ts).cast("timestamp"))
    if kind == "batch":
        if not order:
            raise ValueError("a batch needs the columns that order its rows")
        rows = batch_index(rows.withColumn("_batch", F.struct(*batch) if batch else F.lit(0)), ["_batch"], order)
        rows = rows.withColumn("batch_index", F.col("batch_index").cast("string"))
    else:
        rows = rows.withColumn("batch_index", F.lit(None).cast("string"))
    return rows.select(
        "ts",
        F.lit("api").alias("source"),
        F.lit(kind).alias("prediction_type"),
        "batch_index",
        *[F.col(c).cast("double").alias(f"input_{c}") for c in FEATURES if c in scored.columns],
        F.col("prediction").cast("int").alias("prediction"),
        "probability",
        "risk_level",
        "confidence",
        "model_version",
    )


def append_predictions(
    scored: DataFrame,
    path: str,
    kind: str,
    run_id: str,
    ts=None,
    batch: Sequence[str] = (),
    order: Sequence[str] = (),
) -> None:
    """Add one scoring run to the prediction log, partitioned by date."""
    rows = prediction_rows(scored, kind, ts, batch, order)
    rows.withColumn("date", F.to_date("ts")).hint("rebalance", "date").write.mode("overwrite").partitionBy(
        "date"
    ).parquet(f"{path}/run_id={run_id}")
