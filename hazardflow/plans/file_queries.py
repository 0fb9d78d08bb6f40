"""Files and tables: written by Spark from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardflow.functions import scalar
from hazardflow.models import registry
from hazardflow.operators import clean, quality
from hazardflow.operators.profile import profile
from hazardflow.plans.quality_queries import CLEAN_CTE
from hazardflow.plans.registry import query
from hazardflow.plans.score_queries import RUNS_SQL, STAGES_SQL, _runs, _stages
from hazardflow.plans.views import DIRTY_SQL, EVENTS_SQL, SCORED_SQL, dirty, events, scored, table
from hazardflow.reports import report
from hazardflow.schema import EXTRA_CELL, FILE_KEY
from hazardflow.session import scratch_path
from hazardflow.sources import points as pts
from hazardflow.sources import readers, writers


def _event_files(spark, sf):
    """All dirty events as CSV, one folder per event type, the columns of purchases fewer."""
    folder = scratch_path(spark, "csv")
    rows = dirty(spark, sf).drop(FILE_KEY).withColumn("kind", F.coalesce("event_type", F.lit("none")))
    for name, part in (("full", rows.where("kind <> 'purchase'")), ("short", rows.where("kind = 'purchase'").drop("level", "k"))):
        part.hint("rebalance", "kind").write.partitionBy("kind").option("header", True).csv(f"{folder}/{name}")
    return readers.read_csv_files(spark, f"{folder}/*/kind=*")


def _kind(path):
    return F.regexp_extract(path, r"kind=([^/]+)/", 1)


@query(
    "csv_roundtrip",
    f"""WITH {DIRTY_SQL} SELECT coalesce(event_type, 'none') AS kind, event_id, user_id, value,
        CASE WHEN event_type IS DISTINCT FROM 'purchase' THEN k END AS k,
        CASE WHEN event_type IS DISTINCT FROM 'purchase' THEN level END AS level, event_type FROM dirty""",
)
def csv_roundtrip(spark, sf):
    rows, _ = _event_files(spark, sf)
    return readers.drop_index_column(rows).select(
        _kind(F.col(FILE_KEY)).alias("kind"),
        F.col("event_id").try_cast("bigint").alias("event_id"),
        F.col("user_id").try_cast("bigint").alias("user_id"),
        scalar.as_number(F.col("value")).alias("value"),
        F.col("k").try_cast("bigint").alias("k"),
        F.col("level").try_cast("int").alias("level"),
        "event_type",
    )


@query(
    "csv_mixed_headers",
    f"""WITH {DIRTY_SQL},
        s AS (SELECT coalesce(event_type, 'none') AS kind, count(*) AS rows,
                     CAST(sum(CAST(value IS NULL AS INT) + CAST(event_type IS NULL AS INT) + CAST(level IS NULL AS INT)) AS BIGINT) AS missing
              FROM dirty GROUP BY 1)
        SELECT kind, rows, missing AS missing_total, CASE WHEN kind = 'purchase' THEN 5 ELSE 7 END AS column_count,
               CASE WHEN kind = 'none' THEN 'event_type,level' ELSE '' END AS empty_columns,
               CASE WHEN kind = 'purchase' THEN 'level' ELSE '' END AS missing_columns,
               CASE WHEN kind = 'none' THEN 'event_id,k,user_id,value,level,event_type' WHEN kind = 'purchase' THEN 'event_id,user_id,value'
                    ELSE 'event_id,k,level,user_id,value' END AS numeric_columns FROM s""",
)
def csv_mixed_headers(spark, sf):
    """Validation per file; the parts of one kind are folded into one row."""
    rows, files = _event_files(spark, sf)
    checked = quality.validate_files(rows, files, required=["value", "level"], features=["value"])
    order = F.array(*[F.lit(c) for c in ("event_id", "k", "user_id", "value", "level", "event_type")])
    numeric = F.when(
        F.size("empty_columns") > 0, F.array_intersect(order, "numeric_columns")
    ).otherwise(F.sort_array("numeric_columns"))
    return checked.groupBy(_kind(F.col(FILE_KEY)).alias("kind")).agg(
        F.sum("rows").alias("rows"),
        F.sum("missing_total").alias("missing_total"),
        F.max("column_count").alias("column_count"),
        F.max(F.array_join("empty_columns", ",")).alias("empty_columns"),
        F.max(F.array_join("missing_columns", ",")).alias("missing_columns"),
        F.max(F.array_join(numeric, ",")).alias("numeric_columns"),
    )


@query(
    "file_profile",
    f"""WITH {DIRTY_SQL}, f AS (SELECT *, coalesce(event_type, 'none') AS kind FROM dirty)
        SELECT kind, 'value' AS "column", count(*) AS rows, count(*) - count(value) AS missing, 'float64' AS data_type FROM f GROUP BY kind
        UNION ALL SELECT kind, 'user_id', count(*), 0, 'int64' FROM f GROUP BY kind
        UNION ALL SELECT kind, 'ts', count(*), 0, 'object' FROM f GROUP BY kind""",
)
def file_profile(spark, sf):
    rows, _ = _event_files(spark, sf)
    kinds = rows.withColumn(FILE_KEY, _kind(F.col(FILE_KEY))).drop(EXTRA_CELL)
    return (
        profile(kinds.select(FILE_KEY, "value", "user_id", "ts"))
        .select(F.col(FILE_KEY).alias("kind"), "column", "rows", "missing", "data_type")
    )


@query(
    "file_sizes",
    f"""WITH {EVENTS_SQL} SELECT _file, CAST(sum(strlen(event_id || ';' || event_type) + 1) AS BIGINT) AS bytes FROM ev GROUP BY 1""",
)
def file_sizes(spark, sf):
    """Bytes of the listed files, one line per event."""
    folder = scratch_path(spark, "sizes")
    lines = events(spark, sf).select(FILE_KEY, F.concat_ws(";", "event_id", "event_type").alias("line"))
    lines.hint("rebalance", FILE_KEY).write.partitionBy(FILE_KEY).text(folder)
    listed = readers.list_inputs(spark, f"{folder}/*", ".TXT")
    return listed.groupBy(F.regexp_extract("path", rf"{FILE_KEY}=([^/]+)/", 1).alias(FILE_KEY)).agg(F.sum("bytes").alias("bytes"))


@query(
    "clean_files",
    f"""WITH {CLEAN_CTE} SELECT replace(_file, '.csv', '') || '_preprocessed_20240201_000000' AS output_name,
        rows_after AS rows FROM clean_stats""",
)
def clean_files(spark, sf):
    """Clean every day, write one output per day, read the outputs back and count them."""
    folder = scratch_path(spark, "clean")
    cleaned, _ = clean.clean_table(dirty(spark, sf), ["value", "k"], "level")
    written = writers.write_clean(cleaned, folder, "20240201_000000")
    rows, _ = readers.read_csv_files(spark, f"{folder}/layout=*/output_name=*")
    counts = rows.groupBy(F.regexp_extract(FILE_KEY, r"output_name=([^/]+)/", 1).alias("output_name")).agg(
        F.count("*").alias("rows")
    )
    return counts.join(written.where("output_bytes > 0").select("output_name"), "output_name")


@query(
    "parquet_run",
    f"WITH {SCORED_SQL} SELECT event_id, ts, probability, risk_level, DATE '2024-02-01' AS run_date FROM scored",
)
def parquet_run(spark, sf):
    folder = scratch_path(spark, "runs")
    rows = scored(spark, sf).select("event_id", "ts", "probability", "risk_level")
    writers.write_run(rows, folder, "2024-02-01")
    return readers.read_table(spark, folder).select(
        "event_id", "ts", "probability", "risk_level", F.col("run_date").cast("date").alias("run_date")
    )


def _write_points(spark, sf):
    folder = scratch_path(spark, "points")
    rows = events(spark, sf).select(FILE_KEY, "ts", "event_type", "value", "k")
    stored = writers.write_points(pts.to_points(rows, "sensors", "ts"), folder, "r1", batch=100)
    return folder, stored


@query(
    "points_stored",
    f"""WITH {EVENTS_SQL} SELECT _file, count(*) AS points, CAST(ceil(count(*) / 100) AS BIGINT) AS batches,
        'success' AS status FROM ev GROUP BY _file""",
)
def points_stored(spark, sf):
    return _write_points(spark, sf)[1]


@query(
    "points_recent",
    f"""WITH {EVENTS_SQL}, r AS (SELECT * FROM ev WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR
          AND ts <= TIMESTAMP '2024-01-20 12:00:00')
        SELECT ts, 'sensors' AS measurement, 'value' AS field, value FROM r
        UNION ALL SELECT ts, 'sensors', 'k', CAST(k AS DOUBLE) FROM r""",
)
def points_recent(spark, sf):
    folder, _ = _write_points(spark, sf)
    out = readers.read_points(spark, folder, "sensors", ["value", "k"], "2024-01-20 12:00:00")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _write_log(spark, sf):
    folder = scratch_path(spark, "log")
    rows = scored(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        FILE_KEY,
        F.col("value").alias("Energy_Unit_log"),
        "prediction",
        "probability",
        "risk_level",
        "confidence",
        F.lit("v1.0.0").alias("model_version"),
    )
    writers.append_predictions(rows, folder, "batch", "r1", batch=[FILE_KEY], order=["ts", "event_id"])
    return folder


@query(
    "prediction_log",
    f"""WITH {SCORED_SQL} SELECT ts, 'api' AS source, 'batch' AS prediction_type,
        CAST(row_number() OVER (PARTITION BY _file ORDER BY ts, event_id) - 1 AS VARCHAR) AS batch_index,
        value AS "input_Energy_Unit_log", prediction, probability, risk_level, confidence, 'v1.0.0' AS model_version FROM scored""",
)
def prediction_log(spark, sf):
    log = readers.read_table(spark, _write_log(spark, sf)).drop("date", "run_id")
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "prediction_log_recent",
    f"""WITH {SCORED_SQL}, now AS (SELECT TIMESTAMP '2024-01-30 00:00:00' AS t)
        SELECT risk_level, count(*) AS rows FROM scored, now WHERE ts > t - INTERVAL 24 HOUR AND ts <= t GROUP BY 1""",
)
def prediction_log_recent(spark, sf):
    log = readers.read_predictions(spark, _write_log(spark, sf), "2024-01-30 00:00:00")
    return log.groupBy("risk_level").agg(F.count("*").alias("rows"))


@query(
    "feedback_since",
    f"""WITH {EVENTS_SQL} SELECT count(*) AS feedback_count, TIMESTAMP '2024-01-10' AS start_date, TIMESTAMP '2024-01-20' AS end_date
        FROM ev WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""",
)
def feedback_since(spark, sf):
    folder = scratch_path(spark, "feedback")
    feedback = events(spark, sf).select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.encode(F.col("value").cast("string"), "utf-8").alias("sensor_data"),
        F.col("level").alias("predicted_class"),
        F.pmod("k", F.lit(3)).cast("int").alias("corrected_class"),
        F.concat(F.lit("eng"), "user_id").alias("engineer_id"),
    )
    writers.write_run(feedback, folder, "2024-02-01")
    rows = readers.read_feedback(spark, folder, "2024-01-10", "2024-01-20")
    out = readers.feedback_summary(rows, "2024-01-10", "2024-01-20")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_date", "end_date")})


@query(
    "json_report",
    f"""WITH {STAGES_SQL} SELECT count(*) AS files, CAST(sum(rows_before) AS BIGINT) AS rows_before,
        '1.0.0' AS report_version, 'data_quality,data_completeness' AS advice, 6 AS actions FROM stages""",
)
def json_report(spark, sf):
    """The run report written as JSON and read back."""
    folder = scratch_path(spark, "report")
    stages = _stages(spark, sf)
    validation = stages.agg(
        F.lit(1).alias("files_with_warnings"), F.lit(1).cast("bigint").alias("total_missing_values"),
        F.sum("rows_before").alias("total_rows"),
    )
    head = report.quality_report(validation, report.ingest_summary(stages), "2024-02-01 00:00:00")
    writers.write_report(head, f"{folder}/head")
    writers.write_report(report.stage_report(stages), f"{folder}/stages")
    files = spark.read.schema(f"{FILE_KEY} string").json(f"{folder}/stages")
    back = spark.read.schema(head.schema).json(f"{folder}/head")
    return back.select(
        F.lit(files.count()).cast("bigint").alias("files"),
        F.col("validation_summary.total_rows").alias("rows_before"),
        F.col("report_metadata.report_version").alias("report_version"),
        F.array_join(F.transform("recommendations", lambda r: r["category"]), ",").alias("advice"),
        F.size("next_actions").alias("actions"),
    )


@query(
    "retrain_report",
    f"""WITH {RUNS_SQL} SELECT CAST(day AS VARCHAR) AS execution_date, accuracy, train_size,
        CASE WHEN accuracy - 0.26 >= 0.01 - 1e-9 THEN 'deployed' ELSE 'skipped' END AS status FROM runs
        WHERE day = DATE '2024-01-15'""",
)
def retrain_report(spark, sf):
    folder = scratch_path(spark, "retrain")
    decided = registry.promote(registry.gate(_runs(spark, sf), F.lit(0.26)))
    runs = decided.withColumns({"f1": F.col("accuracy"), "val_size": F.lit(0)})
    writers.write_report(report.retrain_report(runs, "2024-01-15"), folder)
    schema = "execution_date string, model_training struct<accuracy:double,train_size:bigint>, deployment struct<status:string>"
    return spark.read.schema(schema).json(folder).select(
        "execution_date", "model_training.accuracy", "model_training.train_size", "deployment.status"
    )
