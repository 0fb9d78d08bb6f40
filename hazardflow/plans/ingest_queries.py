"""The ingestion job over real files, good and bad, and the reading of records in many splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardflow.plans import flows
from hazardflow.plans.registry import query
from hazardflow.plans.score_queries import SENSOR_CTE
from hazardflow.plans.views import EVENTS_SQL, events, sensor
from hazardflow.schema import FEATURES, FILE_KEY, REQUIRED, TARGET
from hazardflow.session import scratch_path
from hazardflow.sources import readers

# What the lines of a file look like, by its kind.
KINDS = ["plain", "blank", "quoted", "index", "text", "long", "header", "open"]
HEADER = ",".join(REQUIRED)
HEADS = {"blank": ["", " \t", HEADER], "quoted": [f'"the\nnote",{HEADER}'], "index": [f",{HEADER}"]}
LAST = {"open": ['"never closed']}


def _sensor_files(spark, sf):
    """Two files per kind from all readings, as text: blank first lines, quoted line breaks, an index
    column, text in a feature, rows longer than the header, headers alone, quotes that never close."""
    folder = scratch_path(spark, "inbox")
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = sensor(spark, sf).withColumns(
        {"kind": F.get(names, F.pmod("user_id", F.lit(len(KINDS))).cast("int")), "half": F.dayofmonth("day") % 2}
    )
    duration = F.when((F.col("kind") == "text") & (F.dayofmonth("day") % 3 == 0), F.lit("abc")).otherwise(F.col("Duration_days").cast("string"))
    cells = F.concat_ws(",", duration, *[F.col(c).cast("string") for c in REQUIRED[1:]])
    line = (
        F.when(F.col("kind") == "quoted", F.concat(F.lit('"of\n""two"" lines",'), cells))
        .when(F.col("kind") == "index", F.concat_ws(",", F.col("user_id").cast("string"), cells))
        .when(F.col("kind") == "long", F.concat(cells, F.lit(",9")))
        .otherwise(cells)
    )
    body = rows.where("kind <> 'header'").select("kind", "half", F.lit(1).alias("place"), line.alias("value"))
    frames = F.create_map(*[F.lit(x) for k in KINDS for x in (k, "\x00".join(HEADS.get(k, [HEADER])))])
    ends = F.create_map(*[F.lit(x) for k in KINDS for x in (k, "\x00".join(LAST.get(k, [])))])
    files = rows.select("kind", "half").distinct()
    heads = files.select("kind", "half", F.lit(0).alias("place"), F.explode(F.split(F.element_at(frames, F.col("kind")), "\x00")).alias("value"))
    tails = files.where(F.col("kind").isin(list(LAST))).select("kind", "half", F.lit(2).alias("place"), F.explode(F.split(F.element_at(ends, F.col("kind")), "\x00")).alias("value"))
    lines = body.unionByName(heads).unionByName(tails)
    lines.repartition("kind", "half").sortWithinPartitions("kind", "half", "place").drop("place").write.partitionBy("kind", "half").text(folder)
    return folder


def _file_of(column):
    return (
        F.regexp_extract(column, "kind=([^/]+)/", 1).alias("kind"),
        F.regexp_extract(column, "half=([^/]+)/", 1).cast("bigint").alias("half"),
    )


_DISTINCT = ", ".join([*FEATURES[1:], TARGET])
INGEST_SQL = f"""{SENSOR_CTE},
named AS (SELECT *, list_extract([{", ".join(f"'{k}'" for k in KINDS)}], CAST(user_id % {len(KINDS)} AS INT) + 1) AS kind, dayofmonth(day) % 2 AS half FROM sensor),
told AS (SELECT *, CASE WHEN kind = 'text' AND dayofmonth(day) % 3 = 0 THEN 'abc' ELSE CAST(Duration_days AS VARCHAR) END AS duration FROM named),
counted AS (
  SELECT kind, half, count(*) FILTER (kind <> 'header') AS n, count(*) FILTER (duration = 'abc') AS coerced,
    count(DISTINCT (CASE WHEN kind = 'index' THEN user_id END, duration, {_DISTINCT})) FILTER (kind <> 'header') AS different
  FROM told GROUP BY kind, half),
stages AS (
  SELECT kind, half, CASE WHEN kind IN ('long', 'open') THEN 'error' ELSE 'ok' END AS status,
    CASE kind WHEN 'long' THEN 'a row has more cells than the header' WHEN 'open' THEN 'EOF inside a quoted cell' END AS error,
    CASE WHEN kind NOT IN ('long', 'open') THEN n END AS rows,
    CASE WHEN kind IN ('quoted', 'index') THEN 10 WHEN kind NOT IN ('long', 'open') THEN 9 END AS columns,
    CASE WHEN kind IN ('quoted', 'index') THEN CASE kind WHEN 'quoted' THEN 'the' || chr(10) || 'note' ELSE 'Unnamed: 0' END ELSE '' END AS extra,
    CASE WHEN kind = 'text' AND coerced > 0 THEN 'Duration_days' WHEN kind = 'header' THEN '{",".join(FEATURES)}' ELSE '' END AS non_numeric,
    CASE WHEN kind NOT IN ('long', 'open') THEN different END AS rows_after,
    CASE WHEN kind NOT IN ('long', 'open') THEN n - different END AS duplicates_removed,
    CASE WHEN kind NOT IN ('long', 'open') THEN coerced END AS coerced,
    CASE WHEN kind NOT IN ('long', 'open') THEN different END AS points
  FROM counted)"""


@query("ingest_run", f"WITH {INGEST_SQL} SELECT * REPLACE (CASE WHEN status = 'ok' THEN extra END AS extra, CASE WHEN status = 'ok' THEN non_numeric END AS non_numeric) FROM stages")
def ingest_run(spark, sf):
    """One row per file with what validation, cleaning and storage made of it."""
    out = flows.ingest(spark, f"{_sensor_files(spark, sf)}/*/*", scratch_path(spark, "lake"), "r1", "2024-02-01 00:00:00", suffix=".txt")
    ok = F.col("status") == "ok"
    return out["stages"].select(
        *_file_of(F.col(FILE_KEY)),
        "status",
        "error",
        F.when(ok, F.col("rows")).alias("rows"),
        F.when(ok, F.col("column_count")).alias("columns"),
        F.when(ok, F.array_join("extra_columns", ",")).alias("extra"),
        F.when(ok, F.array_join("non_numeric_required", ",")).alias("non_numeric"),
        "rows_after",
        "duplicates_removed",
        "coerced",
        "points",
    )


@query(
    "ingest_run_report",
    f"""WITH {INGEST_SQL}, s AS (
          SELECT count(*) AS files_found, count(*) FILTER (status = 'ok') AS files_validated, count(*) FILTER (status = 'ok') AS files_cleaned,
            count(*) FILTER (status = 'ok') AS files_stored, CAST(sum(points) AS BIGINT) AS records, CAST(sum(rows) AS BIGINT) AS total_rows,
            round(count(*) FILTER (status = 'ok') * 100 / count(*), 2) AS success_rate,
            round(sum(duplicates_removed) * 100 / sum(rows), 2) AS reduction FROM stages)
        SELECT * EXCLUDE (reduction), reduction AS data_reduction_pct,
          'data_quality' || CASE WHEN reduction > 20 THEN ',data_efficiency' ELSE '' END AS advice,
          CASE WHEN success_rate = 100 THEN 'Data is ready for feature engineering' ELSE 'Review failed file processing logs' END AS first_action,
          6 AS actions FROM s""",
)
def ingest_run_report(spark, sf):
    """The report of the run, fed from its stage tables and read back from JSON."""
    lake = scratch_path(spark, "lake")
    out = flows.ingest(spark, f"{_sensor_files(spark, sf)}/*/*", lake, "r1", "2024-02-01 00:00:00", suffix=".txt")
    head = spark.read.schema(out["report"].schema).json(f"{lake}/reports/run_id=r1/head")
    run = [F.col(f"execution_summary.{c}").alias(c) for c in ("files_found", "files_validated", "files_cleaned", "files_stored", "records", "success_rate", "data_reduction_pct")]
    return head.select(
        *run,
        F.col("validation_summary.total_rows").alias("total_rows"),
        F.array_join(F.transform("recommendations", lambda r: r["category"]), ",").alias("advice"),
        F.get("next_actions", F.lit(0)).alias("first_action"),
        F.size("next_actions").alias("actions"),
    )


@query(
    "csv_split_records",
    f"""WITH {EVENTS_SQL} SELECT event_id, event_type || chr(10) || '"' || user_id || '"' AS note, CAST(k AS VARCHAR) || '" wide' AS size FROM ev""",
)
def csv_split_records(spark, sf):
    """Every event with a line break and quotes in one cell and a bare quote in another, read in splits of 16 KB."""
    folder = scratch_path(spark, "quoted")
    note = F.concat(F.lit('"'), "event_type", F.lit('\n""'), F.col("user_id").cast("string"), F.lit('"""'))
    line = F.concat_ws(",", F.col("event_id").cast("string"), note, F.concat(F.col("k").cast("string"), F.lit('" wide')))
    rows = events(spark, sf).select(F.lit(1).alias("place"), line.alias("value"), F.pmod("event_id", F.lit(3)).alias("file"))
    heads = rows.select("file").distinct().select(F.lit(0).alias("place"), F.lit('event_id,"note",size').alias("value"), "file")
    rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "place").drop("place").write.partitionBy("file").text(folder)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 10))
    small.conf.set("spark.sql.files.openCostInBytes", "0")
    small.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    read, _ = readers.read_csv_files(small, f"{folder}/*", suffix=".txt")
    path = scratch_path(spark, "records")
    read.select(F.col("event_id").cast("bigint").alias("event_id"), "note", "size").write.parquet(path)
    return spark.read.parquet(path)
