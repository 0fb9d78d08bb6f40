"""Streams over the event files, run until the files are read, beside their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.plans.registry import query
from hazardflow.plans.score_queries import VALUE_BOUNDS
from hazardflow.plans.views import DIRTY_SQL, EVENTS_SQL, SCORED_SQL, dirty, shaped_events, table, with_scores
from hazardflow.session import scratch_path
from hazardflow.streaming import late, streams

LATE = "1 hour"
# A window is final once the watermark has passed its end.
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    # A pattern, since a stream source takes a folder or a pattern but no single file.
    rows = shaped_events(streams.ingest_stream(spark, f"{sf}/events.parque[t]", schema))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream to its end and read its table."""
    folder = scratch_path(spark, name)
    streams.run_to_table(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def _naive(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_ingest", f"WITH {EVENTS_SQL} SELECT event_id, ts, event_type, value, k FROM ev")
def stream_ingest(spark, sf):
    rows = _event_stream(spark, sf).select("event_id", "ts", "event_type", "value", "k")
    return _naive(_finished(spark, rows, "ingest"), "ts")


@query(
    "stream_quarantine",
    f"""WITH {EVENTS_SQL} SELECT event_id, value, k, concat_ws(',',
          CASE WHEN value BETWEEN 0.1 AND 300 THEN NULL ELSE 'value' END,
          CASE WHEN k BETWEEN 0 AND 95 THEN NULL ELSE 'k' END) AS violations FROM ev""",
)
def stream_quarantine(spark, sf):
    """Good and rejected rows of the stream, put together again."""
    folder = scratch_path(spark, "quarantine")
    rows = _event_stream(spark, sf).select("event_id", "value", "k")
    good, bad = f"{folder}/good", f"{folder}/bad"
    streams.validate_stream(rows, good, bad, f"{folder}/checkpoint", VALUE_BOUNDS).awaitTermination()
    columns = ["event_id", "value", "k"]
    accepted = spark.read.parquet(good).select(*columns, F.lit("").alias("violations"))
    rejected = spark.read.parquet(bad).select(*columns, F.array_join("violations", ",").alias("violations"))
    return accepted.unionByName(rejected)


@query(
    "stream_alerts",
    f"WITH {SCORED_SQL} SELECT event_id, ts, probability, risk_level FROM scored WHERE probability >= 0.7",
)
def stream_alerts(spark, sf):
    folder = scratch_path(spark, "alerts")
    rows = with_scores(_event_stream(spark, sf)).select("event_id", "ts", "probability", "risk_level")
    streams.alerts(rows, 0.7, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return _naive(spark.read.parquet(f"{folder}/table"), "ts")


@query(
    "stream_quality_alerts",
    f"""WITH {DIRTY_SQL}, c AS (
          SELECT date_trunc('day', ts) AS window_start, event_type, value, k, count(*) AS n FROM dirty GROUP BY ALL),
        w AS (SELECT window_start, CAST(sum(n) AS BIGINT) AS rows,
               round(sum(n * (CAST(value IS NULL AS INT) + CAST(event_type IS NULL AS INT))) * 100 / (sum(n) * 3), 2) AS missing_pct,
               CAST(sum(n - 1) AS BIGINT) AS duplicates FROM c GROUP BY 1)
        SELECT * FROM w WHERE (missing_pct > 3 OR duplicates > 0) AND window_start + INTERVAL 1 DAY <= {CLOSED}""",
)
def stream_quality_alerts(spark, sf):
    folder = scratch_path(spark, "dirty")
    columns = ["event_type", "value", "k"]
    dirty(spark, sf).select("ts", *columns).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    rows = streams.ingest_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    streams.quality_alerts(rows, columns, f"{folder}/out", f"{folder}/checkpoint", missing_pct=3).awaitTermination()
    return _naive(spark.read.parquet(f"{folder}/out"), "window_start")


def _window_sql(width: str, starts: str) -> str:
    return f"""WITH {SCORED_SQL}, w AS (SELECT *, {starts} AS window_start FROM scored)
        SELECT window_start, window_start + INTERVAL {width} AS window_end, count(*) AS predictions,
               count(*) FILTER (WHERE risk_level = 'High') AS high_risk, round(avg(probability), 4) AS average_probability,
               count(*) FILTER (WHERE risk_level = 'Low') AS risk_low, count(*) FILTER (WHERE risk_level = 'Medium') AS risk_medium,
               count(*) FILTER (WHERE risk_level = 'High') AS risk_high, count(*) FILTER (WHERE risk_level = 'Intense') AS risk_intense
        FROM w GROUP BY window_start HAVING window_start + INTERVAL {width} <= {CLOSED}"""


@query("stream_window_risk", _window_sql("1 HOUR", "date_trunc('hour', ts)"))
def stream_window_risk(spark, sf):
    out = streams.risk_windows(with_scores(_event_stream(spark, sf)), "1 hour", late=LATE)
    done = _finished(spark, out, "windows")
    return _naive(done, "window_start", "window_end").withColumn("average_probability", F.round("average_probability", 4))


@query(
    "stream_sliding_risk",
    _window_sql("24 HOUR", "unnest([date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6 - i) FOR i IN [0, 1, 2, 3]])"),
)
def stream_sliding_risk(spark, sf):
    """The last 24 hours, refreshed every 6."""
    out = streams.risk_windows(with_scores(_event_stream(spark, sf)), "24 hours", "6 hours", LATE)
    done = _finished(spark, out, "sliding")
    return _naive(done, "window_start", "window_end").withColumn("average_probability", F.round("average_probability", 4))


@query("stream_dedupe", f"WITH {DIRTY_SQL} SELECT DISTINCT event_id, ts, k FROM dirty")
def stream_dedupe(spark, sf):
    """Copies of an event carry its time, so they always meet inside the watermark."""
    rows = _event_stream(spark, sf)
    copies = F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    k = F.when(F.col("event_id") % 23 == 0, 0).otherwise(F.col("k")).alias("k")
    repeated = rows.select("event_id", "ts", k, copies.alias("copy")).drop("copy")
    return _naive(_finished(spark, streams.dedupe_stream(repeated, ["event_id"], LATE), "dedupe"), "ts")


@query(
    "stream_sensor_windows",
    f"""WITH {EVENTS_SQL} SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
        count(*) AS rows, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most
        FROM ev GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""",
)
def stream_sensor_windows(spark, sf):
    out = streams.sensor_windows(_event_stream(spark, sf), "event_type", "value", size="1 hour", late=LATE)
    done = _finished(spark, out, "sensors").withColumns({c: F.round(c, 4) for c in ("total", "mean")})
    return _naive(done, "window_start", "window_end")


@query(
    "stream_sessions",
    f"""WITH {EVENTS_SQL},
        g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM ev
              WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS rows,
               round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most
        FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}""",
)
def stream_sessions(spark, sf):
    out = streams.sensor_windows(_event_stream(spark, sf), "user_id", "value", gap="2 hours", late=LATE)
    done = _finished(spark, out, "sessions").withColumns({c: F.round(c, 4) for c in ("total", "mean")})
    return _naive(done, "window_start", "window_end")


ARRIVALS_SQL = """arrived AS (SELECT event_id, event_type, ts, event_id % 3 AS arrival FROM events),
tops AS (SELECT event_type, arrival, max(ts) AS top FROM arrived GROUP BY ALL),
judged AS (
  SELECT a.*, (SELECT max(top) FROM tops t WHERE t.event_type = a.event_type AND t.arrival < a.arrival) - INTERVAL 10 DAY AS late_before
  FROM arrived a)"""


def _arrivals(spark, sf):
    """All events in three arrivals, each read by one run of the stream; late are rows ten days behind their type."""
    folder = scratch_path(spark, "late")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for arrival in range(3):
        rows.where(F.col("event_id") % 3 == arrival).write.parquet(f"{folder}/in/arrival={arrival}")
        stream = streams.ingest_stream(spark, f"{folder}/in/*", rows.schema)
        late.split_late(stream, ["event_type"], folder, f"{folder}/checkpoint", "10 DAYS").awaitTermination()
    return folder


@query(
    "stream_late_rows",
    f"""WITH {ARRIVALS_SQL} SELECT event_id, event_type, ts, late_before, arrival FROM judged WHERE ts < late_before""",
)
def stream_late_rows(spark, sf):
    """The rows of the side table, with the limit that they missed."""
    found = spark.read.parquet(f"{_arrivals(spark, sf)}/late").withColumnsRenamed({"limit": "late_before"})
    return _naive(found, "ts", "late_before").withColumn("arrival", F.col("batch").cast("bigint")).drop("batch")


@query(
    "stream_rows_in_time",
    f"""WITH {ARRIVALS_SQL} SELECT event_type, arrival, count(*) AS rows, max(ts) AS newest FROM judged
        WHERE late_before IS NULL OR ts >= late_before GROUP BY ALL""",
)
def stream_rows_in_time(spark, sf):
    rows = _naive(spark.read.parquet(f"{_arrivals(spark, sf)}/rows"), "ts")
    return rows.groupBy("event_type", F.col("batch").cast("bigint").alias("arrival")).agg(F.count("*").alias("rows"), F.max("ts").alias("newest"))
