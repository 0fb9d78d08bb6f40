"""Scalar rules, joins, aggregates, windows and metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardflow.functions import scalar
from hazardflow.models import registry, score, train
from hazardflow.operators import metrics, numbering, profile, relate, split
from hazardflow.operators.lookup import attach
from hazardflow.plans.registry import query
from hazardflow.plans.views import (
    EVENTS_SQL,
    PRED_SQL,
    SCORED_SQL,
    events,
    predicted,
    scored,
    sensor,
    sensor_sql,
    table,
)
from hazardflow.reports import report
from hazardflow.schema import CLASS_NAMES, FEATURES, FILE_KEY, HAZARD_WEIGHTS, TARGET
from hazardflow.session import written
from hazardflow.sources import points as pts

SENSOR_CTE = EVENTS_SQL + sensor_sql("ev")
VALUE_BOUNDS = {"value": (0.1, 300.0), "k": (0.0, 95.0)}


@query(
    "risk_by_day",
    f"""WITH {SCORED_SQL}
        SELECT CAST(ts AS DATE) AS day, count(*) AS total_predictions,
               count(*) FILTER (WHERE prediction = 1) AS total_high_risk,
               count(*) FILTER (WHERE prediction = 0) AS total_low_risk,
               round(avg(round(probability, 4)), 4) AS average_probability, round(avg(round(confidence, 4)), 4) AS average_confidence,
               count(*) FILTER (WHERE risk_level = 'Low') AS risk_low,
               count(*) FILTER (WHERE risk_level = 'Medium') AS risk_medium,
               count(*) FILTER (WHERE risk_level = 'High') AS risk_high,
               count(*) FILTER (WHERE risk_level = 'Intense') AS risk_intense
        FROM scored WHERE value BETWEEN 0.1 AND 300 AND k BETWEEN 0 AND 95 GROUP BY 1""",
)
def risk_by_day(spark, sf):
    """Range check, risk levels and the batch summary of every day."""
    good = profile.range_check(scored(spark, sf), VALUE_BOUNDS).where("valid")
    return score.batch_summary(good.withColumn("day", F.to_date("ts")), by=["day"]).orderBy("day")


@query(
    "risk_levels",
    f"""WITH {SCORED_SQL} SELECT event_id, probability, risk_level,
        confidence, upper(risk_level) || ' RISK' AS text, probability >= 0.7 AS over FROM scored""",
)
def risk_levels(spark, sf):
    return scored(spark, sf).select(
        "event_id",
        "probability",
        "risk_level",
        "confidence",
        scalar.risk_text(F.col("risk_level")).alias("text"),
        scalar.over_threshold(F.col("probability")).alias("over"),
    )


@query(
    "class_names",
    f"""WITH {EVENTS_SQL} SELECT event_id, level, CASE level WHEN 0 THEN 'None' WHEN 1 THEN 'Low'
        WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' END AS name FROM ev""",
)
def class_names(spark, sf):
    return events(spark, sf).select(
        "event_id", "level", scalar.class_name(F.col("level"), CLASS_NAMES).alias("name")
    )


_HAZARD = " + ".join(f"{w} * ({c} / max({c}) OVER ())" for c, w in HAZARD_WEIGHTS.items())


@query("hazard_index", f"WITH {SENSOR_CTE} SELECT sensor_id, round({_HAZARD}, 6) AS hazard FROM sensor")
def hazard_index(spark, sf):
    out = relate.hazard_index(sensor(spark, sf), HAZARD_WEIGHTS)
    return out.select("sensor_id", F.round("hazard", 6).alias("hazard"))


@query(
    "cut_bins",
    f"""WITH {SENSOR_CTE}, h AS (SELECT sensor_id, {_HAZARD} AS hazard FROM sensor)
        SELECT CASE WHEN hazard <= 0.15 THEN 0 WHEN hazard <= 0.3 THEN 1 ELSE 2 END AS bin, count(*) AS rows
        FROM h GROUP BY 1""",
)
def cut_bins(spark, sf):
    out = relate.hazard_index(sensor(spark, sf), HAZARD_WEIGHTS)
    bins = scalar.cut(F.col("hazard"), [0.15, 0.3], [0, 1, 2]).alias("bin")
    return out.groupBy(bins).agg(F.count("*").alias("rows"))


@query(
    "align_features",
    f"""WITH {EVENTS_SQL} SELECT event_id, 0.0::DOUBLE AS Duration_days, k, 0.0::DOUBLE AS Volume_m3_sqr, value FROM ev""",
)
def align_features(spark, sf):
    return relate.align_features(events(spark, sf), ["event_id", "Duration_days", "k", "Volume_m3_sqr", "value"])


@query(
    "projections",
    """SELECT p_partkey AS part, p_brand AS brand, p_retailprice AS price, 'v1' AS version FROM part
       WHERE p_size IN (1, 5, 9) ORDER BY p_retailprice DESC""",
)
def projections(spark, sf):
    return (
        table(spark, sf, "part")
        .where(F.col("p_size").isin(1, 5, 9))
        .withColumn("version", F.lit("v1"))
        .withColumnsRenamed({"p_partkey": "part", "p_brand": "brand", "p_retailprice": "price"})
        .orderBy(F.desc("price"))
        .select("part", "brand", "price", "version")
    )


@query(
    "time_texts",
    """SELECT event_id, strftime(ts, '%H:%M') AS clock, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
              strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, ts - INTERVAL 2 HOUR AS utc,
              'batch_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || user_id AS batch FROM events""",
)
def time_texts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        scalar.clock(ts).alias("clock"),
        scalar.stamp(ts).alias("stamp"),
        scalar.iso(ts).alias("iso"),
        scalar.to_naive_utc(ts, "+02:00").cast("timestamp_ntz").alias("utc"),
        scalar.batch_id(ts, F.col("user_id")).alias("batch"),
    )


@query(
    "name_texts",
    f"""WITH {EVENTS_SQL} SELECT event_id, lower(upper(_file)) AS file, replace(_file, '.csv', '') AS stem,
        replace(_file, '.csv', '') || '_preprocessed_' || event_type AS output,
        lower(_file) LIKE '%.csv' AS is_csv, contains(_file, '-01-2') AS twenties FROM ev""",
)
def name_texts(spark, sf):
    name = F.col(FILE_KEY)
    return events(spark, sf).select(
        "event_id",
        F.lower(F.upper(name)).alias("file"),
        scalar.file_stem(name).alias("stem"),
        scalar.output_name(name, F.col("event_type")).alias("output"),
        F.lower(name).endswith(".csv").alias("is_csv"),
        name.contains("-01-2").alias("twenties"),
    )


LONG_SQL = f"""{SCORED_SQL},
points AS (
  SELECT ts, 'prediction' AS field, CAST(prediction AS DOUBLE) AS value FROM scored
  UNION ALL SELECT ts, 'probability', probability FROM scored),
texts AS (SELECT ts, CASE WHEN k < 90 THEN risk_level END AS value FROM scored)"""


def _number_points(spark, sf):
    wide = scored(spark, sf).select("ts", "prediction", "probability")
    return pts.points_long(pts.to_points(wide, "predictions", "ts")).drop("measurement").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def _text_points(spark, sf):
    """Risk texts; those of k >= 90 are missing, so that some times have none."""
    return scored(spark, sf).select("ts", F.when(F.col("k") < 90, F.col("risk_level")).alias("value"))


@query("points_long", f"WITH {LONG_SQL} SELECT ts, field, value FROM points")
def points_long(spark, sf):
    return _number_points(spark, sf)


@query(
    "points_text",
    """SELECT 'sensors,event_type=' || event_type || ',props=' || props || ' event_id=' || CAST(event_id AS DOUBLE)
              || ',user_id=' || CAST(user_id AS DOUBLE) || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS value FROM events""",
)
def points_text(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return pts.points_text(pts.to_points(rows, "sensors", "ts"))


@query(
    "points_pivot",
    f"""WITH {LONG_SQL} SELECT ts, max(CASE WHEN field = 'prediction' THEN value END) AS prediction,
        max(CASE WHEN field = 'probability' THEN value END) AS probability FROM points GROUP BY ts""",
)
def points_pivot(spark, sf):
    return relate.pivot_fields(_number_points(spark, sf), ["prediction", "probability"])


@query(
    "risk_join",
    f"""WITH {LONG_SQL}, wide AS (SELECT ts, CAST(max(CASE WHEN field = 'prediction' THEN value END) AS INT) AS prediction,
          max(CASE WHEN field = 'probability' THEN value END) AS probability FROM points GROUP BY ts),
        last AS (SELECT ts, max(value) AS risk FROM texts GROUP BY ts)
        SELECT DISTINCT ts, prediction, probability, coalesce(risk, 'Unknown') AS risk_level
        FROM wide LEFT JOIN last USING (ts) WHERE prediction IS NOT NULL AND probability IS NOT NULL""",
)
def risk_join(spark, sf):
    wide = relate.pivot_fields(_number_points(spark, sf), ["prediction", "probability"])
    complete = wide.dropna(subset=["prediction", "probability"])
    joined = relate.attach_risk(complete.withColumn("prediction", F.col("prediction").cast("int")), _text_points(spark, sf))
    return joined.select("ts", "prediction", "probability", "risk_level").distinct()


@query(
    "latest_per_key",
    f"""WITH {SCORED_SQL} SELECT user_id, event_id, ts, risk_level FROM scored
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_key(spark, sf):
    rows = scored(spark, sf).select("user_id", "event_id", "ts", "risk_level")
    return relate.latest_per_key(rows, ["user_id"], ["ts", "event_id"])


@query(
    "batch_summary",
    f"""WITH {SCORED_SQL}
        SELECT event_type, count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 1) AS total_high_risk,
               count(*) FILTER (WHERE prediction = 0) AS total_low_risk,
               round(avg(round(probability, 4)), 4) AS average_probability, round(avg(round(confidence, 4)), 4) AS average_confidence,
               count(*) FILTER (WHERE risk_level = 'Low') AS risk_low,
               count(*) FILTER (WHERE risk_level = 'Medium') AS risk_medium,
               count(*) FILTER (WHERE risk_level = 'High') AS risk_high,
               count(*) FILTER (WHERE risk_level = 'Intense') AS risk_intense,
               'batch_20240131_000000_' || count(*) AS batch_id
        FROM scored GROUP BY event_type""",
)
def batch_summary(spark, sf):
    return score.batch_summary(scored(spark, sf), ts="2024-01-31 00:00:00", by=["event_type"])


@query(
    "recent_risk",
    f"""WITH {SCORED_SQL} SELECT count(*) AS predictions, count(*) FILTER (WHERE risk_level = 'High') AS high_risk
        FROM scored WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
)
def recent_risk(spark, sf):
    rows = scored(spark, sf)
    return score.recent_summary(rows, rows.agg(F.max("ts")).scalar())


@query(
    "latest_five",
    f"""WITH {SCORED_SQL} SELECT strftime(ts, '%H:%M') AS "Time", prediction AS "Prediction",
        round(probability, 3) AS "Probability", risk_level AS "Risk Level" FROM scored ORDER BY ts DESC LIMIT 5""",
)
def latest_five(spark, sf):
    return relate.latest(scored(spark, sf), 5).select(
        scalar.clock(F.col("ts")).alias("Time"),
        F.col("prediction").alias("Prediction"),
        F.round("probability", 3).alias("Probability"),
        F.col("risk_level").alias("Risk Level"),
    )


@query("risk_counts", f"WITH {SCORED_SQL} SELECT risk_level, count(*) AS rows FROM scored GROUP BY 1")
def risk_counts(spark, sf):
    return score.risk_counts(scored(spark, sf))


@query(
    "stage_join",
    """SELECT c_custkey, c_name, orders, spent, lines FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)
         ON o_custkey = c_custkey
       LEFT JOIN (SELECT o_custkey AS ck, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
         ON ck = c_custkey
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)""",
)
def stage_join(spark, sf):
    """Customers as files, their orders and lines as later stages, some orders as failures."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counted = orders.groupBy("c_custkey").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    lines = (
        orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"])
        .groupBy("c_custkey")
        .agg(F.sum("n").alias("lines"))
    )
    failed = orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 450000")
    people = table(spark, sf, "customer").select("c_custkey", "c_name")
    return relate.only_ok(relate.join_stages(people, counted, lines, "c_custkey"), failed, "c_custkey")


STAGES_SQL = f"""{EVENTS_SQL},
stages AS (
  SELECT _file, CASE WHEN count(*) < 330 THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN count(*) >= 330 THEN count(*) END AS rows_before,
         CASE WHEN count(*) >= 330 THEN count(*) FILTER (WHERE value > 5) END AS rows_after,
         CASE WHEN count(*) >= 330 THEN count(*) FILTER (WHERE value <= 5) END AS rows_removed,
         CASE WHEN count(*) >= 340 THEN count(*) FILTER (WHERE value > 5) END AS points,
         CASE WHEN count(*) < 345 THEN 'error' ELSE 'success' END AS storage_status
  FROM ev GROUP BY _file)"""


def _stages(spark, sf):
    """One row per day with the outcome of each stage set by the size of the day."""
    n, kept = F.count("*"), F.count_if(F.col("value") > 5)
    return events(spark, sf).groupBy(FILE_KEY).agg(
        F.when(n < 330, "error").otherwise("ok").alias("status"),
        F.when(n >= 330, n).alias("rows_before"),
        F.when(n >= 330, kept).alias("rows_after"),
        F.when(n >= 330, F.count_if(F.col("value") <= 5)).alias("rows_removed"),
        F.when(n >= 340, kept).alias("points"),
        F.when(n < 345, "error").otherwise("success").alias("storage_status"),
    )


@query(
    "ingest_summary",
    f"""WITH {STAGES_SQL}
        SELECT count(*) AS files_found, count(*) FILTER (WHERE status <> 'error') AS files_validated,
               count(rows_before) AS files_cleaned,
               count(*) FILTER (WHERE points IS NOT NULL AND storage_status <> 'error') AS files_stored,
               CAST(sum(points) AS BIGINT) AS records,
               round(count(*) FILTER (WHERE points IS NOT NULL AND storage_status <> 'error') * 100 / count(*), 2) AS success_rate,
               round(sum(rows_removed) * 100 / sum(rows_before), 2) AS data_reduction_pct FROM stages""",
)
def ingest_summary(spark, sf):
    return report.ingest_summary(_stages(spark, sf))


@query(
    "storage_summary",
    f"""WITH {STAGES_SQL}
        SELECT count(*) AS total_files, count(*) FILTER (WHERE storage_status <> 'error') AS successful_files,
               count(*) FILTER (WHERE storage_status = 'error') AS failed_files,
               CAST(sum(points) AS BIGINT) AS total_points,
               round(count(*) FILTER (WHERE storage_status <> 'error') * 100 / count(*), 2) AS completion_rate
        FROM stages WHERE points IS NOT NULL""",
)
def storage_summary(spark, sf):
    stored = _stages(spark, sf).where("points IS NOT NULL").drop("status")
    return report.storage_summary(stored.withColumnRenamed("storage_status", "status"))


@query("accuracy", f"WITH {PRED_SQL} SELECT round(avg(CAST(label = prediction AS INT)), 6) AS accuracy FROM pred")
def accuracy(spark, sf):
    return metrics.accuracy(predicted(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "confusion",
    f"""WITH {PRED_SQL} SELECT label, {", ".join(
        f"count(*) FILTER (WHERE prediction = {c}) AS predicted_{c}" for c in range(4))} FROM pred GROUP BY label""",
)
def confusion(spark, sf):
    return metrics.confusion(predicted(spark, sf), [0, 1, 2, 3])


REPORT_SQL = f"""{PRED_SQL},
counts AS (SELECT c AS class, count(*) FILTER (WHERE label = c) AS support,
                  count(*) FILTER (WHERE prediction = c) AS claimed,
                  count(*) FILTER (WHERE label = c AND prediction = c) AS hits
           FROM pred, (VALUES (0), (1), (2), (3)) v(c) GROUP BY c),
per_class AS (SELECT class, support, hits, coalesce(hits / nullif(claimed, 0), 0) AS precision,
                     coalesce(hits / nullif(support, 0), 0) AS recall,
                     coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1 FROM counts),
rep AS (
  SELECT CAST(class AS VARCHAR) AS name, precision, recall, f1, support FROM per_class
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class)"""


@query(
    "class_report",
    f"""WITH {REPORT_SQL} SELECT name, round(precision, 4) AS precision, round(recall, 4) AS recall,
        round(f1, 4) AS f1, support FROM rep""",
)
def class_report(spark, sf):
    out = metrics.class_report(predicted(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


@query(
    "class_report_text",
    f"""WITH {REPORT_SQL} SELECT name, printf('%12s%10s%10s%10s%10d', name, coalesce(printf('%.2f', precision), ''),
        coalesce(printf('%.2f', recall), ''), printf('%.2f', f1), support) AS line FROM rep""",
)
def class_report_text(spark, sf):
    return metrics.report_text(metrics.class_report(predicted(spark, sf)))


@query("weighted_f1", f"WITH {REPORT_SQL} SELECT round(f1, 6) AS f1 FROM rep WHERE name = 'weighted avg'")
def weighted_f1(spark, sf):
    return metrics.weighted_f1(predicted(spark, sf)).select(F.round("f1", 6).alias("f1"))


@query(
    "class_weights",
    f"""WITH {PRED_SQL} SELECT label, count(*) AS rows,
        round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM pred GROUP BY label""",
)
def class_weights(spark, sf):
    return metrics.class_weights(predicted(spark, sf), "label").withColumn("weight", F.round("weight", 6))


@query(
    "weighted_rows",
    """WITH n AS (SELECT quality, count(*) AS c FROM labels GROUP BY quality)
       SELECT doc_id, l.quality, round((SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * c), 6) AS weight
       FROM labels l JOIN n ON n.quality = l.quality""",
)
def weighted_rows(spark, sf):
    out = train.add_class_weights(table(spark, sf, "labels"), "quality")
    return out.select("doc_id", "quality", F.round("weight", 6).alias("weight"))


_ALLOT = """
  c AS (SELECT label, count(*) AS n FROM src GROUP BY label),
  t AS (SELECT sum(n)::BIGINT AS n, sum(n)::BIGINT - ceil(sum(n) * 2 / 10)::BIGINT AS train FROM c),
  s AS (SELECT label, c.n, c.n * t.train // t.n AS base, c.n * t.train % t.n AS rest, t.train FROM c, t),
  r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS place, train - sum(base) OVER () AS left_over FROM s),
  a AS (SELECT label, n, base + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS train FROM r)"""


@query(
    "stratified_split",
    f"""WITH {SENSOR_CTE}, src AS (SELECT {TARGET} AS label FROM sensor), {_ALLOT}
        SELECT label, TRUE AS is_test, (n - train)::BIGINT AS rows FROM a
        UNION ALL SELECT label, FALSE, train::BIGINT FROM a""",
)
def stratified_split(spark, sf):
    out = split.stratified_split(written(sensor(spark, sf), "sensor"), TARGET, "sensor_id")
    return out.groupBy(F.col(TARGET).alias("label"), "is_test").agg(F.count("*").alias("rows"))


@query(
    "stratified_folds",
    """SELECT level AS label, CAST((r - 1) % 5 AS INT) AS fold, count(*) AS rows
       FROM (SELECT quality * 2 + toxic AS level, row_number() OVER (ORDER BY quality * 2 + toxic) AS r FROM labels)
       GROUP BY 1, 2""",
)
def stratified_folds(spark, sf):
    rows = table(spark, sf, "labels").withColumn("label", F.col("quality") * 2 + F.col("toxic"))
    return split.stratified_folds(rows, "label", "doc_id").groupBy("label", "fold").agg(F.count("*").alias("rows"))


@query(
    "row_positions",
    f"""WITH {EVENTS_SQL} SELECT event_id, _file, row_number() OVER (PARTITION BY _file ORDER BY ts, event_id) - 1 AS batch_index
        FROM ev""",
)
def row_positions(spark, sf):
    out = numbering.batch_index(events(spark, sf), [FILE_KEY], ["ts", "event_id"])
    return out.select("event_id", FILE_KEY, "batch_index")


@query(
    "row_positions_names",
    """SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1 AS batch_index FROM customer""",
)
def row_positions_names(spark, sf):
    """Names with a long common start, far more ranges than groups."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return numbering.batch_index(rows, ["c_mktsegment"], ["c_name"]).drop("c_name")


@query(
    "row_positions_three",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1 AS place FROM lineitem""",
)
def row_positions_three(spark, sf):
    """One group, ordered by three columns of which the first has three values."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return numbering.position_in_group(rows, [], ["l_returnflag", "l_orderkey", "l_linenumber"], "place", 40).drop("l_returnflag")


@query(
    "split_many_classes",
    f"""WITH src AS (SELECT l_partkey AS label FROM lineitem), {_ALLOT}
        SELECT label, TRUE AS is_test, (n - train)::BIGINT AS rows FROM a WHERE n > train
        UNION ALL SELECT label, FALSE, train::BIGINT FROM a WHERE train > 0""",
)
def split_many_classes(spark, sf):
    key = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line")
    rows = written(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("label"), key), "lines")
    out = split.stratified_split(rows, "label", "line")
    return out.groupBy("label", "is_test").agg(F.count("*").alias("rows"))


@query(
    "vote_codes",
    f"""WITH {EVENTS_SQL}, b AS (SELECT event_id, CAST(k % 9 AS INT) AS a, CAST(k % 7 AS INT) AS b, level + 4 AS c FROM ev)
        SELECT event_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS prediction FROM b""",
)
def vote_codes(spark, sf):
    """Ballots of classes beyond the four hazard codes."""
    codes = {"a": F.pmod("k", F.lit(9)).cast("int"), "b": F.pmod("k", F.lit(7)).cast("int"), "c": F.col("level") + 4}
    return train.vote(events(spark, sf).select("event_id", *[c.alias(n) for n, c in codes.items()]), list(codes)).select("event_id", "prediction")


@query(
    "write_batches",
    """SELECT l_returnflag, b AS write_batch, count(*) AS points, min(l_orderkey) AS first_order FROM
       (SELECT l_returnflag, l_orderkey, CAST(floor((row_number() OVER
          (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) / 1000) AS BIGINT) AS b FROM lineitem)
       GROUP BY 1, 2""",
)
def write_batches(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = numbering.write_batch(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.groupBy("l_returnflag", "write_batch").agg(
        F.count("*").alias("points"), F.min("l_orderkey").alias("first_order")
    )


RUNS_SQL = f"""{PRED_SQL},
runs AS (SELECT day, CAST(day AS TIMESTAMP) AS run_ts, round(avg(CAST(label = prediction AS INT)), 4) AS accuracy,
                count(*) AS train_size FROM pred GROUP BY day)"""


def _runs(spark, sf):
    """One model run per day: the rule predictor's accuracy on that day."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return (
        predicted(spark, sf)
        .groupBy("day")
        .agg(F.round(F.avg(hit), 4).alias("accuracy"), F.count("*").alias("train_size"))
        .withColumns({"run_ts": F.col("day").cast("timestamp_ntz"), "model_path": F.lit("rule")})
    )


@query("best_rows", f"WITH {RUNS_SQL} SELECT day, accuracy FROM (SELECT *, rank() OVER (ORDER BY accuracy DESC) AS r FROM runs) WHERE r = 1")
def best_rows(spark, sf):
    return relate.top_rows(_runs(spark, sf), "accuracy").select("day", "accuracy")


@query(
    "cv_stats",
    f"""WITH {PRED_SQL}, f AS (SELECT event_id % 5 AS fold, avg(CAST(label = prediction AS INT)) AS accuracy FROM pred GROUP BY 1)
        SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM f""",
)
def cv_stats(spark, sf):
    hit = (F.col("label") == F.col("prediction")).cast("double")
    folds = predicted(spark, sf).groupBy(F.pmod("event_id", F.lit(5)).alias("fold")).agg(F.avg(hit).alias("accuracy"))
    return metrics.cv_stats(folds).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "feedback_union",
    f"""WITH {PRED_SQL} SELECT event_id AS id, value AS feature1, k AS feature2, level AS target FROM ev
        UNION ALL SELECT event_id, CAST(user_id AS DOUBLE), event_id, label FROM pred WHERE ts > TIMESTAMP '2024-01-15 00:00:00'""",
)
def feedback_union(spark, sf):
    base = events(spark, sf).select(
        F.col("event_id").alias("id"), F.col("value").alias("feature1"), F.col("k").alias("feature2"), F.col("level").alias("target")
    )
    feedback = (
        predicted(spark, sf)
        .where(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
        .withColumnRenamed("label", "corrected_class")
    )
    labelled = train.feedback_labels(feedback).select(
        "target",
        F.col("event_id").alias("feature2"),
        F.col("user_id").cast("double").alias("feature1"),
        F.col("event_id").alias("id"),
        "day",
    )
    return relate.union_all(base, labelled)


@query(
    "agreement",
    f"""WITH {PRED_SQL} SELECT user_id, count(*) AS rows, round(avg(CAST(label = prediction AS INT)), 4) AS agreement
        FROM pred GROUP BY user_id""",
)
def agreement(spark, sf):
    rows = predicted(spark, sf).withColumnsRenamed({"prediction": "predicted_class", "label": "corrected_class"})
    return train.agreement(rows, ["user_id"]).withColumn("agreement", F.round("agreement", 4))


@query(
    "promotion_gate",
    f"""WITH {RUNS_SQL}
        SELECT day, accuracy, round(accuracy - 0.26, 6) AS improvement, accuracy - 0.26 >= 0.01 - 1e-9 AS deploy,
               CASE WHEN accuracy - 0.26 >= 0.01 - 1e-9 THEN 'deployed' ELSE 'skipped' END AS status,
               CASE WHEN accuracy - 0.26 >= 0.01 - 1e-9 THEN NULL ELSE 'Insufficient improvement' END AS reason FROM runs""",
)
def promotion_gate(spark, sf):
    out = registry.promote(registry.gate(_runs(spark, sf), F.lit(0.26)))
    return out.select("day", "accuracy", "improvement", "deploy", "status", "reason")


@query(
    "run_intervals",
    f"WITH {RUNS_SQL} SELECT run_ts, lag(run_ts) OVER (ORDER BY run_ts) AS previous_run, accuracy FROM runs",
)
def run_intervals(spark, sf):
    return relate.run_intervals(_runs(spark, sf)).select("run_ts", "previous_run", "accuracy")


@query(
    "retrain_due",
    f"""WITH {RUNS_SQL} SELECT max(run_ts) AS last_run,
        max(run_ts) <= (SELECT max(ts) FROM events) - INTERVAL 23 HOUR AND (SELECT count(*) FROM labels) >= 100 AS due FROM runs""",
)
def retrain_due(spark, sf):
    waiting = table(spark, sf, "labels").agg(F.count("*")).scalar()
    now = table(spark, sf, "events").agg(F.max("ts")).scalar()
    return registry.retrain_due(_runs(spark, sf), waiting, now, hours=23)


@query(
    "current_model",
    f"""WITH {RUNS_SQL} SELECT run_ts, accuracy FROM runs WHERE accuracy - 0.26 >= 0.01 - 1e-9
        ORDER BY run_ts DESC LIMIT 1""",
)
def current_model(spark, sf):
    runs = registry.promote(registry.gate(_runs(spark, sf), F.lit(0.26)))
    filled = runs.withColumns({"f1": F.col("accuracy"), "val_size": F.col("train_size")})
    return registry.current_model(filled).select("run_ts", "accuracy")


@query(
    "hard_vote",
    f"""WITH {EVENTS_SQL}, b AS (
          SELECT event_id, level AS a, CASE WHEN value <= 15 THEN 0 WHEN value <= 35 THEN 1 WHEN value <= 70 THEN 2 ELSE 3 END AS b,
                 CAST(k % 4 AS INT) AS c FROM ev)
        SELECT event_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS prediction FROM b""",
)
def hard_vote(spark, sf):
    ballots = events(spark, sf).select(
        "event_id",
        F.col("level").alias("a"),
        scalar.cut(F.col("value"), [15.0, 35.0, 70.0], [0, 1, 2, 3]).alias("b"),
        F.pmod("k", F.lit(4)).cast("int").alias("c"),
    )
    return train.vote(ballots, ["a", "b", "c"]).select("event_id", "prediction")


@query(
    "attach_statistics",
    f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, max(value) AS most, count(*) AS n FROM ev GROUP BY 1)
        SELECT event_id, user_id, most, n FROM ev LEFT JOIN s USING (user_id)""",
)
def attach_statistics(spark, sf):
    """Statistics joined by the salted path that serves tables too large to broadcast."""
    rows = events(spark, sf).select("event_id", "user_id", "value")
    stats = rows.groupBy("user_id").agg(F.max("value").alias("most"), F.count("*").alias("n"))
    return attach(rows, stats, ["user_id"], limit=0, salts=8).drop("value")


@query(
    "sensor_table",
    f"WITH {SENSOR_CTE} SELECT sensor_id, {', '.join(f'round({c}, 3) AS {c}' for c in FEATURES)}, {TARGET} FROM sensor",
)
def sensor_table(spark, sf):
    return sensor(spark, sf).select("sensor_id", *[F.round(c, 3).alias(c) for c in FEATURES], TARGET)
