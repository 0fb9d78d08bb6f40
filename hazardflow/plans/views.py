"""Stand-in views over the driver tables, each with its SQL twin.

The driver tables hold no sensor readings: a sensor row is one user and day of
`events`, a file is one day, a score comes from the event value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.functions.scalar import confidence, cut, risk_level
from hazardflow.schema import FILE_KEY, TARGET

DENSITY_EDGES = [0.3, 0.6, 1.0]
VALUE_EDGES = [15.0, 35.0, 70.0]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def level_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "view", 0).when(event_type == "click", 1).when(event_type == "signup", 2).otherwise(3)
    )


def day_file(ts: Column) -> Column:
    return F.concat(F.lit("day_"), F.date_format(ts, "yyyy-MM-dd"), F.lit(".csv"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return shaped_events(table(spark, sf, "events"))


def shaped_events(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        level_of(F.col("event_type")).alias("level"),
        day_file(F.col("ts")).alias(FILE_KEY),
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """All events with missing values, zeros and repeated rows put in by rule."""
    number = F.col("event_id")
    return (
        events(spark, sf)
        .withColumns(
            {
                "value": F.when(number % 17 == 0, None).when(number % 23 == 0, 0.0).otherwise(F.col("value")),
                "k": F.when(number % 23 == 0, 0).otherwise(F.col("k")),
                "event_type": F.when(number % 31 != 0, F.col("event_type")),
                "level": F.when(number % 31 != 0, F.col("level")),
                "_copy": F.explode(F.when(number % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
            }
        )
        .drop("_copy")
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS level,
         'day_' || strftime(ts, '%Y-%m-%d') || '.csv' AS _file
  FROM events)"""

DIRTY_SQL = (
    EVENTS_SQL
    + """,
dirty AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 31 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 0.0 ELSE value END AS value,
         CASE WHEN event_id % 23 = 0 THEN 0 ELSE k END AS k,
         CASE WHEN event_id % 31 <> 0 THEN level END AS level, _file
  FROM (SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM ev))"""
)


def sensor(spark: SparkSession, sf: str, source=events) -> DataFrame:
    """One reading per user and day, with the eight features and the target."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    energy = F.col("cents") / 100.0
    seconds = (F.col("last_us") - F.col("first_us")) / 1e6
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    days = F.greatest(F.lit(0.1), seconds / 86400)
    density = F.col("energy") / (F.col("volume") + 1)
    return (
        source(spark, sf)
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.sum(cents).alias("cents"),
            F.sum("k").alias("volume"),
            F.count("*").alias("n"),
            F.min(micros).alias("first_us"),
            F.max(micros).alias("last_us"),
        )
        .select("*", energy.alias("energy"), days.alias("days"))
        .select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyyMMdd")).alias("sensor_id"),
            "user_id",
            "day",
            F.round("days", 8).alias("Duration_days"),
            F.round(F.log10(1 + F.col("energy")), 8).alias("Energy_Unit_log"),
            F.round(density, 8).alias("Energy_density_Joule_sqr"),
            F.round(F.col("volume").cast("double"), 8).alias("Volume_m3_sqr"),
            F.round(F.log10(1 + F.col("n") / F.col("days")), 8).alias("Event_freq_unit_per_day_log"),
            F.round(F.col("energy") / F.col("days"), 8).alias("Energy_Joule_per_day_sqr"),
            F.round(F.col("volume") / F.col("days"), 8).alias("Volume_m3_per_day_sqr"),
            F.round(F.log10(1 + density), 8).alias("Energy_per_Volume_log"),
            cut(density, DENSITY_EDGES, [0, 1, 2, 3]).alias(TARGET),
        )
    )


def sensor_sql(source: str) -> str:
    return f""",
sensor AS (
  SELECT user_id || '-' || strftime(day, '%Y%m%d') AS sensor_id, user_id, day,
         round(days, 8) AS Duration_days,
         round(log10(1 + energy), 8) AS Energy_Unit_log,
         round(energy / (volume + 1), 8) AS Energy_density_Joule_sqr,
         round(CAST(volume AS DOUBLE), 8) AS Volume_m3_sqr,
         round(log10(1 + n / days), 8) AS Event_freq_unit_per_day_log,
         round(energy / days, 8) AS Energy_Joule_per_day_sqr,
         round(volume / days, 8) AS Volume_m3_per_day_sqr,
         round(log10(1 + energy / (volume + 1)), 8) AS Energy_per_Volume_log,
         CASE WHEN energy / (volume + 1) <= 0.3 THEN 0 WHEN energy / (volume + 1) <= 0.6 THEN 1
              WHEN energy / (volume + 1) <= 1.0 THEN 2 WHEN energy IS NOT NULL THEN 3 END AS Intensity_Level_encoded
  FROM (SELECT user_id, CAST(ts AS DATE) AS day,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS energy,
               CAST(sum(k) AS BIGINT) AS volume, CAST(count(*) AS DOUBLE) AS n,
               greatest(0.1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 86400) AS days
        FROM {source} GROUP BY 1, 2))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_scores(events(spark, sf))


def with_scores(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("probability", F.col("value") / (F.col("value") + 20))
        .withColumns(
            {
                "prediction": (F.col("probability") >= 0.5).cast("int"),
                "risk_level": risk_level(F.col("probability")),
                "confidence": confidence(F.col("probability")),
            }
        )
    )


RISK_CASE = (
    "CASE WHEN probability < 0.4 THEN 'Low' WHEN probability < 0.55 THEN 'Medium' "
    "WHEN probability < 0.75 THEN 'High' ELSE 'Intense' END"
)

SCORED_SQL = (
    EVENTS_SQL
    + f""",
scored AS (
  SELECT *, CAST(probability >= 0.5 AS INT) AS prediction, {RISK_CASE} AS risk_level,
         least(abs(probability - 0.5) * 2 * 0.95, 1.0) AS confidence
  FROM (SELECT *, value / (value + 20) AS probability FROM ev))"""
)


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Rule predictor: the class by event type against the class by value."""
    return events(spark, sf).select(
        "event_id",
        "ts",
        "user_id",
        FILE_KEY,
        F.to_date("ts").alias("day"),
        F.col("level").alias("label"),
        cut(F.col("value"), VALUE_EDGES, [0, 1, 2, 3]).alias("prediction"),
    )


PRED_SQL = (
    EVENTS_SQL
    + """,
pred AS (
  SELECT event_id, ts, user_id, _file, CAST(ts AS DATE) AS day, level AS label,
         CASE WHEN value <= 15 THEN 0 WHEN value <= 35 THEN 1 WHEN value <= 70 THEN 2 ELSE 3 END AS prediction
  FROM ev)"""
)
