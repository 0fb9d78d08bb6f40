"""Profiles, validation and cleaning over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardflow.functions.scalar import as_number, name_list
from hazardflow.models.train import standardise
from hazardflow.operators import clean, profile, quality
from hazardflow.operators.quantiles import exact_quantiles
from hazardflow.plans.registry import query
from hazardflow.plans.views import (
    DIRTY_SQL,
    EVENTS_SQL,
    dirty,
    events,
    sensor,
    sensor_sql,
    table,
)
from hazardflow.schema import BOUNDS, FEATURES, FILE_KEY, TARGET
from hazardflow.session import written

DIRTY_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "k", "level"]
# The type name a profile gives each column of the dirty view.
DIRTY_TYPES = {
    "event_id": "int64",
    "ts": "datetime64[us]",
    "user_id": "int64",
    "event_type": "object",
    "value": "float64",
    "k": "int64",
    "level": "int32",
}
CLEAN = {"features": ["value", "k"], "target": "level"}
WANTED = ["k", "level", "location", "user_id", "value"]


def _profile_sql() -> str:
    parts = []
    for c in DIRTY_COLUMNS:
        infinite = f"count(*) FILTER (WHERE isinf({c}))" if c == "value" else "0"
        numeric = DIRTY_TYPES[c][:3] in ("int", "flo")
        parts.append(
            f"SELECT _file, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
            f"count({c}) = 0 AS empty, CAST({infinite} AS BIGINT) AS infinite, "
            f"'{DIRTY_TYPES[c]}' AS data_type, {numeric} AS numeric FROM dirty GROUP BY _file"
        )
    return f"WITH {DIRTY_SQL} " + " UNION ALL ".join(parts)


@query("profile_columns", _profile_sql())
def profile_columns(spark, sf):
    return profile.profile(dirty(spark, sf))


def _round_all(frame, columns, digits=4):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 4) AS q25,
            round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
            max({c}) AS "max" FROM lineitem GROUP BY l_returnflag"""
        for c in LINE_NUMBERS
    ),
)
def describe_numeric(spark, sf):
    out = profile.describe(table(spark, sf, "lineitem"), LINE_NUMBERS, ["l_returnflag"])
    return _round_all(out, ["mean", "std", "q25", "q50", "q75"])


@query(
    "quantiles_exact",
    """SELECT CAST(fraction AS DOUBLE) AS fraction, count(value) AS n, round(quantile_cont(value, [0.01, 0.5, 0.99])[i], 6) AS value
       FROM events, (VALUES (1, 0.01), (2, 0.5), (3, 0.99)) f(i, fraction) GROUP BY i, fraction""",
)
def quantiles_exact(spark, sf):
    out = exact_quantiles(table(spark, sf, "events"), ["value"], [0.01, 0.5, 0.99])
    return out.select("fraction", "n", F.round("value", 6).alias("value"))


@query(
    "quantiles_by_brackets",
    """SELECT l_returnflag, CAST(fraction AS DOUBLE) AS fraction, count(v) AS n, round(quantile_cont(v, [0.1, 0.5, 0.95])[i], 6) AS value
       FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem), (VALUES (1, 0.1), (2, 0.5), (3, 0.95)) f(i, fraction)
       GROUP BY l_returnflag, i, fraction""",
)
def quantiles_by_brackets(spark, sf):
    """The ways for large tables: brackets from a sketch, cut into bins."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    out = exact_quantiles(rows, ["l_extendedprice"], [0.1, 0.5, 0.95], ["l_returnflag"], held_values=0, small_group=0, one_task=0)
    return out.select("l_returnflag", "fraction", "n", F.round("value", 6).alias("value"))


@query(
    "feature_range",
    f"""WITH {EVENTS_SQL} {sensor_sql("ev")}
        SELECT least({", ".join(f"min({c})" for c in FEATURES)}) AS low,
               greatest({", ".join(f"max({c})" for c in FEATURES)}) AS high FROM sensor""",
)
def feature_range(spark, sf):
    return profile.global_range(sensor(spark, sf), FEATURES)


@query(
    "standard_scaling",
    f"""WITH {EVENTS_SQL} {sensor_sql("ev")}
        SELECT sensor_id, {", ".join(
            f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in FEATURES)}
        FROM sensor""",
)
def standard_scaling(spark, sf):
    rows = sensor(spark, sf)
    return _round_all(standardise(rows, rows, FEATURES).select("sensor_id", *FEATURES), FEATURES)


@query(
    "duplicate_rows",
    """SELECT source, CAST(sum(copies) AS BIGINT) AS rows, CAST(sum(copies - 1) AS BIGINT) AS duplicates,
              round(sum(copies - 1) * 100 / sum(copies), 2) AS duplicate_pct
       FROM (SELECT source, text, lang, n_chars, count(*) AS copies FROM documents GROUP BY ALL) GROUP BY source""",
)
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("source", "text", "lang", "n_chars"), ["source"])


@query(
    "schema_diff",
    f"""WITH {DIRTY_SQL},
        names AS (SELECT DISTINCT user_id, event_type AS name FROM dirty WHERE event_type IS NOT NULL),
        wanted(name) AS (VALUES ('click'), ('refund'), ('signup'), ('view')),
        users AS (SELECT DISTINCT user_id FROM dirty)
        SELECT user_id,
               coalesce((SELECT string_agg(w.name, ',' ORDER BY w.name) FROM wanted w WHERE NOT EXISTS
                 (SELECT 1 FROM names n WHERE n.user_id = u.user_id AND n.name = w.name)), '') AS missing_columns,
               coalesce((SELECT string_agg(n.name, ',' ORDER BY n.name) FROM names n WHERE n.user_id = u.user_id
                 AND n.name NOT IN (SELECT name FROM wanted)), '') AS extra_columns
        FROM users u""",
)
def schema_diff(spark, sf):
    found = dirty(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("columns"))
    out = profile.schema_diff(found, ["click", "refund", "signup", "view"])
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("missing_columns", "extra_columns")])


@query(
    "class_distribution",
    """SELECT quality, count(*) AS rows, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent
       FROM labels GROUP BY quality""",
)
def class_distribution(spark, sf):
    return profile.class_distribution(table(spark, sf, "labels"), "quality")


_FAILED = ", ".join(
    f"CASE WHEN coalesce({c} BETWEEN {lo} AND {hi}, FALSE) THEN NULL ELSE '{c}' END" for c, (lo, hi) in BOUNDS.items()
)


@query(
    "range_check",
    f"""WITH {DIRTY_SQL} {sensor_sql("dirty")}
        SELECT sensor_id, violations, violations = '' AS valid
        FROM (SELECT sensor_id, concat_ws(',', {_FAILED}) AS violations FROM sensor)""",
)
def range_check(spark, sf):
    checked = profile.range_check(sensor(spark, sf, dirty))
    return checked.select("sensor_id", F.array_join("violations", ",").alias("violations"), "valid")


_VALID_CTE = f"""{DIRTY_SQL},
counted AS (SELECT *, count(*) AS copies FROM dirty GROUP BY ALL),
val AS (
  SELECT _file, CAST(sum(copies) AS BIGINT) AS rows, CAST(sum(copies - 1) AS BIGINT) AS duplicates,
         CAST(sum(copies * ({" + ".join(f"CAST({c} IS NULL AS INT)" for c in DIRTY_COLUMNS)})) AS BIGINT) AS missing_total
  FROM counted GROUP BY _file),
warned AS (
  SELECT _file, rows, duplicates, missing_total, round(missing_total * 100 / (rows * 7), 2) AS missing_pct,
         concat_ws('|', 'Missing required columns: [''location'']',
           'Extra columns found (will be ignored): [''event_id'', ''ts'', ''event_type'']',
           CASE WHEN missing_total * 100 / (rows * 7) > 1.9
                THEN printf('High missing values percentage: %.2f%%', missing_total * 100 / (rows * 7)) END,
           CASE WHEN duplicates > 0
                THEN printf('Duplicate rows found: %d (%.2f%%)', duplicates, duplicates * 100 / rows) END) AS warnings
  FROM val)"""


def _validated(spark, sf):
    return quality.validate_files(dirty(spark, sf), required=WANTED, features=["value", "k"], missing_pct=1.9)


@query(
    "quality_warnings",
    f"WITH {_VALID_CTE} SELECT _file, rows, duplicates, missing_total, missing_pct, warnings, 'ok' AS status FROM warned",
)
def quality_warnings(spark, sf):
    return _validated(spark, sf).select(
        FILE_KEY,
        "rows",
        "duplicates",
        "missing_total",
        "missing_pct",
        F.array_join("warnings", "|").alias("warnings"),
        "status",
    )


@query(
    "validation_summary",
    f"""WITH {_VALID_CTE}
        SELECT count(*) AS total_files, CAST(sum(rows) AS BIGINT) AS total_rows, count(*) * 7 AS total_columns,
               CAST(sum(missing_total) AS BIGINT) AS total_missing_values,
               count(*) FILTER (WHERE warnings <> '') AS files_with_warnings,
               CAST(0 AS BIGINT) AS files_with_errors FROM warned""",
)
def validation_summary(spark, sf):
    return quality.validation_summary(_validated(spark, sf))


@query("dedupe", f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty")
def dedupe(spark, sf):
    return clean.dedupe(dirty(spark, sf))


@query(
    "impute_median",
    f"""WITH {DIRTY_SQL}, one AS (SELECT DISTINCT * FROM dirty),
        med AS (SELECT _file, median(value) AS mv FROM one GROUP BY _file)
        SELECT event_id, _file, round(coalesce(value, mv), 4) AS value FROM one JOIN med USING (_file)""",
)
def impute_median(spark, sf):
    rows = written(clean.dedupe(dirty(spark, sf)), "rows")  # read more than once
    filled = clean.impute_median(rows, ["value"])
    return filled.select("event_id", FILE_KEY, F.round("value", 4).alias("value"))


@query(
    "impute_mode",
    f"""WITH {DIRTY_SQL},
        ranked AS (SELECT _file, event_type, row_number() OVER (PARTITION BY _file ORDER BY count(*) DESC, event_type) AS r
                   FROM dirty WHERE event_type IS NOT NULL GROUP BY _file, event_type)
        SELECT d.event_id, d._file, coalesce(d.event_type, m.event_type, 'unknown') AS event_type
        FROM dirty d LEFT JOIN ranked m ON m._file = d._file AND m.r = 1""",
)
def impute_mode(spark, sf):
    return clean.impute_mode(dirty(spark, sf), "event_type", "unknown").select("event_id", FILE_KEY, "event_type")


@query(
    "drop_all_zero",
    f"""WITH {DIRTY_SQL} SELECT event_id, value, k FROM dirty
        WHERE NOT (coalesce(value = 0, FALSE) AND coalesce(k = 0, FALSE))""",
)
def drop_all_zero(spark, sf):
    return clean.drop_all_zero(dirty(spark, sf), ["value", "k"]).select("event_id", "value", "k")


@query(
    "narrow_types",
    """SELECT CAST(c_custkey AS INT) AS c_custkey, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 4) AS c_acctbal,
              CAST(try_cast(c_name AS FLOAT) AS DOUBLE) AS c_name,
              CAST(try_cast(split_part(c_name, '#', 2) AS DOUBLE) AS INT) AS number FROM customer""",
)
def narrow_types(spark, sf):
    rows = table(spark, sf, "customer").withColumn("number", F.split_part("c_name", F.lit("#"), F.lit(2)))
    out = clean.narrow(rows, ["c_acctbal", "c_name"], ["c_custkey", "number"])
    return out.select(
        "c_custkey",
        F.round(F.col("c_acctbal").cast("double"), 4).alias("c_acctbal"),
        F.col("c_name").cast("double").alias("c_name"),
        "number",
    )


CLEAN_CTE = f"""{DIRTY_SQL},
one AS (SELECT *, count(*) AS copies FROM dirty GROUP BY ALL),
med AS (SELECT _file, median(value) AS mv, median(k) AS mk FROM one GROUP BY _file),
modes AS (SELECT _file, level AS ml, row_number() OVER (PARTITION BY _file ORDER BY count(*) DESC, level) AS r
          FROM one WHERE level IS NOT NULL GROUP BY _file, level),
filled AS (
  SELECT one._file, event_id, ts, user_id, event_type, copies, coalesce(value, mv) AS value,
         coalesce(CAST(k AS DOUBLE), mk) AS k, coalesce(level, ml, 0) AS level,
         CAST(value IS NULL AS INT) + CAST(level IS NULL AS INT) + CAST(event_type IS NULL AS INT) AS missing
  FROM one JOIN med USING (_file) LEFT JOIN modes ON modes._file = one._file AND r = 1),
flagged AS (SELECT *, value = 0 AND k = 0 AS dead FROM filled),
clean_stats AS (
  SELECT _file, CAST(sum(copies) AS BIGINT) AS rows_before, count(*) FILTER (WHERE NOT dead) AS rows_after,
         CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed, count(*) FILTER (WHERE dead) AS zero_rows_removed,
         CAST(sum(missing * copies) AS BIGINT) AS missing_before,
         count(*) FILTER (WHERE NOT dead AND event_type IS NULL) AS missing_after,
         CAST(sum(copies) AS BIGINT) - count(*) FILTER (WHERE NOT dead) AS rows_removed
  FROM flagged GROUP BY _file)"""


@query(
    "clean_table",
    f"""WITH {CLEAN_CTE}
        SELECT _file, event_id, event_type, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value,
               round(CAST(CAST(k AS FLOAT) AS DOUBLE), 4) AS k, CAST(level AS INT) AS level
        FROM flagged WHERE NOT dead""",
)
def clean_table(spark, sf):
    cleaned, _ = clean.clean_table(dirty(spark, sf), **CLEAN)
    return cleaned.select(
        FILE_KEY,
        "event_id",
        "event_type",
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("value", "k")],
        "level",
    )


@query("clean_stats", f"WITH {CLEAN_CTE} SELECT * FROM clean_stats")
def clean_stats(spark, sf):
    return clean.clean_table(dirty(spark, sf), **CLEAN)[1]


CLEAN_SUMMARY_SQL = """SELECT CAST(sum(rows_before) AS BIGINT) AS total_original_rows,
  CAST(sum(rows_after) AS BIGINT) AS total_final_rows, CAST(sum(rows_removed) AS BIGINT) AS total_rows_removed,
  round(sum(rows_removed) * 100 / sum(rows_before), 2) AS data_reduction_pct,
  CAST(0 AS BIGINT) AS files_with_errors FROM clean_stats"""


@query("clean_summary", f"WITH {CLEAN_CTE} {CLEAN_SUMMARY_SQL}")
def clean_summary(spark, sf):
    return clean.clean_summary(clean.clean_table(dirty(spark, sf), **CLEAN)[1])


@query(
    "recommendations",
    f"""WITH {_VALID_CTE}, flags AS (SELECT _file, warnings <> '' AS w, missing_total > 0 AS m, missing_pct > 1.95 AS d FROM warned)
        SELECT _file, 'data_quality' AS category, 'medium' AS priority FROM flags WHERE w
        UNION ALL SELECT _file, 'data_completeness', 'low' FROM flags WHERE m
        UNION ALL SELECT _file, 'data_efficiency', 'medium' FROM flags WHERE d""",
)
def recommendations(spark, sf):
    """Rules per file; the third is fed so that some files are over its limit and some are not."""
    summary = _validated(spark, sf).select(
        FILE_KEY,
        (F.size("warnings") > 0).cast("int").alias("files_with_warnings"),
        F.col("missing_total").alias("total_missing_values"),
        F.when(F.col("missing_pct") > 1.95, 21.0).otherwise(20.0).alias("data_reduction_pct"),
    )
    return quality.recommendations(summary, [FILE_KEY]).select(FILE_KEY, "category", "priority")


@query(
    "next_actions",
    f"""WITH {_VALID_CTE},
        acts(ok, step, action) AS (VALUES
          (TRUE, 0, '{quality.AFTER_SUCCESS[0]}'), (TRUE, 1, '{quality.AFTER_SUCCESS[1]}'), (TRUE, 2, '{quality.AFTER_SUCCESS[2]}'),
          (FALSE, 0, '{quality.AFTER_FAILURE[0]}'), (FALSE, 1, '{quality.AFTER_FAILURE[1]}'), (FALSE, 2, '{quality.AFTER_FAILURE[2]}'),
          (NULL, 3, '{quality.ALWAYS[0]}'), (NULL, 4, '{quality.ALWAYS[1]}'), (NULL, 5, '{quality.ALWAYS[2]}'))
        SELECT _file, step, action FROM warned JOIN acts ON coalesce(ok = (missing_pct <= 1.95), TRUE)""",
)
def next_actions(spark, sf):
    summary = _validated(spark, sf).select(
        FILE_KEY, F.when(F.col("missing_pct") <= 1.95, 100.0).otherwise(96.67).alias("success_rate")
    )
    return quality.next_actions(summary, [FILE_KEY])


@query(
    "text_numbers",
    """SELECT o_orderkey, o_orderpriority,
              try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS first_part,
              try_cast(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS second_part,
              '[''' || replace(o_orderpriority, '-', ''', ''') || ''']' AS names FROM orders""",
)
def text_numbers(spark, sf):
    parts = F.split("o_orderpriority", "-")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        as_number(parts[0]).alias("first_part"),
        as_number(parts[1]).alias("second_part"),
        name_list(parts).alias("names"),
    )
