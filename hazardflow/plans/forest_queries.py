"""A forest as a table of nodes, grown, walked and measured on both sides.

The twin grows the same forest in SQL: the same draws, tried features, bins and gains, one block of
common table expressions per depth, then walks it and sums the votes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardflow.models import forest_table, score
from hazardflow.operators import metrics
from hazardflow.plans.registry import query
from hazardflow.plans.score_queries import SENSOR_CTE
from hazardflow.plans.views import sensor
from hazardflow.schema import FEATURES, TARGET
from hazardflow.session import written

TREES, DEPTH, SEED, CLASSES = 20, 5, 42, 4
TRIES = 3


def _number_sql(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || '/' || ".join(parts) + "), 1, 8) AS BIGINT)"


def _side_sql(prefix: str) -> tuple[str, str]:
    parts = [f"(w{c} * {prefix}{c})" for c in range(CLASSES)]
    whole = "(" + " + ".join(parts) + ")"
    return whole, "((" + " + ".join(f"{p} * {p}" for p in parts) + f") / {whole})"


def forest_sql() -> str:
    """Common table expressions that end in `nodes` (the forest) and `leaf` (where every row ends in every tree)."""
    span, classes = range(len(FEATURES)), range(CLASSES)
    quantiles = " UNION ALL ".join(
        f"SELECT {i} AS place, unnest(quantile_cont({f}, [j / {forest_table.BINS} FOR j IN range(1, {forest_table.BINS})])) AS q FROM fit"
        for i, f in enumerate(FEATURES)
    )
    times = " + ".join(f"CAST(h >= {limit} AS INT)" for limit in forest_table.drawn_limits())
    counted = ", ".join(f"CAST(coalesce(sum(times) FILTER (class = {c}), 0) AS DOUBLE) AS n{c}" for c in classes)
    weights = ", ".join(f"any_value(whole) / (any_value(known) * max(n) FILTER (class = {c})) AS w{c}" for c in classes)
    gain = f"{_side_sql('l')[1]} + {_side_sql('r')[1]} - {_side_sql('b')[1]}"
    parts = [
        f"""fit AS (SELECT * FROM sensor WHERE {_number_sql("'held out'", "sensor_id")} % 5 <> 0),
quantiles AS MATERIALIZED (SELECT DISTINCT place, round(q, {forest_table.DECIMALS}) AS q FROM ({quantiles})),
edges AS MATERIALIZED (SELECT place, list(q ORDER BY q) AS cuts FROM quantiles GROUP BY place),
long AS MATERIALIZED (
  SELECT sensor_id, {TARGET} AS class, place, x, CAST(len([c FOR c IN cuts IF c < x]) AS INT) AS bin
  FROM (SELECT sensor_id, {TARGET}, unnest([{", ".join(map(str, span))}]) AS place, unnest([{", ".join(FEATURES)}]) AS x FROM fit) JOIN edges USING (place)),
tops AS MATERIALIZED (SELECT place, bin, max(x) AS cut FROM long GROUP BY ALL),
sizes AS (SELECT {TARGET} AS class, count(*) AS n FROM fit GROUP BY 1),
weights AS MATERIALIZED (
  SELECT {weights} FROM (SELECT class, n, CAST(sum(n) OVER () AS DOUBLE) AS whole, count(*) OVER () AS known FROM sizes)),
drawn AS MATERIALIZED (
  SELECT sensor_id, class, tree, times FROM (
    SELECT *, {times} AS times FROM (
      SELECT sensor_id, {TARGET} AS class, tree, {_number_sql(f"'{SEED}'", "tree", "sensor_id")} AS h
      FROM fit, (SELECT unnest(range({TREES})) AS tree))) WHERE times > 0),
at0 AS MATERIALIZED (SELECT *, CAST(1 AS BIGINT) AS node FROM drawn),
open0 AS MATERIALIZED (SELECT tree, node, {counted} FROM at0 GROUP BY tree, node)"""
    ]
    for level in range(DEPTH):
        parts.append(
            f"""tried{level} AS MATERIALIZED (
  SELECT tree, node, place FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY h, place) AS turn FROM (
      SELECT tree, node, place, {_number_sql(f"'{SEED}'", "tree", "node", "place")} AS h
      FROM open{level}, (SELECT unnest(range({len(FEATURES)})) AS place))) WHERE turn <= {TRIES}),
counts{level} AS MATERIALIZED (
  SELECT a.tree, a.node, t.place, l.bin, {counted.replace("class", "a.class")}
  FROM at{level} a JOIN tried{level} t USING (tree, node) JOIN long l ON l.sensor_id = a.sensor_id AND l.place = t.place GROUP BY ALL),
sums{level} AS (
  SELECT tree, node, place, bin, {", ".join(f"sum(n{c}) OVER upto AS l{c}, sum(n{c}) OVER own AS b{c}" for c in classes)}
  FROM counts{level} WINDOW own AS (PARTITION BY tree, node, place), upto AS (PARTITION BY tree, node, place ORDER BY bin)),
sides{level} AS (SELECT *, {", ".join(f"b{c} - l{c} AS r{c}" for c in classes)} FROM sums{level}),
gains{level} AS (
  SELECT *, {gain} AS gain FROM sides{level}, weights
  WHERE {" + ".join(f"l{c}" for c in classes)} >= 1 AND {" + ".join(f"r{c}" for c in classes)} >= 1),
cut{level} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, place, bin) AS turn
    FROM gains{level} WHERE gain > {forest_table.LEAST_GAIN}) WHERE turn = 1),
at{level + 1} AS MATERIALIZED (
  SELECT a.sensor_id, a.class, a.tree, a.times, 2 * a.node + CAST(l.bin > c.bin AS BIGINT) AS node
  FROM at{level} a JOIN cut{level} c USING (tree, node) JOIN long l ON l.sensor_id = a.sensor_id AND l.place = c.place),
open{level + 1} AS MATERIALIZED (
  SELECT tree, 2 * node AS node, {", ".join(f"l{c} AS n{c}" for c in classes)} FROM cut{level}
  UNION ALL SELECT tree, 2 * node + 1, {", ".join(f"r{c}" for c in classes)} FROM cut{level})"""
        )
    inner = " UNION ALL ".join(f"SELECT o.*, {i} AS depth, c.place, c.bin, c.gain FROM open{i} o LEFT JOIN cut{i} c USING (tree, node)" for i in range(DEPTH))
    parts.append(
        f"""nodes AS MATERIALIZED (
  SELECT tree, node, depth, place, t.cut, gain, {", ".join(f"w{c} * n{c} AS v{c}" for c in classes)}
  FROM ({inner} UNION ALL SELECT *, {DEPTH}, NULL, NULL, NULL FROM open{DEPTH}) LEFT JOIN tops t USING (place, bin), weights),
wide AS MATERIALIZED (SELECT sensor_id, [{", ".join(FEATURES)}] AS x FROM sensor),
walk0 AS MATERIALIZED (SELECT sensor_id, x, tree, CAST(1 AS BIGINT) AS node FROM wide, (SELECT unnest(range({TREES})) AS tree))"""
    )
    for level in range(DEPTH):
        parts.append(
            f"""walk{level + 1} AS MATERIALIZED (
  SELECT sensor_id, x, tree, CASE WHEN n.place IS NULL THEN node ELSE 2 * node + CAST(x[n.place + 1] > n.cut AS BIGINT) END AS node
  FROM walk{level} JOIN nodes n USING (tree, node))"""
        )
    whole = "(" + " + ".join(f"v{c}" for c in classes) + ")"
    parts.append(
        f"""votes AS (
  SELECT sensor_id, {", ".join(f"sum(CAST(floor(v{c} / {whole} * {forest_table.SHARE} + 0.5) AS BIGINT)) AS s{c}" for c in classes)}
  FROM walk{DEPTH} JOIN nodes USING (tree, node) GROUP BY sensor_id),
judged AS MATERIALIZED (
  SELECT sensor_id, list_position(s, list_max(s)) - 1 AS prediction, CAST(list_max(s) AS DOUBLE) / CAST(list_sum(s) AS DOUBLE) AS p
  FROM (SELECT sensor_id, [{", ".join(f"s{c}" for c in classes)}] AS s FROM votes))"""
    )
    return ",\n".join(parts)


FOREST_CTE = f"{SENSOR_CTE},\n{forest_sql()}"
_FEATURE = "CASE place " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END"
_RESULTS = """prediction, round(p, 4) AS probability,
  CASE WHEN p < 0.4 THEN 'Low' WHEN p < 0.55 THEN 'Medium' WHEN p < 0.75 THEN 'High' ELSE 'Intense' END AS risk_level,
  round(least(abs(p - 0.5) * 2 * 0.95, 1.0), 4) AS confidence"""


def _held_out():
    return F.conv(F.substring(F.md5(F.concat(F.lit("held out/"), "sensor_id").cast("binary")), 1, 8), 16, 10).cast("bigint") % 5 == 0


def _grown(spark, sf):
    rows = written(sensor(spark, sf), "sensor")
    fit = written(rows.where(~_held_out()), "fit")
    return rows, forest_table.grow(fit, "sensor_id", trees=TREES, depth=DEPTH, tries=TRIES, seed=SEED)


@query(
    "forest_nodes",
    f"""WITH {FOREST_CTE} SELECT tree, node, depth, {_FEATURE} AS feature, round(cut, 6) AS cut, round(gain, 4) AS gain,
        {", ".join(f"round(v{c}, 4) AS votes_{c}" for c in range(CLASSES))} FROM nodes""",
)
def forest_nodes(spark, sf):
    """Every node of the class-weighted forest over the rows that are not held out."""
    nodes = _grown(spark, sf)[1]
    votes = [F.round(F.get("votes", F.lit(c)), 4).alias(f"votes_{c}") for c in range(CLASSES)]
    return nodes.select("tree", "node", "depth", "feature", F.round("cut", 6).alias("cut"), F.round("gain", 4).alias("gain"), *votes)


@query("forest_scoring", f"WITH {FOREST_CTE} SELECT sensor_id, {_RESULTS}, 'v1.0.0' AS model_version FROM judged")
def forest_scoring(spark, sf):
    """Prediction, probability, risk and confidence of every reading, by a walk through the table."""
    rows, nodes = _grown(spark, sf)
    return forest_table.scored(nodes, rows, "sensor_id").drop("votes")


@query(
    "forest_importances",
    f"""WITH {FOREST_CTE}, gained AS (SELECT tree, place, sum(gain) AS gain FROM nodes WHERE place IS NOT NULL GROUP BY ALL),
        shares AS (SELECT place, sum(share) AS share FROM (SELECT place, gain / sum(gain) OVER (PARTITION BY tree) AS share FROM gained) GROUP BY place)
        SELECT f.feature, round(coalesce(share / (SELECT sum(share) FROM shares), 0), 6) AS importance
        FROM (SELECT unnest(range({len(FEATURES)})) AS place, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature) f LEFT JOIN shares USING (place)""",
)
def forest_importances(spark, sf):
    nodes = _grown(spark, sf)[1]
    return forest_table.importances(nodes).withColumn("importance", F.round("importance", 6))


@query(
    "forest_report",
    f"""WITH {FOREST_CTE}, t AS (
          SELECT j.prediction, s.{TARGET} AS label FROM judged j JOIN sensor s USING (sensor_id) WHERE {_number_sql("'held out'", "sensor_id")} % 5 = 0),
        c AS (SELECT unnest(range({CLASSES})) AS label)
        SELECT CAST(c.label AS VARCHAR) AS label, count(*) FILTER (t.label = c.label) AS support,
          round(coalesce(count(*) FILTER (t.label = c.label AND prediction = c.label) / nullif(count(*) FILTER (prediction = c.label), 0), 0), 4) AS precision,
          round(coalesce(count(*) FILTER (t.label = c.label AND prediction = c.label) / nullif(count(*) FILTER (t.label = c.label), 0), 0), 4) AS recall
        FROM t, c GROUP BY c.label""",
)
def forest_report(spark, sf):
    """Precision and recall per class on the held-out rows."""
    rows, nodes = _grown(spark, sf)
    test = rows.where(_held_out())
    judged = forest_table.scored(nodes, test, "sensor_id").select("sensor_id", "prediction")
    pairs = test.select("sensor_id", F.col(TARGET).alias("label")).join(judged, "sensor_id")
    report = metrics.class_report(pairs.select("label", "prediction"))
    report = report.where(F.col("name").isin([str(c) for c in range(CLASSES)]))
    return report.select(F.col("name").alias("label"), "support", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query(
    "forest_batch_summary",
    f"""WITH {FOREST_CTE}, s AS (SELECT {_RESULTS} FROM judged)
        SELECT count(*) AS total_predictions, count(*) FILTER (prediction = 3) AS total_high_risk, count(*) FILTER (prediction = 0) AS total_low_risk,
          round(avg(probability), 4) AS average_probability, round(avg(confidence), 4) AS average_confidence,
          {", ".join(f"count(*) FILTER (risk_level = '{r}') AS risk_{r.lower()}" for r in ("Low", "Medium", "High", "Intense"))},
          'batch_20240201_000000_' || count(*) AS batch_id FROM s""",
)
def forest_batch_summary(spark, sf):
    rows, nodes = _grown(spark, sf)
    return score.batch_summary(forest_table.scored(nodes, rows, "sensor_id"), high=[3], low=[0], ts="2024-02-01 00:00:00")
