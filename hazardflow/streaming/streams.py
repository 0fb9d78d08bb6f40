"""Structured Streaming forms of ingestion, validation, scoring and monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from hazardflow.functions.scalar import over_threshold
from hazardflow.models.score import risk_of, score
from hazardflow.operators.profile import range_check
from hazardflow.schema import BOUNDS, RISK_LEVELS
from hazardflow.sources.writers import prediction_rows


def ingest_stream(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = ()) -> StreamingQuery:
    """Append a stream to a Parquet table until the files present now are read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(*partition)
    return writer.outputMode("append").trigger(availableNow=True).start()


def validate_stream(stream: DataFrame, good: str, quarantine: str, checkpoint: str, bounds=BOUNDS) -> StreamingQuery:
    """Write good rows and rejected rows to two tables.

    Each micro-batch is checked once; a repeated micro-batch replaces its own
    folder in both tables.
    """

    def sink(batch: DataFrame, number: int) -> None:
        checked = range_check(batch, bounds)
        checked.persist()
        try:
            checked.where("valid").drop("valid", "violations").write.mode("overwrite").parquet(
                f"{good}/batch={number}"
            )
            checked.where("NOT valid").drop("valid").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        finally:
            checked.unpersist()

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    stream: DataFrame, model: PipelineModel, path: str, checkpoint: str, ts: str = "ts", version: str = "v1.0.0"
) -> StreamingQuery:
    """Score rows as they come and append them to the prediction log.

    Rows without all features are logged too, with NULL results.
    """
    scored = score(model, stream, version=version)
    rows = prediction_rows(scored.withColumn("ts", F.col(ts)), "single").withColumn("date", F.to_date("ts"))
    return run_to_table(rows, path, checkpoint, ["date"])


def risk_windows(
    stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: Sequence[str] = ()
) -> DataFrame:
    """Counts, high-risk counts and means per time window, also on a batch frame."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        stream.withWatermark("ts", late)
        .groupBy(window.alias("window"), *by)
        .agg(
            F.count("*").alias("predictions"),
            F.count_if(F.col("risk_level") == "High").alias("high_risk"),
            F.avg("probability").alias("average_probability"),
            *[F.count_if(risk_of(level)).alias(f"risk_{level.lower()}") for level in RISK_LEVELS],
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
                "predictions", "high_risk", "average_probability", *[f"risk_{r.lower()}" for r in RISK_LEVELS])
    )


def dedupe_stream(stream: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


class LateRows(StreamingQueryListener):
    """Counts the rows that came after the watermark, over all progress of the queries it hears.

    Use: `late = LateRows(); spark.streams.addListener(late)` before the query starts.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self.rows.get(str(query.id), 0)


def sensor_windows(
    stream: DataFrame,
    key: str,
    value: str,
    size: str | None = None,
    slide: str | None = None,
    gap: str | None = None,
    late: str = "1 hour",
) -> DataFrame:
    """Count, sum, mean, least and greatest value per key and window.

    `size` gives tumbling windows, `size` and `slide` sliding ones, `gap` sessions.
    """
    if gap:
        window = F.session_window("ts", gap)
    elif slide:
        window = F.window("ts", size, slide)
    else:
        window = F.window("ts", size)
    return (
        stream.withWatermark("ts", late)
        .groupBy(key, window.alias("window"))
        .agg(
            F.count("*").alias("rows"),
            F.sum(value).alias("total"),
            F.avg(value).alias("mean"),
            F.min(value).alias("least"),
            F.max(value).alias("most"),
        )
        .select(
            key,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "rows",
            "total",
            "mean",
            "least",
            "most",
        )
    )


def alerts(stream: DataFrame, threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows at or over the probability threshold to an alert table."""
    return run_to_table(stream.where(over_threshold(F.col("probability"), threshold)), path, checkpoint)


def quality_windows(
    stream: DataFrame, columns: Sequence[str], size: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Rows, missing share and duplicates of every event-time window, also on a batch frame.

    Copies are counted per window, wherever the micro-batches are cut.
    """
    copies = (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("window"), *columns)
        .agg(F.count("*").alias("n"))
        .withColumn("at", F.window_time("window"))
    )
    cells = sum((F.when(F.col(c).isNull(), F.col("n")).otherwise(0) for c in columns), F.lit(0))
    return (
        copies.groupBy(F.window("at", size).alias("span"))
        .agg(
            F.sum("n").alias("rows"),
            F.round(F.sum(cells) * 100 / (F.sum("n") * len(columns)), 2).alias("missing_pct"),
            F.sum(F.col("n") - 1).alias("duplicates"),
        )
        .select(F.col("span.start").alias("window_start"), "rows", "missing_pct", "duplicates")
    )


def quality_alerts(
    stream: DataFrame,
    columns: Sequence[str],
    path: str,
    checkpoint: str,
    missing_pct: float = 10,
    size: str = "1 day",
    late: str = "1 hour",
) -> StreamingQuery:
    """Append one row for every closed window whose missing share or duplicates break the rules."""
    found = quality_windows(stream, columns, size, late)
    broken = found.where((F.col("missing_pct") > missing_pct) | (F.col("duplicates") > 0))
    return run_to_table(broken, path, checkpoint)
