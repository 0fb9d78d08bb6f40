"""Late rows of a stream as rows: a side table instead of a count.

A watermark drops late rows and tells their number only. Here the greatest event time of every key so
far is kept in a table of its own, one version per micro-batch. A row is late when it lies further than
the delay before its key's greatest time in earlier batches; it goes to a side table with that limit.

Every batch writes three folders named by its number (rows, late, limits), so a repeated batch replaces
what it wrote and reads the same limits: each row ends in one table, once. The times are merged per
task before they are shuffled and joined back by broadcast up to a checked size, by salted keys beyond
it, so a hot key is no single task. Rows without a time are never late; a NULL key is a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazardflow.operators.lookup import attach_written, named
from hazardflow.session import discard, written


def split_late(
    stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str, delay: str = "1 hour", ts: str = "ts", first: int = 0
) -> StreamingQuery:
    """Write the rows in time to <out>/rows and the late ones, with `limit`, to <out>/late.

    `first` is the number of the query's first micro-batch (0 with a new checkpoint).
    """
    keys = list(keys)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = written(batch, "arrived")
        top = rows.groupBy(*[named(k) for k in keys]).agg(F.max(named(ts)).alias("greatest"))
        if number > first:
            before = spark.read.schema(top.schema).parquet(f"{out}/limits/batch={number - 1}")
            tagged = attach_written(rows, before, keys).withColumn("limit", F.col("greatest") - F.expr(f"INTERVAL {delay}"))
            top = before.unionByName(top).groupBy(*[named(k) for k in keys]).agg(F.max("greatest").alias("greatest"))
        else:
            tagged = rows.withColumns({"greatest": F.lit(None).cast("timestamp"), "limit": F.lit(None).cast("timestamp")})
        late = F.coalesce(named(ts) < F.col("limit"), F.lit(False))
        tagged.where(~late).drop("greatest", "limit").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        tagged.where(late).drop("greatest").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        top.write.mode("overwrite").parquet(f"{out}/limits/batch={number}")
        discard(rows)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
