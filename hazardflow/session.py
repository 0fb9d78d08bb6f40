"""Session settings and the folder that every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Spark's setting that deletes the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "hazardflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hazardflow-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files at their end, not when the driver collects garbage.

    The setting goes back to what it was, so the caller's own queries keep theirs.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back.

    Cuts the lineage with files that outlive any executor, and gives the
    optimizer the true size of the table. The shuffle files behind it go at once.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        frame.write.parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back.scratch_folder = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of written frames once everything made from them is written too."""
    for frame in frames:
        folder = getattr(frame, "scratch_folder", None)
        if folder is not None:
            spark = frame.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
