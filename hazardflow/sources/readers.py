"""File listing, CSV with differing headers, Parquet, points and feedback."""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardflow.functions.scalar import null_if_token
from hazardflow.operators.lookup import attach_written
from hazardflow.schema import EXTRA_CELL, FILE_KEY, NULL_TOKENS, REQUIRED, VARIANT
from hazardflow.session import written
from hazardflow.sources import records

INDEX_COLUMNS = ("Unnamed: 0", "_c0")


def list_inputs(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """Files whose name ends with the suffix in any case; contents are not read.

    A scan passes over files without a byte, so the names come from the file
    index of the scan and the sizes from the scan.
    """
    found = spark.read.format("binaryFile").load(folder)
    names = [re.sub(r"^(\w+):///", r"\1:/", name) for name in found.inputFiles()]
    listed = spark.createDataFrame([(n, unquote(n)) for n in names], f"{FILE_KEY} string, path string")
    sizes = found.select(
        F.col("_metadata.file_path").alias(FILE_KEY),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )
    return (
        listed.where(F.lower("path").endswith(suffix.lower()))
        .join(sizes, FILE_KEY, "left")
        .withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    )


def header_names(head: str) -> list[str]:
    """Column names of a header record: blanks are numbered, repeats get a suffix."""
    cells = next(csv.reader(io.StringIO(head.lstrip("﻿"), newline="")))
    names, seen = [], defaultdict(int)
    for i, cell in enumerate(cells):
        name = cell or f"Unnamed: {i}"
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return names


def _named_files(listed: DataFrame, splits: DataFrame) -> DataFrame:
    """_file, path, bytes, columns, status, error and opened (a quoted cell holds a line break) of every file."""

    @F.udf("struct<columns: array<string>, error: string>")
    def resolved(head):  # once per file
        try:
            names = header_names(head or "")
        except (csv.Error, StopIteration) as problem:
            return [], f"unreadable header: {problem}"
        return ([], "column names differ only in case") if len({n.lower() for n in names}) < len(names) else (names, None)

    heads = splits.groupBy(FILE_KEY).agg(
        F.max("head").alias("head"), F.max("opened").alias("opened"), F.max_by("ends_inside", "block").alias("unclosed")
    )
    joined = listed.join(heads, FILE_KEY, "left")
    found = joined.withColumn("found", resolved("head"))
    problem = F.when(F.col("unclosed"), "EOF inside a quoted cell").when(F.col("head").isNull(), "No columns to parse from file")
    return found.select(
        FILE_KEY,
        "path",
        "bytes",
        F.when(problem.isNull(), F.col("found.columns")).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.coalesce(problem, F.col("found.error")).alias("error"),
        F.coalesce("opened", F.lit(False)).alias("opened"),
    ).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def _told_apart(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns of different files whose names differ only in case stay different columns; all names in order.

    The required spelling, else the first by file name, keeps its name; others
    get a mark that outputs do not show. The driver sees each name once.
    """
    each = files.where("error IS NULL").select(FILE_KEY, F.posexplode("columns").alias("place", "name"))
    first = each.groupBy("name").agg(F.min(F.struct(FILE_KEY, "place")).alias("first")).collect()
    plain, marks, final = {n.lower(): n for n in REQUIRED}, {}, {}
    ordered = sorted((tuple(r["first"]), r["name"]) for r in first)
    for _, name in ordered:
        kept = plain.setdefault(name.lower(), name) == name
        final[name] = name if kept else f"{name}{VARIANT}{marks.setdefault(name, len(marks))}"
    changed = {a: b for a, b in final.items() if a != b}
    if changed:
        marked = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
        files = files.withColumn("columns", F.transform("columns", lambda n: F.coalesce(F.element_at(marked, n), n)))
    return files, [final[name] for _, name in ordered]


def read_csv_files(
    spark: SparkSession,
    folder: str,
    null_tokens: Sequence[str] = NULL_TOKENS,
    suffix: str = ".csv",
) -> tuple[DataFrame, DataFrame]:
    """Read every CSV file of a folder, whatever its header.

    Gives all rows as text with their file, and the file table
    (file, path, bytes, columns, status, error). Cells are read by position, all
    files in one scan, and named by a join with the file table; a file that cannot
    be read is an error row. Files with line breaks in quoted cells are read in
    splits too (`records`). Rows with more cells than the header show in the
    column `_extra`.
    """
    listed = list_inputs(spark, folder, suffix)
    full = [r["path"] for r in listed.where("bytes > 0").select("path").collect()]
    states = records.split_states(records.lines_of(spark, full)) if full else None
    splits = written(records.with_starts(states), "splits") if full else spark.createDataFrame([], SPLITS)
    files, names = _told_apart(written(_named_files(listed, splits), "files"))
    files = written(files, "files")
    table = files.select(FILE_KEY, "path", "bytes", "columns", "status", "error")
    if not names:
        return spark.createDataFrame([], f"{FILE_KEY} string, {EXTRA_CELL} string"), table
    good = files.where("error IS NULL")
    shape = good.agg(F.max(F.size("columns")).alias("width"), F.count_distinct("columns").alias("headers")).first()
    cells = _cells(spark, good, splits, shape["width"] + 1)
    if shape["headers"] == 1:
        own = good.select("columns").first()["columns"]
        value = {n: F.get("cells", F.lit(own.index(n))) for n in names}
        extra = F.get("cells", F.lit(len(own)))
    else:
        places = [(F.array_position("columns", n) - 1).cast("int") for n in map(F.lit, names)]
        cells = attach_written(cells, written(good.select(FILE_KEY, F.array(*places).alias("_places"), F.size("columns").alias("_width")), "places"), [FILE_KEY])
        value = {n: F.get("cells", F.get("_places", F.lit(i))) for i, n in enumerate(names)}
        extra = F.get("cells", F.col("_width"))
    tokens = [null_if_token(value[n], null_tokens).alias(n) for n in names]
    return cells.select(*tokens, extra.alias(EXTRA_CELL), FILE_KEY), table


def _cells(spark: SparkSession, good: DataFrame, splits: DataFrame, width: int) -> DataFrame:
    """_file and cells (by position, `width` of them) of every row of the files."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    cells = F.array(*[F.col(f"c{i}") for i in range(width)])
    plain, opened = ([r["path"] for r in good.where(f).select("path").collect()] for f in ("NOT opened", "opened"))
    parts = []
    if plain:
        rows = spark.read.schema(schema).options(header=True, **options).csv(plain)
        parts.append(rows.select(F.col("_metadata.file_path").alias(FILE_KEY), cells.alias("cells")))
    if opened:
        texts = records.cut_records(records.lines_of(spark, opened), splits.select(FILE_KEY, "block", "starts_inside"))
        parsed = texts.withColumn("c", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options))
        parts.append(parsed.select(FILE_KEY, F.array(*[F.col(f"c.c{i}") for i in range(width)]).alias("cells")))
    return reduce(DataFrame.unionByName, parts)


SPLITS = (
    f"{FILE_KEY} string, block bigint, from_outside boolean, from_inside boolean, opened boolean, head string, "
    "starts_inside boolean, ends_inside boolean"
)


def drop_index_column(frame: DataFrame) -> DataFrame:
    return frame.drop(*INDEX_COLUMNS)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_points(
    spark: SparkSession, path: str, measurement: str, fields: Sequence[str], now, last: str = "24 hours"
) -> DataFrame:
    """Recent points in long form (ts, measurement, field, value).

    Measurement and date are partition columns: other partitions are not read.
    """
    until = F.lit(now).cast("timestamp")
    since = until - F.expr(f"INTERVAL {last}")
    wanted = F.array(
        *[F.struct(F.lit(f).alias("field"), F.try_element_at("fields", F.lit(f)).alias("value")) for f in fields]
    )
    return (
        spark.read.parquet(path)
        .where(F.col("measurement") == measurement)
        .where((F.col("date") >= F.to_date(since)) & (F.col("date") <= F.to_date(until)))
        .where((F.col("ts") > since) & (F.col("ts") <= until))
        .select("ts", "measurement", F.inline(wanted))
        .where("value IS NOT NULL")
    )


def read_predictions(spark: SparkSession, path: str, now, last: str = "24 hours") -> DataFrame:
    """Recent rows of the prediction log, pruned by date."""
    until = F.lit(now).cast("timestamp")
    since = until - F.expr(f"INTERVAL {last}")
    return (
        spark.read.parquet(path)
        .where((F.col("date") >= F.to_date(since)) & (F.col("date") <= F.to_date(until)))
        .where((F.col("ts") > since) & (F.col("ts") <= until))
    )


def read_feedback(spark: SparkSession, path: str, since="2025-01-01", until=None) -> DataFrame:
    """Feedback rows after the last run."""
    rows = spark.read.parquet(path).where(F.col("timestamp") > F.lit(since).cast("timestamp"))
    return rows if until is None else rows.where(F.col("timestamp") <= F.lit(until).cast("timestamp"))


def feedback_summary(feedback: DataFrame, since, until) -> DataFrame:
    return feedback.agg(F.count("*").alias("feedback_count")).select(
        "feedback_count",
        F.lit(since).cast("timestamp").alias("start_date"),
        F.lit(until).cast("timestamp").alias("end_date"),
    )
