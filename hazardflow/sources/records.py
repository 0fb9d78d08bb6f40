"""Records of delimited files read in splits, also when quoted cells hold line breaks.

A line ends inside or outside a quoted cell, depending on where it starts. Over one split that is a
function of two values, and functions of splits chain: one that forgets its start settles the state,
one that swaps it counts modulo two. So every split is scanned once without knowing its start, and a
running count over the splits of a file gives the start of each. Then all splits are cut into records
at once; only pieces of records that cross a split boundary are put together by file.

Both scans must cut the files alike, whatever files each of them reads and however many cores there are, so
`lines_of` cuts every file at whole multiples of one size; a split without a known start is an error.

A quote opens a cell only as its first character; what follows a closing quote belongs to the cell
(Spark's parser then gives the cell as it is written, quotes included).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardflow.schema import FILE_KEY

CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
ENDS_OUTSIDE = rf"{CELL}(?:,{CELL})*+"
LEAVES = rf'[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{CELL})*+'
WHOLE, TAIL, HEAD = 0, 1, 2
SPLIT = "spark.sql.files.maxPartitionBytes"
SPLIT_BYTES = 16 << 20


def _same_splits(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings that cuts files at multiples of one size.

    Spark else makes splits smaller by the size of all files of a scan and the number of cores.
    """
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SPLIT)))
    session.conf.set(SPLIT, str(min(size, SPLIT_BYTES)))
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    session.conf.unset("spark.sql.files.maxPartitionNum")
    return session


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """_file, block (start of the split), seq (in order within a split) and value of every line."""
    return _same_splits(spark).read.text(paths).select(
        F.col("_metadata.file_path").alias(FILE_KEY),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, first row, last row + 1) of each stretch of rows of one split."""
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or blocks[i] != blocks[start] or files[i] != files[start]:
            yield files[start], blocks[start], start, i
            start = i


def split_states(lines: DataFrame) -> DataFrame:
    """One row per split: from_outside and from_inside (whether it ends inside a quoted cell for either
    start), opened (whether a line of it does, from outside) and head (the first record, at the start of a file).

    Lines that hold no quote and cannot be part of the first record are not moved to Python.
    """
    needed = F.when((F.col("block") == 0) | F.contains("value", F.lit('"')), F.col("value"))
    outside, leaves = ENDS_OUTSIDE, LEAVES  # by value, so that workers need no copy of this package

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_outside, ends_inside = re.compile(outside).fullmatch, re.compile(leaves).fullmatch
        names = [FILE_KEY, "block", "from_outside", "from_inside", "opened", "head"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        current, rows = None, []

        def after(inside: bool, line: str) -> bool:
            return ends_inside(line) is None if inside else ends_outside(line) is None

        for batch in batches:
            values = batch.column(2)
            quoted = pc.fill_null(pc.match_substring(values, '"'), False).to_numpy(zero_copy_only=False)
            for file, block, start, stop in _runs(batch):
                if current is None or current[:2] != [file, block]:
                    if current:
                        rows.append(current[:5] + [current[5]])
                    current = [file, block, False, True, False, None, [], block == 0]
                if current[7]:  # the first record is not complete
                    for i in range(start, stop):
                        line = values[i].as_py() or ""
                        inside = bool(current[6])
                        if not inside and not line.strip("﻿ \t"):
                            continue
                        current[6].append(line)
                        if not after(inside, line):
                            current[5], current[7] = "\n".join(current[6]), False
                            break
                for i in (start + quoted[start:stop].nonzero()[0]).tolist():
                    line = values[i].as_py()
                    one = after(current[2], line)
                    current[3] = one if current[2] == current[3] else after(current[3], line)
                    current[2] = one
                    current[4] = current[4] or one
        if current:
            rows.append(current[:5] + [current[5]])
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    moved = lines.select(FILE_KEY, "block", needed.alias("value"))
    return moved.mapInArrow(
        scan, f"{FILE_KEY} string, block bigint, from_outside boolean, from_inside boolean, opened boolean, head string"
    )


def with_starts(states: DataFrame) -> DataFrame:
    """The splits with `starts_inside` and `ends_inside`, by a running count over the splits of each file."""
    order = Window.partitionBy(FILE_KEY).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.col("from_outside") & ~F.col("from_inside")
    settled = F.col("from_outside") == F.col("from_inside")
    counted = states.withColumn("swaps", F.sum(swap.cast("int")).over(order))
    last = F.last(F.when(settled, F.struct(F.col("from_outside").alias("inside"), "swaps")), ignorenulls=True).over(before)
    rows = counted.withColumns({"last": last, "passed": F.coalesce(F.lag("swaps").over(order), F.lit(0))})
    odd = (F.col("passed") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    rows = rows.withColumn("starts_inside", F.coalesce("last.inside", F.lit(False)) != odd)
    ends = F.when(F.col("starts_inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return rows.withColumn("ends_inside", ends).drop("swaps", "last", "passed")


def cut_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """_file, record: every record but the first of each file (its header), blank lines left out.

    Splits are dealt to tasks whole and read in order; a record that crosses splits comes from its pieces.
    """
    starts = splits.select(F.col(FILE_KEY).alias("file of split"), F.col("block").alias("start of split"), "starts_inside")
    same = (F.col(FILE_KEY) == F.col("file of split")) & (F.col("block") == F.col("start of split"))
    known = F.coalesce("starts_inside", F.raise_error(F.concat(F.lit("a split of unknown start: "), FILE_KEY)).cast("boolean"))
    placed = lines.join(starts, same, "left").select(FILE_KEY, "block", "seq", known.alias("starts_inside"), "value")
    placed = placed.repartition(FILE_KEY, "block").sortWithinPartitions(FILE_KEY, "block", "seq")
    outside, leaves = ENDS_OUTSIDE, LEAVES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_outside, ends_inside = re.compile(outside).fullmatch, re.compile(leaves).fullmatch
        names = [FILE_KEY, "block", "kind", "leads", "record"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        out: list[tuple] = []
        file = block = None
        held: list[str] = []
        kind, leads, inside = WHOLE, False, False

        def rest() -> None:
            if held:  # the split ends inside a cell
                out.append((file, block, TAIL if kind == TAIL else HEAD, leads, "\n".join(held)))

        for batch in batches:
            values, inside_first = batch.column(4).to_pylist(), batch.column(3)
            for own_file, own_block, start, stop in _runs(batch):
                if (own_file, own_block) != (file, block):
                    rest()
                    file, block, held = own_file, own_block, []
                    inside = inside_first[start].as_py()
                    kind, leads = (TAIL, False) if inside else (WHOLE, own_block == 0)
                for line in values[start:stop]:
                    if not inside and not held and not line.strip("﻿ \t"):
                        continue
                    if '"' in line:
                        inside = (ends_inside(line) if inside else ends_outside(line)) is None
                    if inside:
                        held.append(line)
                        continue
                    out.append((file, block, kind, leads, "\n".join([*held, line]) if held else line))
                    held, kind, leads = [], WHOLE, False
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)
            out = []
        rest()
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

    pieces = placed.mapInArrow(cut, f"{FILE_KEY} string, block bigint, kind int, leads boolean, record string")
    whole = pieces.filter(f"kind = {WHOLE} AND NOT leads").select(FILE_KEY, "record")
    order = Window.partitionBy(FILE_KEY).orderBy("block", "kind")
    crossing = pieces.filter(f"kind > {WHOLE}").withColumn("number", F.sum((F.col("kind") == HEAD).cast("int")).over(order))
    joined = crossing.groupBy(FILE_KEY, "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"), F.max("leads").alias("leads")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.unionByName(joined.filter("NOT leads").select(FILE_KEY, text.alias("record")))
