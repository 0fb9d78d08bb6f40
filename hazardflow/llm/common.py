"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BATCH_ROWS = 1000
MARK = "▁"
RUNS = re.compile(" *[^ ]+| +")


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on: texts are long, and a batch is held more than once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def settle() -> None:
    """Give free memory back: a worker may wait long for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; folder is a parameter, never copied into the repository."""
    if folder is not None:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `size` bytes (one row at least), so that results stay small too."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    settle()


def distinct_words(lists: pa.ListArray) -> tuple[list[bytes], pa.Array]:
    """The distinct values of an array of lists, and for each value in order its number among them."""
    coded = lists.flatten().dictionary_encode()
    return plain_bytes(coded.dictionary), coded.indices


def plain_bytes(values: pa.Array) -> list[bytes]:
    """The values of a string or binary array without nulls."""
    return values.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """The values dealt into lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


@contextmanager
def no_cycles():
    """Without searches for reference cycles: look-ups keep many small objects and make none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def looked_up(lists: pa.ListArray, look: Callable[[list[bytes]], pa.Array]) -> pa.ListArray:
    """The lists with each value replaced; `look` gets the distinct values only."""
    words, codes = distinct_words(lists)
    return pa.ListArray.from_arrays(list_offsets(lists), look(words).take(codes))


def list_offsets(lists: pa.ListArray) -> pa.Array:
    starts = lists.offsets
    return pc.subtract(starts, starts[0]) if len(starts) and starts[0].as_py() else starts


def space_lists(texts: pa.Array) -> pa.ListArray:
    """Pre-tokens of each text: a run of spaces with what follows it, without the first space.

    A text gets one space in front; the word mark of sentencepiece counts as a space. Null and
    empty texts have no pre-tokens.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    if not pc.any(runs).as_py():
        lists = pc.split_pattern(texts, " ")
    elif not pc.any(pc.match_substring(texts, "\0")).as_py():
        lists = pc.split_pattern(pc.replace_substring_regex(texts, "([^ ]) ", "\\1\0"), "\0")
    else:
        lists = pa.array([[run[1:] for run in RUNS.findall(" " + t)] for t in texts.to_pylist()], pa.list_(pa.string()))
    empty = pc.equal(pc.binary_length(texts), 0)
    if pc.any(empty).as_py():  # splitting an empty text gives one empty part
        sizes = pc.if_else(empty, 0, pc.list_value_length(lists))
        kept = lists.flatten().filter(pc.invert(empty).take(pc.list_parent_indices(lists)))
        starts = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        lists = pa.ListArray.from_arrays(starts, kept)
    return lists


def group_count(texts: DataFrame, column: str, group_bytes: int, group_rows: int) -> int:
    """How many groups hold the table at the given mean size, from one narrow aggregate."""
    size = texts.agg(F.sum(F.octet_length(column)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, -(-(size["b"] or 0) // group_bytes), -(-size["n"] // group_rows))
