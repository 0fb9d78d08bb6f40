"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed by decreasing size; among the open sequences that can take a piece
under every capacity, one is chosen by the least weighted norm of what would remain ("norm") or by
the largest weighted dot product of demand and residual ("dot"). The weight of a capacity is its
share of the group's mean demand, so a capacity that cannot bind hardly counts.

Scale: pieces go to balanced groups by a hash of the row; a group is packed in one task and wastes
at most about one part-filled sequence, so groups of thousands of pieces cost nothing measurable.

Edge cases: a null text is empty; a document always has at least its end id, so every row gives a
piece; rows that repeat are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardflow.llm.common import group_count
from hazardflow.llm.word_ids import with_ids

CAPACITY = 4096
GROUP_BYTES = 24 << 20
GROUP_ROWS = 10_000


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = 1, size: int = 4) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned, `size` bytes each).

    Only a document longer than the capacity is cut, losslessly, into full pieces and a rest.
    """
    width = size * capacity
    whole = with_ids(docs, path, end_id, size)
    last = F.greatest(F.ceil(F.length("all_ids") / F.lit(width)).cast("int") - 1, F.lit(0))
    cut = whole.select("doc_id", "all_ids", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    ids = F.expr(f"substring(all_ids, piece * {width} + 1, {width})")
    return cut.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), ids.alias("ids")
    ).select("doc_id", "piece", "start", (F.length("ids") / size).cast("long").alias("length"), "ids")


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of one group."""
    caps = np.array(capacities, float)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / caps
    if len(lengths) and demand.max() > 1 + 1e-9:
        raise ValueError("a piece is larger than a sequence may be")
    weight = demand.mean(0)
    weight = weight / weight.sum()
    order = np.argsort(-(demand**2 @ weight), kind="stable")
    least = demand.min(0)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((256, 3))
    number = np.empty(256, np.int64)
    filled = np.zeros(len(lengths), np.int64)
    opened = live = 0
    for step, i in enumerate(order):
        need = demand[i]
        left = room[:live] - need
        fits = (left >= -1e-9).all(1)
        if fits.any():
            score = left**2 @ weight if rule == "norm" else -(room[:live] @ (weight * need))
            at = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            if live == len(room):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
            room[live], number[live] = 1.0, opened
            at, live, opened = live, live + 1, opened + 1
        room[at] -= need
        sequence[i], offset[i] = number[at], filled[number[at]]
        filled[number[at]] += lengths[i]
        if step % 512 == 511:  # sequences that no piece fits any more
            keep = (room[:live] >= least - 1e-9).all(1)
            kept = int(keep.sum())
            room[:kept], number[:kept] = room[:live][keep], number[:live][keep]
            live = kept
    return sequence, offset


def pack(
    pieces: DataFrame,
    groups: int,
    capacity: int = CAPACITY,
    documents: int | None = None,
    attention: int | None = None,
    rule: str = "norm",
) -> DataFrame:
    """The pieces with sequence_id and offset; columns of these names are replaced.

    documents and attention default to values that the token capacity implies.
    """
    capacities = (capacity, documents or capacity, attention or capacity * capacity)
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    flat = [f.name for f in pieces.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = pieces.withColumn("packing group", F.pmod(F.xxhash64(*flat), F.lit(groups)))

    def place(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).select(names)
        sequence, offset = best_fit(held["length"].to_numpy(), capacities, rule)
        held = held.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32)))
        yield from held.append_column("offset", pa.array(offset)).to_batches()

    return dealt.groupBy("packing group").applyInArrow(place, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = pieces_of(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, group_count(docs, "text", GROUP_BYTES, GROUP_ROWS), capacity)
