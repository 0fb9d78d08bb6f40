"""Best-fit-decreasing packing of token ids into fixed rows, written as binary matrices.

Pieces of a group are placed by decreasing length, each into the open row with the least room that
still holds it; a segment tree over the room left (0 to capacity) finds that room in logarithmic
time. Each row has `capacity` ids (padded), the cumulative lengths of its segments and a position
for every id that starts again at 0 with every segment.

Documents longer than a row are cut losslessly. Groups are balanced by a hash of the row and
bounded in bytes, so one task holds a few tens of megabytes however large the table is; the ids
are shuffled once, at the narrowest width that holds the vocabulary.

Edge cases: a null or empty text is its end id alone (no row without an end id); rows that repeat
are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import group_count
from hazardflow.llm.vector_packing import CAPACITY, pieces_of

GROUP_BYTES = 24 << 20
GROUP_ROWS = 10_000
SCHEMA = (
    "sequence_id long, n_tokens long, n_segments int, ids binary, cumulative array<int>, positions binary, "
    "doc_ids array<{kind}>, pieces array<int>"
)


class RoomTree:
    """Counts of open rows by room left; finds the least room that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        at, count = need + self.size, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces (by position) of each row, in the order they were placed."""
    tree, by_room, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.least(need)
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > need:
            by_room[room - need].append(row)
            tree.add(room - need, 1)
    return rows


def token_rows(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = 1, pad_id: int = 0, width: int = 2) -> DataFrame:
    """One row per packed sequence.

    sequence_id; n_tokens (without padding); n_segments; ids and positions: `capacity`
    little-endian numbers of `width` bytes; cumulative: 0 and the end of each segment; doc_ids and
    pieces: what each segment is. width 2 needs ids and capacity below 65536.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    number = {2: "<u2", 4: "<u4"}[width]

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        ids = [np.frombuffer(x, number) for chunk in held["ids"].chunks for x in chunk.to_pylist()]
        docs_of, piece_of = held["doc_id"].to_pylist(), held["piece"].to_pylist()
        rows = best_fit_decreasing([len(x) for x in ids], capacity)
        for at in range(0, len(rows), 256):
            out = []
            for row, members in enumerate(rows[at : at + 256], at):
                ends = np.cumsum([0] + [len(ids[i]) for i in members])
                matrix, positions = np.full(capacity, pad_id, number), np.zeros(capacity, number)
                for i, start, end in zip(members, ends[:-1], ends[1:], strict=True):
                    matrix[start:end] = ids[i]
                    positions[start:end] = np.arange(end - start)
                out.append((row + (key[0].as_py() << 32), int(ends[-1]), len(members), matrix.tobytes(), ends.tolist(), positions.tobytes(), [docs_of[i] for i in members], [piece_of[i] for i in members]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(held.schema.field("doc_id").type), pa.list_(pa.int32())]
            names = ["sequence_id", "n_tokens", "n_segments", "ids", "cumulative", "positions", "doc_ids", "pieces"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    groups = group_count(docs, "text", GROUP_BYTES, GROUP_ROWS)
    pieces = pieces_of(docs, path, capacity, end_id, width).filter("length > 0").select("doc_id", "piece", "ids")
    dealt = pieces.withColumn("packing group", F.pmod(F.xxhash64("doc_id", "piece", F.crc32("ids")), F.lit(groups)))
    return dealt.groupBy("packing group").applyInArrow(fill, SCHEMA.format(kind=kind))


def write_token_rows(docs: DataFrame, folder: str, path: str, **options) -> DataFrame:
    """Write the packed rows as Parquet (ids and positions stay binary matrices) and read them back."""
    token_rows(docs, path, **options).write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
