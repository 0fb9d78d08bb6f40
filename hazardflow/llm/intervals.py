"""Removal of byte strings that also occur in an earlier document, by interval expansion on a BWT.

A byte goes if a `least`-byte string that covers it also starts in a document with a smaller id.

1. Texts are made distinct (per task first, so copies travel once) and dealt into chunks by content.
2. Every window of `least` bytes is routed by its minimizer, the smallest hash of the 16-byte strings
   inside it: equal windows have equal minimizers, and neighbouring windows mostly share one, so a
   text becomes runs of windows. Per chunk, the distinct minimizers are compared by hash bucket;
   only those of two different texts matter further.
3. For these, every distinct run of a chunk goes to the block of its minimizer, from the chunk's
   smallest document that holds it; other documents of the chunk have an earlier one already.
4. A block builds the Burrows-Wheeler transform of its runs and derives the common prefixes of
   neighbouring suffixes by increasing value: the first 8 from the sorted 8-byte starts, the others
   by extending intervals backward, breadth first, one byte a level, and stops at `least`. What has
   no value by then is a class of equal windows; its smallest document keeps them, others lose them.
5. The spans come back to the chunks, which cut the texts.

Scale: the text is shuffled once; the same exchange serves steps 2, 3 and 5. Chunks, buckets and
blocks are bounded in bytes whatever the table's size. A minimizer met more than HOT times (a passage
that many documents share, in many surroundings) is not dealt as runs: its windows are keyed one by
one by their own hash and merged per chunk, which bounds every group by the number of chunks.

Edge cases: null and empty texts are empty; texts below `least` bytes stay; later copies of a whole
text lose all of it; rows that repeat an id count as one document and lose nothing to each other; a
null id neither removes nor loses anything; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import as_bytes, no_cycles, plain_bytes, settle, sliced
from hazardflow.session import written

LEAST = 50
GRAM = 16
CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
SLICE = 1 << 20
BWT_BYTES = 1 << 19  # the arrays of one transform stay in the processor's caches
HOT = 20_000
LONGEST_RUN = 256
END = 0xFF  # no byte of UTF-8 text
FIRST_LEVEL = 8


# Step 2: runs of windows with one minimizer.


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at every place."""
    words = np.array(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)))
    hashed = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    hashed += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    return hashed


def runs(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[np.ndarray, ...]]:
    """text number, first window, windows and minimizer of all runs, slice by slice."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def found():
        data = np.frombuffer(b"".join([h[2] for h in held]), np.uint8)
        lengths = np.array([len(h[2]) for h in held])
        starts = np.cumsum(lengths) - lengths
        low = _grams(data)
        width, span = least - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        counts = lengths - least + 1
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())  # windows inside one text
        value, owner = low[at], np.repeat(np.arange(len(held)), counts)
        first = np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) + 1])
        sizes = np.diff(np.append(first, len(value)))
        if sizes.max() > LONGEST_RUN:
            parts = -(-sizes // LONGEST_RUN)
            number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            sizes = np.minimum(np.repeat(sizes, parts) - number * LONGEST_RUN, LONGEST_RUN)
            first = np.repeat(first, parts) + number * LONGEST_RUN
        mine = owner[first]
        place = at[first] - starts[mine] + np.array([h[1] for h in held])[mine]
        return np.array([h[0] for h in held])[mine], place, sizes, value[first]

    for number, text in enumerate(texts):
        for start in range(0, max(0, len(text) - least + 1), SLICE):
            part = text[start : start + SLICE + least - 1]
            held.append((number, start, part))
            size += len(part)
            if size >= SLICE:
                yield found()
                held, size = [], 0
    if held:
        yield found()


# Step 4: classes of equal windows of a block.


def window_classes(strings: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Place in the joined strings (each with one end byte) of every suffix in sorted order, and its class.

    Two suffixes have one class if they share their first `least` bytes.
    """
    text = np.frombuffer(bytes([END]).join(strings) + bytes([END]) * (least + 16), np.uint8)
    n = sum(map(len, strings)) + len(strings)
    key = np.ndarray(n, ">u8", text, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    rank, depth = _ranks(key, order), 8
    while depth < least:
        follow = np.full(n, n, np.int64)
        follow[: n - depth] = rank[depth:]
        pair = rank * (n + 1) + follow
        order = np.argsort(pair)
        rank, depth = _ranks(pair, order), 2 * depth
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    back = inverse[order - 1]  # where the suffix that starts one byte earlier stands
    front = text[:n][order]
    common = np.full(n + 1, -1, np.int16)
    common[0] = common[n] = 0
    ordered = key[order]
    differ = ordered[1:] ^ ordered[:-1]
    split = np.flatnonzero(differ) + 1
    differ = differ[split - 1]
    common[split] = sum((differ >> np.uint64(64 - 8 * b) == 0).astype(np.int16) for b in range(1, 8))
    # the intervals of 8-byte strings that end at a value of 7 are the agenda of level 8
    edges = np.concatenate([[0], split, [n]])
    keep = common[edges[1:]] == FIRST_LEVEL - 1
    active = _members(edges[:-1][keep], edges[1:][keep])
    owner = np.repeat(np.arange(int(keep.sum())), (edges[1:] - edges[:-1])[keep])
    label = np.empty(n, np.int64)
    for level in range(FIRST_LEVEL, least):
        if not len(active):
            break
        target = back[active]
        label[target] = owner
        target.sort()
        mine, letter = label[target], front[target]
        last = np.concatenate([(target[1:] != target[:-1] + 1) | (mine[1:] != mine[:-1]) | (letter[1:] != letter[:-1]), [True]])
        ends = target[last] + 1
        fresh = common[ends] < 0
        common[ends[fresh]] = level
        number = np.concatenate([[0], np.cumsum(last)[:-1]])
        stay = fresh[number]
        active, owner = target[stay], number[stay]
    return order, np.cumsum(common[:n] >= 0)


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys."""
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return rank


def _members(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sizes = stop - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def covered(strings: list[bytes], windows: np.ndarray, docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that also occur in a smaller document: row, first window, end.

    Row i is a string with its count of windows and its document; rows may share a string.
    """
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(s, len(number)) for s in strings])
    distinct = list(number)
    count = np.zeros(len(distinct), np.int64)
    count[of] = windows
    smallest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(smallest, of, docs)
    order, group = window_classes(distinct, least)
    lengths = np.array([len(s) + 1 for s in distinct])
    begins = np.cumsum(lengths) - lengths
    window = _members(begins, begins + count)  # places of the windows, string by string
    holder = np.repeat(np.arange(len(distinct)), count)
    class_at = np.empty(len(order), np.int64)
    class_at[order] = group
    found = class_at[window]
    best = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, found, smallest[holder])
    least_doc = best[found]
    first = np.cumsum(count) - count
    each = _members(first[of], first[of] + count[of])
    row = np.repeat(np.arange(len(strings)), count[of])
    goes = least_doc[each] < docs[row]
    if not goes.any():
        return (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(np.concatenate([[True], (goes[1:] != goes[:-1]) | (row[1:] != row[:-1]), [True]]))
    start, stop = edge[:-1][goes[edge[:-1]]], edge[1:][goes[edge[:-1]]]
    base = (np.cumsum(count[of]) - count[of])[row[start]]
    return row[start], start - base, stop - base


# The distributed job.


def _distinct_texts(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, k1, k2 (the text's hashes), text, doc_id; copies in one task travel without their text."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in sliced(batches, 8 << 20):
            keys = zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), strict=True)
            keep, again = [], []
            for i, (key, doc) in enumerate(zip(keys, batch["doc_id"].to_pylist(), strict=True)):
                known = seen.get(key)
                if known is None or doc < known:
                    seen[key] = doc
                    keep.append(i)
                    again.append(known is not None)
            rows = batch.take(pa.array(keep, pa.int64()))
            text = pa.array([None if a else t for a, t in zip(again, as_bytes(rows["text"]), strict=True)], pa.binary())
            yield pa.record_batch([rows["chunk"], rows["k1"], rows["k2"], text, rows["doc_id"]], ["chunk", "k1", "k2", "text", "doc_id"])

    keyed = keyed_texts(docs).filter("doc_id is not null").select("doc_id", "k1", "k2", F.col("text"))
    dealt = keyed.withColumn("chunk", F.pmod("k1", F.lit(chunks)).cast("int"))
    merged = dealt.mapInArrow(merge, "chunk int, k1 long, k2 long, text binary, doc_id long")
    return merged.repartition(chunks, "chunk")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long), text (null: empty) and its two hashes k1, k2."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(1))}
    )


def _texts(held: pa.Table) -> tuple[list[tuple[int, int]], list[bytes], np.ndarray]:
    """Keys, texts and smallest documents of a chunk, by document: the same order in every step."""
    first: dict[tuple[int, int], int] = {}
    text: dict[tuple[int, int], bytes] = {}
    columns = [held[c].to_pylist() for c in ("k1", "k2", "doc_id", "text")]
    for k1, k2, doc, value in zip(*columns, strict=True):
        key = (k1, k2)
        first[key] = min(doc, first.get(key, doc))
        if value is not None:
            text[key] = value
    keys = sorted(first, key=lambda k: (first[k], k))
    return keys, [text[k] for k in keys], np.array([first[k] for k in keys], np.int64)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each is there (uint32: a chunk has fewer texts)."""
    value = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[first], np.diff(np.append(first, len(value))).astype(np.uint32)


def removed_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """One row per distinct text: k1, k2, doc_id (the smallest), spans (start, stop in bytes), kept (bytes).

    The spans hold for the smallest document of a text; its later copies lose all of it. With
    whole_characters, spans shrink to the characters they cover in full.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets, blocks = (max(1, -(-total // size)) for size in (CHUNK_BYTES, CHUNK_BYTES, BLOCK_BYTES))
    texts = _distinct_texts(docs, chunks)

    def minimizers(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, values, _ = _texts(pa.Table.from_batches(list(batches)))
        seen = [np.zeros(0, np.uint64)]
        for number, _, _, value in runs(values, least):
            seen.append(_once_per_text(value, number))
        value, times = _counted(np.concatenate(seen))
        bucket = (value >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        value, times = value[order], times[order]
        stops = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        out = [(b, key[0].as_py(), value[i:j].tobytes(), times[i:j].tobytes()) for b, (i, j) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)) if j > i]
        for at in range(0, len(out), 1000):
            rows = list(zip(*out[at : at + 1000], strict=True))
            yield pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], ["bucket", "chunk", "hashes", "times"])

    def shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        hashes = [np.frombuffer(x, np.uint64) for x in held["hashes"].to_pylist()]
        value = np.concatenate(hashes)
        times = np.frombuffer(b"".join(held["times"].to_pylist()), np.uint32).astype(np.int64)
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
        total_times = np.add.reduceat(times[order], first)
        state = np.where(total_times > hot, 2, np.where(total_times > 1, 1, 0)).astype(np.uint8)
        of = np.empty(len(value), np.uint8)
        of[order] = np.repeat(state, np.diff(np.append(first, len(value))))
        at, out = 0, []
        for chunk, own in zip(held["chunk"].to_pylist(), hashes, strict=True):
            flags = of[at : at + len(own)]
            at += len(own)
            if flags.any():
                out.append((chunk, own[flags > 0].tobytes(), flags[flags > 0].tobytes()))
        if out:
            rows = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["chunk", "hashes", "flags"])

    def send(held: pa.Table, marks: pa.Table) -> pa.Table:
        out = {name: [] for name in ("block", "route", "string", "windows", "doc_id", "chunk", "number", "start")}
        if held.num_rows and marks.num_rows:
            chunk = held["chunk"][0].as_py()
            value = np.frombuffer(b"".join(marks["hashes"].to_pylist()), np.uint64)
            flag = np.frombuffer(b"".join(marks["flags"].to_pylist()), np.uint8)
            order = np.argsort(value)
            value, flag = value[order], flag[order]
            _, texts_of, docs_of = _texts(held)
            with no_cycles():
                _send(out, chunk, texts_of, docs_of.tolist(), value, flag, blocks, least)
        settle()
        return _sent(out)

    def expand(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).combine_chunks()
        done = held["windows"].to_numpy() < 0
        settled = held.filter(pa.array(done))
        parts = [(settled["chunk"].to_numpy(), settled["number"].to_numpy(), settled["start"].to_numpy(), settled["start"].to_numpy() - settled["windows"].to_numpy() + least - 1)]
        open_ = held.filter(pa.array(~done))
        if open_.num_rows:
            open_ = open_.take(pa.array(np.argsort(open_["route"].to_numpy(), kind="stable")))
            route, strings = open_["route"].to_numpy(), plain_bytes(_flat(open_["string"]))
            sizes = np.fromiter(map(len, strings), np.int64, len(strings))
            filled = np.cumsum(sizes)
            begin = 0
            changes = np.append(np.flatnonzero(route[1:] != route[:-1]) + 1, len(route))
            while begin < len(route):
                base = filled[begin] - sizes[begin]
                fits = changes[(changes > begin) & (filled[changes - 1] - base <= BWT_BYTES)]
                stop = int(fits[-1]) if len(fits) else int(changes[np.searchsorted(changes, begin, "right")])
                part = open_.slice(begin, stop - begin)
                row, first, end = covered(strings[begin:stop], part["windows"].to_numpy(), part["doc_id"].to_numpy(), least)
                start = part["start"].to_numpy()[row]
                parts.append((part["chunk"].to_numpy()[row], part["number"].to_numpy()[row], start + first, start + end + least - 1))
                begin = stop
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        names = ["chunk", "number", "start", "stop"]
        yield pa.record_batch([pa.array(c, pa.int32() if n in ("chunk", "number") else pa.int64()) for c, n in zip(columns, names, strict=True)], names)
        settle()

    def cut(held: pa.Table, spans: pa.Table) -> pa.Table:
        keys, values, docs_of = _texts(held) if held.num_rows else ([], [], np.zeros(0, np.int64))
        order = np.lexsort((spans["start"].to_numpy(), spans["number"].to_numpy()))
        own: dict[int, list[list[int]]] = {}
        rows = spans.take(pa.array(order))
        for number, start, stop in zip(*[rows[c].to_pylist() for c in ("number", "start", "stop")], strict=True):
            mine = own.setdefault(number, [])
            if mine and start <= mine[-1][1]:
                mine[-1][1] = max(stop, mine[-1][1])
            else:
                mine.append([start, stop])
        found = [own.get(i, []) for i in range(len(keys))]
        if whole_characters:
            found = [_shrunk(t, s) for t, s in zip(values, found, strict=True)]
        kept = [_without(t, s) for t, s in zip(values, found, strict=True)]
        columns = [
            pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(docs_of, pa.int64()),
            pa.array([[{"start": a, "stop": b} for a, b in s] for s in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            pa.array(kept, pa.binary()),
        ]
        return pa.table(columns, ["k1", "k2", "doc_id", "spans", "kept"])

    by_bucket = texts.groupBy("chunk").applyInArrow(minimizers, "bucket int, chunk int, hashes binary, times binary")
    marks = by_bucket.groupBy("bucket").applyInArrow(shared, "chunk int, hashes binary, flags binary")
    sent = texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send, SENT)
    spans = sent.groupBy("block").applyInArrow(expand, "chunk int, number int, start long, stop long")
    result = "k1 long, k2 long, doc_id long, spans array<struct<start: long, stop: long>>, kept binary"
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, result)


SENT = "block int, route long, string binary, windows long, doc_id long, chunk int, number int, start long"


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _once_per_text(value: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The minimizers of a slice, each once for every text that has it."""
    order = np.lexsort((number, value))
    value, number = value[order], number[order]
    return value[np.concatenate([[True], (value[1:] != value[:-1]) | (number[1:] != number[:-1])])]


def _send(out, chunk, texts, docs, value, flag, blocks, least) -> None:
    """Runs of shared minimizers for the blocks; texts come by increasing document."""
    holder: dict[tuple[int, bytes], int] = {}
    columns = list(out.values())
    sizes = np.uint64(blocks)

    def add(block: int, route: int, string: bytes, windows: int, text: int, start: int) -> None:
        row = (block, route, string, windows, docs[text], chunk, text, start)
        for column, x in zip(columns, row, strict=True):
            column.append(x)

    def offer(route: int, block: int, string: bytes, windows: int, text: int, start: int) -> None:
        first = holder.setdefault((route, string), text)
        if docs[first] < docs[text]:  # an earlier document of this chunk has all of it
            add(block, 0, b"", -windows, text, start)
        else:
            add(block, route, string, windows, text, start)

    for number, start, count, own in runs(texts, least):
        at = np.searchsorted(value, own)
        at[at == len(value)] = 0
        hit = np.flatnonzero(value[at] == own)
        route = own[hit].view(np.int64).tolist()
        block = (own[hit] % sizes).astype(np.int64).tolist()
        hot = (flag[at[hit]] == 2).tolist()
        for r, b, h, text, s, n in zip(route, block, hot, number[hit].tolist(), start[hit].tolist(), count[hit].tolist(), strict=True):
            string = texts[text][s : s + n + least - 1]
            if not h:
                offer(r, b, string, n, text, s)
                continue
            for i in range(n):
                window = string[i : i + least]
                code = _code(window)
                offer(code, code % blocks, window, 1, text, s + i)


def _code(window: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window) >> 1


def _sent(out: dict[str, list]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))


def _shrunk(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    out = []
    for start, stop in spans:
        while start < stop and text[start] & 0xC0 == 0x80:
            start += 1
        while start < stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append([start, stop])
    return out


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *[e for span in spans for e in span], len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = removed_spans(docs, least).select(
        "k1", "k2", F.col("doc_id").alias("first_id"), F.size("spans").cast("long").alias("spans_of"),
        F.octet_length("kept").cast("long").alias("bytes_of"), F.sha2("kept", 256).alias("sha_of"),
    )
    own = F.when(F.col("doc_id").isNull(), F.sha2("text", 256)).alias("own_sha")
    rows = keyed_texts(docs).select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), own)
    joined = rows.join(found, ["k1", "k2"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= least)
    alone = F.col("doc_id").isNull()
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(alone, zero).when(copy, F.col("n_bytes")).otherwise(F.col("n_bytes") - F.col("bytes_of")).alias("n_removed"),
        F.when(alone, zero).when(copy, F.lit(1).cast("long")).otherwise(F.col("spans_of")).alias("n_spans"),
        F.when(alone, F.col("own_sha")).when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha_of")).alias("kept_sha256"),
    )


def _cut_out(text: Column, spans: Column) -> Column:
    """The text without the byte ranges of `spans` (sorted, apart, whole characters; null: none)."""
    data = text.cast("binary")
    spans = F.coalesce(spans, F.array().cast("array<struct<start: long, stop: long>>"))

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"].cast("int"))
        stop = F.when(i == F.size(spans), F.octet_length(text)).otherwise(F.get(spans, i)["start"].cast("int"))
        return F.substring(data, begin + 1, stop - begin).cast("string")

    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), piece)
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def cleaned_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows with repeated passages cut out of their text (whole characters only).

    All columns stay; n_chars, if there is one, is counted anew. The spans are written as a narrow
    table and joined to the rows by its true size; the cut texts themselves are not shuffled.
    """
    names = docs.columns
    found = removed_spans(docs, least, whole_characters=True).select("k1", "k2", F.col("doc_id").alias("first_id"), "spans")
    found = written(found, "spans")
    whole = F.col("row")["text"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))
    joined = rows.join(found, ["k1", "k2"], "left")
    doc = F.col("row")["doc_id"].cast("long")
    copy = (doc > F.col("first_id")) & (F.octet_length(whole) >= least)
    cut = F.when(doc.isNull() | F.col("first_id").isNull() | whole.isNull(), whole).when(copy, F.lit("")).otherwise(_cut_out(whole, F.col("spans")))
    cleaned = joined.select("row", cut.alias("cut"))
    columns = {n: F.col("row").getField(n) for n in names} | {"text": F.col("cut")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[c.alias(n) for n, c in columns.items()])
