"""Token counts of whole texts without materialising ids.

Pieces never cross from a character into a following space, so a text is the sequence of its
pre-tokens: a run of spaces and the characters up to the next space (the first has the space that
the library puts before a text). Every distinct pre-token of the corpus is counted once by the
library; per-document frequencies of pre-tokens are joined to these counts and summed.

Scale: one pass counts pre-tokens (merged per task, so a hot one is a row per task). The commonest
pre-tokens, at most HEAD of at most HEAD_BYTES bytes each, go to the tasks of the second pass as a
dictionary of proven size; only the rest of a document's frequencies is shuffled and joined, so no
frequent key is ever dealt out and nothing that grows with the corpus is broadcast.

Edge cases: null and empty texts have no tokens; rows that repeat an id are counted each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import distinct_words, plain_bytes, sliced, space_lists
from hazardflow.session import written

HEAD = 200_000
HEAD_BYTES = 40
FLUSH = 300_000
_LIBRARY: dict[str, object] = {}


def library(path: str):
    """The sentencepiece processor; a model whose pieces could join pre-tokens is refused."""
    if path not in _LIBRARY:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or model.encode(" a  b", out_type=str)[0][0] != "▁":
            raise ValueError(f"{path}: pieces cross spaces, or spaces are not kept")
        _LIBRARY[path] = model
    return _LIBRARY[path]


def distinct_pre_tokens(docs: DataFrame) -> DataFrame:
    """pre_token binary, n: how often it occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            keys = sorted(seen)
            return pa.record_batch([pa.array(keys, pa.binary()), pa.array([seen[k] for k in keys], pa.int64())], ["pre_token", "n"])

        for batch in sliced(batches, 16 << 20):
            found = pc.value_counts(space_lists(batch.column(0)).flatten())
            for key, n in zip(plain_bytes(found.field("values")), found.field("counts").to_numpy().tolist(), strict=True):
                seen[key] += n
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
        yield rows()

    each = docs.select("text").mapInArrow(count, "pre_token binary, n long")
    return each.groupBy("pre_token").agg(F.sum("n").alias("n"))


def with_pieces(vocabulary: DataFrame, path: str) -> DataFrame:
    """The distinct pre-tokens with `pieces`, counted by the library in Arrow batches."""

    @F.arrow_udf("int")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = library(path)
        lone = len(model.encode("a ")) - len(model.encode("a"))  # the space before nothing
        for keys in batches:
            found = model.encode(keys.cast(pa.string()).to_pylist(), num_threads=1)
            yield pa.array([len(ids) or lone for ids in found], pa.int32())

    return vocabulary.withColumn("pieces", pieces("pre_token"))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    spark = docs.sparkSession
    vocabulary = written(with_pieces(distinct_pre_tokens(docs), path), "pre-tokens")
    short = vocabulary.filter(F.length("pre_token") <= HEAD_BYTES)
    common = short.orderBy(F.desc("n"), "pre_token").limit(head).select("pre_token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(common["pre_token"].to_pylist(), common["pieces"].to_pylist(), strict=True)))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = known.value.get
        row = TaskContext.get().partitionId() << 36  # a number for each row, the same in every attempt
        for batch in sliced(batches, 8 << 20):
            texts = batch.column(1)
            lists = space_lists(texts)
            keys, codes = distinct_words(lists)
            pieces = np.array([look(k, -1) for k in keys], np.int64)
            codes, owner = codes.to_numpy(), pc.list_parent_indices(lists).to_numpy()
            found = pieces[codes] if len(keys) else np.zeros(0, np.int64)
            sums = np.bincount(owner, np.maximum(found, 0), batch.num_rows).astype(np.int64)
            rest, times = np.unique(owner[found < 0].astype(np.int64) * max(len(keys), 1) + codes[found < 0], return_counts=True)
            at, key = rest // max(len(keys), 1), rest % max(len(keys), 1)
            rows = row + np.arange(batch.num_rows)
            row += batch.num_rows
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            own = pa.array([b"\xff%d" % r for r in rows], pa.binary())  # no text: finds no partner, spreads evenly
            tail = pa.array(keys, pa.binary()).take(pa.array(key))
            zeros = np.zeros(len(rest), np.int64)
            columns = [
                pa.concat_arrays([batch.column(0), batch.column(0).take(pa.array(at))]),
                np.concatenate([rows, rows[at]]),
                pa.concat_arrays([own, tail]),
                np.concatenate([np.zeros(batch.num_rows, np.int64), times]),
                np.concatenate([sizes, zeros]),
                np.concatenate([sums, zeros]),
            ]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["doc_id", "row", "pre_token", "times", "n_bytes", "known"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "text").mapInArrow(resolve, f"doc_id {kind}, row long, pre_token binary, times long, n_bytes long, known long")
    joined = parts.join(vocabulary.select("pre_token", "pieces"), "pre_token", "left")
    total = F.sum(F.col("known") + F.coalesce(F.col("times") * F.col("pieces"), F.lit(0)))
    counted = joined.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
