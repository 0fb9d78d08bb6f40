"""Encoding and decoding with a merge-type sentencepiece vocabulary.

Encoding is the score-ordered agenda: all adjacent symbol pairs that form a piece wait, the best
score (leftmost on ties) is merged, and the pairs around the new symbol join the agenda. Short
pre-tokens of an Arrow batch are merged together, each with its own agenda; for long ones and
unknown characters the agenda is a heap.
Characters that are no piece become their UTF-8 bytes. A pre-token (a run of spaces and what
follows up to the next space) never merges with its neighbours, and neither does a character that
occurs in no longer piece, so each is encoded alone and kept by the worker (a bounded dictionary).
Every newly met pre-token of an Arrow batch is also encoded and decoded by the library in one call;
where the two differ, the query fails and names the first that does.

Edge cases: null is empty and has no ids; the word mark in a text counts as a space, as in the
library; rows that repeat are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hazardflow.llm.common import distinct_words, list_offsets, lists_of, no_cycles, plain_bytes, sliced, space_lists
from hazardflow.llm.merges import MergeTable
from hazardflow.llm.token_counts import library

MAX_PRE_TOKENS = 250_000
LONG = 100
SPACE = "▁"
_LOADED: dict[str, PieceCodec] = {}


class PieceCodec:
    """Ids and decoded text of pre-tokens, kept as (decimal ids joined by commas, decoded UTF-8)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = library(path)
        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        trainer, normal = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != trainer.BPE or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix:
            raise ValueError(f"{path}: not a merge-type model with an identity normaliser")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.text = [p.piece for p in model.pieces]
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        apart = "".join(c for c in "\n\t\r" if c not in joined)
        self.cut = re.compile(f"([{apart}])") if apart else re.compile("(?!)")
        symbol = {p: i for p, (_, i) in self.pieces.items()}
        for c in sorted(joined - symbol.keys()):
            symbol[c] = len(self.text) + len(symbol)
        ranks = {score: rank for rank, score in enumerate(sorted({s for s, _ in self.pieces.values()}))}
        splits = []
        for p, (score, i) in self.pieces.items():
            for at in range(1, len(p)):
                if p[:at] in symbol and p[at:] in symbol:
                    splits.append((symbol[p[:at]], symbol[p[at:]], ranks[score], i))
        self.table = MergeTable(splits, max(symbol.values()) + 2)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1 and c in self.pieces:
                self.symbol[ord(c)] = i
        self.spelled = pa.array([str(i).encode() for i in range(len(self.text))], pa.binary())
        self.decoded = pa.array([self._decoded(i) for i in range(len(self.text))], pa.binary())
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.differing = 0

    def _decoded(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return " ⁇ ".encode() if i == self.unknown else self.text[i].replace(SPACE, " ").encode()

    def agenda(self, text: str) -> list[int]:
        """Ids of a text by merging adjacent symbols in the order of their scores."""
        pieces = self.pieces
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []
        for left in range(n - 1):
            pair = symbols[left] + symbols[left + 1]
            if pair in pieces:
                waiting.append((pieces[pair][0], left, left + 1, pair))
        heapq.heapify(waiting)
        while waiting:
            _, left, right, pair = heapq.heappop(waiting)
            if symbols[left] is None or symbols[right] is None or symbols[left] + symbols[right] != pair or after[left] != right:
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                wider = pair + symbols[following]
                if wider in pieces:
                    heapq.heappush(waiting, (pieces[wider][0], left, following, wider))
            if (previous := before[left]) >= 0:
                wider = symbols[previous] + pair
                if wider in pieces:
                    heapq.heappush(waiting, (pieces[wider][0], previous, left, wider))
        ids: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            if symbol in pieces:
                ids.append(pieces[symbol][1])
            else:
                ids += [self.bytes.get(b, self.unknown) for b in symbol.encode()] if self.bytes else [self.unknown]
        return ids

    def agendas(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another and how many each has.

        Short chunks are merged together; long ones and those with characters that are no piece
        have their own heap.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(chunks)), lengths)
        alone = (lengths > LONG) | (np.bincount(owner, symbols < 0, len(chunks)) > 0)
        together = ~alone[owner]
        ids, counts = self.table.merge(symbols[together], lengths[~alone])
        if not alone.any():
            return ids, counts
        own = [self.agenda(chunks[i]) for i in np.flatnonzero(alone)]
        sizes = np.zeros(len(chunks), np.int64)
        sizes[~alone], sizes[alone] = counts, [len(x) for x in own]
        where = np.repeat(alone, sizes)
        out = np.empty(len(where), np.int64)
        out[~where], out[where] = ids, [i for x in own for i in x]
        return out, sizes

    def _learn(self, keys: list[bytes]) -> None:
        """Encode, decode and check the pre-tokens that are new in a batch."""
        texts = [k.decode() for k in keys]
        chunks, cut = [SPACE + t.replace(" ", SPACE) for t in texts], self.cut
        if cut.search("".join(chunks)):
            parts = [[p for p in cut.split(c) if p] for c in chunks]
            ids, counts = self.agendas([p for own in parts for p in own])
            counts = np.add.reduceat(counts, np.cumsum([0] + [len(own) for own in parts[:-1]]))
        else:
            ids, counts = self.agendas(chunks)
        theirs = self.library.encode(texts, num_threads=1)
        right_counts = np.fromiter(map(len, theirs), np.int64, len(theirs))
        right = np.fromiter(chain.from_iterable(theirs), np.int64, int(right_counts.sum()))
        for i in np.flatnonzero(right_counts == 0):  # the library gives nothing for the space before nothing
            theirs[i] = self.agenda(chunks[i])
            right_counts[i] = len(theirs[i])
            right = np.fromiter(chain.from_iterable(theirs), np.int64)
        if not (np.array_equal(ids, right) and np.array_equal(counts, right_counts)):
            stops, ends = np.cumsum(counts), np.cumsum(right_counts)
            mine, own = np.split(ids, stops[:-1]), np.split(right, ends[:-1])
            wrong = [t for t, a, b in zip(texts, mine, own, strict=True) if not np.array_equal(a, b)]
            self.differing += len(wrong)
            raise ValueError(f"{len(wrong)} pre-tokens differ from the library, the first is {wrong[0]!r}")
        decoded = plain_bytes(pc.binary_join(lists_of(self.decoded.take(pa.array(ids)), counts), b""))
        if b"".join(decoded)[1:] != self.library.decode(ids.tolist()).encode():
            raise ValueError("decoding differs from the library")
        spelled = plain_bytes(pc.binary_join(lists_of(self.spelled.take(pa.array(ids)), counts), b","))
        self.known.update(zip(keys, zip(spelled, decoded, strict=True), strict=True))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Decimal ids joined by commas, and the decoded UTF-8, of each text."""
        with no_cycles():
            lists = space_lists(texts)
            keys, codes = distinct_words(lists)
            if len(self.known) > MAX_PRE_TOKENS:
                self.known = {}
            if new := [k for k in keys if k not in self.known]:
                self._learn(new)
            found = list(map(self.known.__getitem__, keys))
            joined = []
            for at, between in ((0, b","), (1, b"")):
                values = pa.array([f[at] for f in found], pa.binary()).take(codes)
                joined.append(pc.binary_join(pa.ListArray.from_arrays(list_offsets(lists), values), between))
        decoded = [d[1:] for d in joined[1].to_pylist()]  # the first space is the library's own
        return joined[0], pa.array(decoded, pa.binary())


def loaded(path: str) -> PieceCodec:
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded (UTF-8) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in sliced(batches):
            ids, decoded = codec.encode(batch.column(1))
            commas = pc.count_substring(ids, b",")
            n_tokens = pc.add(commas, pc.if_else(pc.equal(pc.binary_length(ids), 0), 0, 1)).cast(pa.int64())
            yield pa.record_batch([batch.column(0), n_tokens, ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
