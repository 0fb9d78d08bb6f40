"""Token ids of whole texts for a word-splitting tokenizers vocabulary, one look-up per distinct word.

A vocabulary whose normaliser works on single characters and drops white space, and whose
pre-tokenizer never joins across white space, gives a text the ids of its white-space words in
order. Arrow splits a batch into words and finds the distinct ones; the worker keeps the ids of
words it has met (a bounded dictionary). New words are cut by the file's own pattern and their
parts merged by the file's own merges, all together. Words with characters outside plain Latin
ranges, long ones, and those that may hold a special string go through the library, as does every
text if the file has another shape.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from hazardflow.llm.common import lists_of, looked_up, no_cycles, plain_bytes, sliced
from hazardflow.llm.merges import MergeTable

MAX_WORDS = 200_000
LONG = 100
PLAIN = regex.compile("[!-~¡-ɏ]+")  # no white space, no control or combining characters
PLAIN_LINES = regex.compile("[\n!-~¡-ɏ]*")
_LOADED: dict[str, WordIds] = {}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"]
            and r"\s" in cuts[0]["pattern"]["Regex"]
            and not cuts[1]["use_regex"]
            and not cuts[1]["add_prefix_space"]
            and model["type"] == "BPE"
            and not model.get("ignore_merges")
        )
        if not self.by_word:
            return
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"] + "|\n")
        self.openings = [t["content"][:2].encode() for t in spec["added_tokens"]]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"\n": b""}
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        triples = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)]
        self.table = MergeTable(triples, max(vocab.values()) + 1)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)

    def _merge(self, parts: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens by merging the letters of their bytes."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        ids, counts = self.table.merge(symbols, lengths)
        flat, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words into the dictionary."""
        blob = b"\n".join(words)
        if any(o in blob for o in self.openings) or max(map(len, words)) > LONG or not PLAIN_LINES.fullmatch(blob.decode()):
            plain = [len(w) <= LONG and not any(o in w for o in self.openings) and PLAIN.fullmatch(w.decode()) is not None for w in words]
            for word, p in zip(words, plain, strict=True):
                if not p:
                    self.words[word] = self._whole(word.decode())
            words = [w for w, p in zip(words, plain, strict=True) if p]
            if not words:
                return
            blob = b"\n".join(words)
        found = self.pattern.findall(blob.decode().lower() + "\n")
        coded = pa.array(found, pa.string()).dictionary_encode()
        parts = plain_bytes(coded.dictionary)
        if len(self.parts) > MAX_WORDS:
            self.parts = {b"\n": b""}
        if new := [p for p in parts if p not in self.parts]:
            self.parts.update(zip(new, self._merge(new), strict=True))
        values = pa.array(list(map(self.parts.__getitem__, parts)), pa.binary())
        codes = coded.indices.to_numpy()
        ends = np.flatnonzero(codes == parts.index(b"\n"))
        ids = pc.binary_join(lists_of(values.take(coded.indices), np.diff(ends, prepend=-1)), b"")
        self.words.update(zip(words, plain_bytes(ids), strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _look(self, words: list[bytes]) -> pa.Array:
        if len(self.words) > MAX_WORDS:
            self.words = {}
        if new := [w for w in words if w not in self.words]:
            self._learn(new)
        return pa.array(list(map(self.words.__getitem__, words)), pa.binary())

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit numbers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            return pa.array([self._whole(t) for t in texts.to_pylist()], pa.binary())
        with no_cycles():
            return pc.binary_join(looked_up(pc.ascii_split_whitespace(texts), self._look), b"")


def loaded(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def with_ids(docs: DataFrame, path: str, end_id: int | None = None, width: int = 4) -> DataFrame:
    """doc_id, all_ids: the ids of each text (null: empty), then end_id, as little-endian unsigned numbers of `width` bytes.

    width 2 needs ids below 65536.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def narrow(ids: bytes) -> bytes:
        wide = np.frombuffer(ids, "<u4")
        if len(wide) and wide.max() >> 16:
            raise ValueError("an id does not fit two bytes")
        return wide.astype("<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path)
        for batch in sliced(batches):
            ids = pc.binary_join_element_wise(words.encode(batch.column(1)), pa.scalar(end, pa.binary()), b"")
            if width == 2:
                ids = pa.array([narrow(x) for x in ids.to_pylist()], pa.binary())
            yield pa.record_batch([batch.column(0), ids], ["doc_id", "all_ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, all_ids binary")
