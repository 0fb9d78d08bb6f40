"""Token counts, ids, packing and the piece codec against the libraries."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from hazardflow.llm import piece_codec, token_counts, token_rows, vector_packing, word_ids
from hazardflow.llm.common import tokenizer_path
from tests.llm.conftest import odd_rows

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(WORDS))


@pytest.fixture(scope="module")
def pieces():
    return token_counts.library(tokenizer_path(PIECES))


def key(x):
    return tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_counts(request, pieces, table):
    rows = token_counts.token_counts(request.getfixturevalue(table), tokenizer_path(PIECES), limit=100, head=7).collect()
    want = [(d, len((t or "").encode()), len(pieces.encode(t or ""))) for d, t, *_ in odd_rows()]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in rows], key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_codec(request, pieces, table):
    rows = piece_codec.encoded(request.getfixturevalue(table), tokenizer_path(PIECES)).collect()
    want = []
    for d, t, *_ in odd_rows():
        ids = pieces.encode(t or "")
        want.append((d, len(ids), ",".join(map(str, ids)).encode(), pieces.decode(ids).encode()))
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows], key=lambda r: (key(r[:2]), r[2])) == sorted(want, key=lambda r: (key(r[:2]), r[2]))


def test_agenda_alone_is_exact(pieces):
    codec = piece_codec.PieceCodec(tokenizer_path(PIECES))
    for text in ["hello", "internationalisation", "aaaaaaaaaaaa", "日本語x", "\x00\x01", "1234567890"]:
        assert codec.agenda("▁" + text) == pieces.encode(text)
        ids, counts = codec.agendas(["▁" + text, "▁" + text])
        assert ids.tolist() == pieces.encode(text) * 2 and counts.tolist() == [len(pieces.encode(text))] * 2
    assert codec.differing == 0


def test_a_wrong_agenda_is_an_error(pieces, monkeypatch):
    codec = piece_codec.PieceCodec(tokenizer_path(PIECES))
    right = codec.agendas
    monkeypatch.setattr(codec, "agendas", lambda chunks: (right(chunks)[0][::-1], right(chunks)[1]))
    with pytest.raises(ValueError, match="differ from the library"):
        codec.encode(pa.array(["internationalisation of words"]))
    assert codec.differing > 0


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_pieces_are_packed_whole(request, words, table):
    docs = request.getfixturevalue(table)
    rows = vector_packing.packed_documents(docs, tokenizer_path(WORDS), capacity=256).collect()
    want = []
    for d, t, *_ in odd_rows():
        ids = words.encode(t or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), 256)):
            own = np.array(ids[start : start + 256], "<u4").tobytes()
            want.append((d, n, start, len(own) // 4, zlib.crc32(own)))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256
    assert len(filled) <= 1.1 * sum(filled.values()) / 256 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    dice = np.random.default_rng(2)
    lengths = dice.integers(1, 400, 900)
    capacities = (1000, 6, 200_000)
    sequence, offset = vector_packing.best_fit(lengths, capacities, rule)
    for s in np.unique(sequence):
        own = sequence == s
        assert lengths[own].sum() <= 1000 and own.sum() <= 6 and (lengths[own] ** 2).sum() <= 200_000
        order = np.argsort(offset[own])
        assert (np.cumsum(lengths[own][order]) - lengths[own][order] == offset[own][order]).all()
    need = max(lengths.sum() / 1000, len(lengths) / 6, (lengths**2).sum() / 200_000)
    assert len(np.unique(sequence)) <= 1.15 * need + 1
    with pytest.raises(ValueError):
        vector_packing.best_fit(np.array([2000]), capacities)


def test_best_fit_decreasing_against_search():
    dice = np.random.default_rng(5)
    lengths = dice.integers(1, 64, 500).tolist()
    rows = token_rows.best_fit_decreasing(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(500))
    room = []
    for n in sorted(lengths, reverse=True):  # the same rule with a plain search
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(64 - n)
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(room)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_rows_give_the_documents_back(request, words, table, tmp_path):
    docs = request.getfixturevalue(table)
    rows = token_rows.write_token_rows(docs, str(tmp_path / "rows"), tokenizer_path(WORDS), capacity=128).collect()
    parts = []
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 128 and r.n_tokens == r.cumulative[-1] and (ids[r.n_tokens :] == 0).all()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cumulative[:-1], r.cumulative[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.append((doc, piece, ids[a:b].tolist()))
    want = []
    for d, t, *_ in odd_rows():
        ids = words.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, n, ids[s : s + 128]) for n, s in enumerate(range(0, len(ids), 128))]
    order = lambda r: (key(r[:2]), r[2])
    assert sorted(parts, key=order) == sorted(want, key=order)


def test_empty_tables(none):
    assert token_counts.token_counts(none, tokenizer_path(PIECES)).count() == 0
    assert piece_codec.encoded(none, tokenizer_path(PIECES)).count() == 0
    assert vector_packing.packed_documents(none, tokenizer_path(WORDS)).count() == 0
    assert token_rows.token_rows(none, tokenizer_path(WORDS)).count() == 0


def test_other_tokenizer_files_go_through_the_library(odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {bytes(r.all_ids) for r in word_ids.with_ids(odd, path).collect()}
    assert got == {np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for _, t, *_ in odd_rows()}


