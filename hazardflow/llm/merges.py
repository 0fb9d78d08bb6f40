"""Merging of adjacent symbols by rank, for many short words at once.

Every word has its own agenda of adjacent pairs. A round takes from each agenda the pair of the
best rank (leftmost on ties) and merges it, for all words together; only the pairs next to a merge
are looked up anew. Words leave when no pair of theirs can be merged.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class MergeTable:
    """pairs: (left symbol, right symbol, rank, merged symbol), lower rank first."""

    def __init__(self, pairs: list[tuple[int, int, int, int]], symbols: int):
        table = np.array(pairs, np.int64).reshape(-1, 4)
        key = table[:, 0] * symbols + table[:, 1]
        order = np.argsort(key)
        self.symbols = symbols
        self.key = np.concatenate([key[order], [NONE]])
        self.rank = np.concatenate([table[order, 2], [0]])
        self.merged = np.concatenate([table[order, 3], [0]])

    def rows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the table for each pair, -1 where the pair does not merge."""
        wanted = left.astype(np.int64) * self.symbols + right
        at = np.searchsorted(self.key, wanted)
        return np.where(self.key[at] == wanted, at, -1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after merging (words one after another) and how many each has."""
        total = len(lengths)
        owners, pieces = [], []
        word = np.repeat(np.arange(total), lengths)
        sym = symbols.astype(np.int64)
        row = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            same = word[:-1] == word[1:]
            row[:-1] = np.where(same, self.rows(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(row >= 0, self.rank[row] << 32, NONE)
            can = row >= 0
            rank[can] |= np.flatnonzero(can)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                sizes = np.diff(np.append(starts, len(sym)))
                out = np.repeat(done, sizes)
                owners.append(word[out])
                pieces.append(sym[out])
                at = best[~done] & 0xFFFFFFFF
                at = at - (np.cumsum(out) - out)[at]
                sym, word, row = sym[~out], word[~out], row[~out]
            else:
                at = best & 0xFFFFFFFF
            if not len(sym):
                break
            sym[at] = self.merged[row[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # each word loses one symbol, after its merge
            sym, word, row = sym[stay], word[stay], row[stay]
            for left in (at, at[at > 0] - 1):
                inside = left + 1 < len(sym)
                joins = np.zeros(len(left), bool)
                joins[inside] = word[left[inside]] == word[left[inside] + 1]
                row[left] = -1
                row[left[joins]] = self.rows(sym[left[joins]], sym[left[joins] + 1])
        if not owners:
            return np.zeros(0, np.int64), np.zeros(total, np.int64)
        owner, piece = np.concatenate(owners), np.concatenate(pieces)
        order = np.argsort(owner, kind="stable")
        return piece[order], np.bincount(owner, minlength=total)
