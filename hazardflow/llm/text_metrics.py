"""Words and counts of whole texts, batch-wise on Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SYMBOLS = "[#*$%&|<>]"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, text after text, and the text each belongs to."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the key occurs twice or more in its text."""
    _, number = np.unique(keys, return_inverse=True)
    _, at, counts = np.unique(owner.astype(np.int64) * (len(keys) + 1) + number, return_inverse=True, return_counts=True)
    return counts[at] > 1


def base_metrics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    words, owner = words_of(texts)
    out = {"n_words": np.bincount(owner, minlength=n)}
    out["word_chars"] = np.bincount(owner, pc.utf8_length(words).to_numpy(), n).astype(np.int64)
    out["n_symbols"] = pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64)
    out["n_upper"] = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy().astype(np.int64)

    lists = pc.split_pattern(texts, "\n")
    lines, line_owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, line_owner = lines.filter(full), line_owner[full.to_numpy(zero_copy_only=False)]
    code = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    distinct = np.unique(line_owner * (len(code) + 1) + code)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct // (len(code) + 1), minlength=n)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(words) > 2:
        coded = words.dictionary_encode()
        code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        _, pair = np.unique(code[:-1] * size + code[1:], return_inverse=True)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        again = inside[repeated(owner[inside], pair[inside] * size + code[inside + 2])]
        mark = np.zeros(len(words), bool)
        for step in range(3):
            mark[again + step] = True
        out["n_repeat_words"] = np.bincount(owner[mark], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}
