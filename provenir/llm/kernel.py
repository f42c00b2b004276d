"""The statistics of :mod:`provenir.llm.stats` as an Arrow kernel, for operators that may use Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from provenir.llm.common import BYTE_VALUES, SPACE, U64, Rolling, mix, text_buffer, words_of
from provenir.llm.stats import COUNTS, SYMBOLS, WINDOW


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out


_SYMBOL, _MARK, _DIGIT, _UPPER = _table(SYMBOLS), _table(".,;:!?"), _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Second bytes, after 0xC3, of the capital letters with accents that count.
_ACCENTED = np.zeros(256, bool)
_ACCENTED[[x.encode()[1] for x in "ÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"]] = True


def _equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and which places in that order begin a new key."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    return order, new


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """:data:`COUNTS` of every row of a string column; null counts as empty."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    words, starts, _, first = words_of(raw, offsets)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = (raw & 0xC0) != 0x80
    upper = _UPPER[raw]
    if len(raw) > 1:
        upper[1:] |= (raw[:-1] == 0xC3) & _ACCENTED[raw[1:]]
    out = {"n_words": np.diff(first), "word_chars": per_row(chars & ~SPACE[raw]), "n_symbols": per_row(_SYMBOL[raw]), "n_chars": per_row(chars), "n_upper": per_row(upper), "n_marks": per_row(_MARK[raw]), "n_digits": per_row(_DIGIT[raw])}
    name = mix(np.arange(n, dtype=U64) + U64(0x51ED270B))
    row = np.repeat(np.arange(n), np.diff(first))
    order, new = _equal(words ^ name[row])
    out["n_distinct"] = np.bincount(row[order[new]], minlength=n)
    # Words in windows that occur twice or more
    full = np.maximum(np.diff(first) - WINDOW + 1, 0)
    owner = np.repeat(np.arange(n), full)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    step = mix(np.arange(1, WINDOW + 1, dtype=U64)) | U64(1)
    value = np.zeros(len(at), U64)
    for j in range(WINDOW):
        value += words[at + j] * step[j]
    order, new = _equal(mix(value) ^ name[owner])
    alone = new & np.append(new[1:], True)
    twice = at[order[~alone]]
    change = np.bincount(twice, minlength=len(words) + WINDOW) - np.concatenate([np.zeros(WINDOW, np.int64), np.bincount(twice, minlength=len(words))])
    out["n_repeat_words"] = np.bincount(row[np.cumsum(change)[: len(words)] > 0], minlength=n)
    # Lines with a word, and those equal to an earlier one
    ends = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([offsets[:-1], ends + 1]))
    end = np.sort(np.concatenate([ends, offsets[1:]]))
    held = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=len(raw)) if len(starts) else np.zeros(len(raw), np.int64))])
    full_line = held[end] > held[begin]
    begin, end = begin[full_line], end[full_line]
    own = np.searchsorted(offsets, begin, side="right") - 1
    out["n_lines"] = np.bincount(own, minlength=n)
    order, new = _equal(Rolling(BYTE_VALUES[raw]).of(begin, end) ^ name[own])
    out["n_dup_lines"] = np.bincount(own[order[~new]], minlength=n)
    return {c: out[c].astype(np.int64) for c in COUNTS}
