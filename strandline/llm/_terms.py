"""Terms: runs of bytes of a class, for whole Arrow batches of text at once, as Arrow columns and not as Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandline.llm import _words

_BYTES = np.arange(256)
#: ASCII letters and everything outside ASCII; the same and digits.
LETTERS = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES > 127)
ALNUM = LETTERS | (_BYTES >= 48) & (_BYTES <= 57)
_LOWER = _BYTES.astype(np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Longest runs of ``inside`` bytes in each row, only A-Z lower-cased, and where each row's begin.

    Runs end at ASCII bytes or row ends, so they are whole characters. A text takes about twelve times its bytes.
    """
    is_in = inside[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    np.logical_not(is_in[:-1], out=before[1:])
    np.logical_not(is_in[1:], out=after[:-1])
    start = np.flatnonzero(is_in & (before | edge[:-1]))
    ends = np.flatnonzero(is_in & (after | edge[1:])) + 1
    body = _LOWER[data[is_in]]
    wide = len(body) >= 1 << 31
    at = np.zeros(len(start) + 1, np.int64 if wide else np.int32)
    np.cumsum(ends - start, out=at[1:])
    kind = pa.LargeStringArray if wide else pa.StringArray
    return kind.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(body)), np.searchsorted(start, offs)


def counted(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, row, term and occurrences of each different term of a row, terms of each row with repeats)."""
    found, first = terms(data, offs, inside)
    coded = found.dictionary_encode()
    words = coded.dictionary
    key = _words.row_of(first) * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False)
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    row, term = np.divmod(key[at], max(1, len(words)))
    return words, row, term, np.diff(np.append(at, len(key))), np.diff(first)


def blocks(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return _words.blocks(array, limit)
