"""Words, their hashes and hashes of word runs, for whole Arrow batches of text at once.

A hash of bytes ``i..j`` is a difference of prefix sums of ``table[byte] * R**position`` (modulo 2**64), shifted back
by the inverse power and then mixed; runs of words use the same over word hashes. So neither words nor runs become
Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes (or values) whose hashes are summed at once.
PIECE = 1 << 18

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


_PLAIN = mix(np.arange(1, 257, dtype=U) * U(_R))
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; n is at most a piece's length, so the table stays small."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        have = np.full(size, base, U)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, U)
    np.cumsum(x * powers(base, len(x)), out=out[1:])
    return out


@dataclass
class Words:
    """Words of some rows: ``first[r]:first[r + 1]`` are those of row r; start and end are bytes of ``data``."""

    data: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """The bytes from word i to the end of word j - 1."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    if not len(array) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(array: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) in runs of rows of about ``limit`` bytes; a longer row stands alone."""
    data, offs = columns(array)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    """Words of all rows. Bytes are looked at in pieces of ``PIECE``, so a long text takes about five bytes for each of its own."""
    got = []
    i = 0
    while i < len(data):
        j = _piece_end(data, i, separators)
        got.append(_words_of(data, offs, i, j, lower, separators))
        i = j
    start, end, h = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))
    return Words(data, offs, start, end, h, np.searchsorted(start, offs))


def _piece_end(data: np.ndarray, i: int, separators: np.ndarray) -> int:
    """A place about ``PIECE`` bytes on where no word is cut (a word longer than a piece makes it longer)."""
    j = i + PIECE
    while j < len(data):
        part = separators[data[j : j + PIECE]]
        if part.any():
            return j + int(part.argmax())
        j += PIECE
    return len(data)


def _words_of(data: np.ndarray, offs: np.ndarray, i: int, j: int, lower: bool, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    own = data[i:j]
    n = j - i
    inside = ~separators[own]
    edge = np.zeros(n + 1, bool)
    edge[offs[np.searchsorted(offs, i) : np.searchsorted(offs, j, "right")] - i] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[0] = after[-1] = True
    np.logical_not(inside[:-1], out=before[1:])
    np.logical_not(inside[1:], out=after[:-1])
    before |= edge[:-1]
    after |= edge[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    sums = _sums((_LOWER if lower else _PLAIN)[own], _R)
    h = (sums[end] - sums[start]) * powers(pow(_R, -1, 1 << 64), n + 1)[start]
    h = mix(h + (end - start).astype(U) * U(_Q))
    return start + i, end + i, h


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; runs over row ends are in it too, see ``inside_rows``."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, U)
    out = np.empty(n, U)
    step = max(PIECE, k)
    for i in range(0, n, step):
        j = min(n, i + step)
        sums = _sums(hashes[i : j + k - 1], _Q)
        out[i:j] = mix((sums[k:] - sums[:-k]) * powers(pow(_Q, -1, 1 << 64), j - i + k - 1)[: j - i] + U(k))
    return out


def inside_rows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places start k words of one row."""
    ok = np.ones(max(0, n), bool)
    for back in range(1, k):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
