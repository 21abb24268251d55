"""Token ids of whole batches, with each distinct word encoded once by the ``tokenizers`` library.

Both vocabularies split a text before white space ahead of any merge, so a text's ids are those of its words in
order. ``spaced`` keeps the white space before a word with it (byte-level BPE); otherwise white space has no ids.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from strandline.llm import _words

_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ONE: dict[tuple[str, bool], "BatchTokenizer"] = {}
#: Letters (ASCII and Latin-1) and punctuation behind them: pieces that the split rules of both vocabularies part alike.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_SIMPLE = re.compile(rb"(\n?)( ?" + _LETTERS + rb")([!$%&*#.,;:?|]*)")
_PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The byte-level alphabet: a printable byte stands for itself, the others for 256 and up in order.
_ALPHABET = {b: b if b in _PLAIN_BYTES else 256 + sum(x not in _PLAIN_BYTES for x in range(b)) for b in range(256)}


def tokenizer(path: str, spaced: bool) -> "BatchTokenizer":
    """One for each worker process, so that the vocabulary is read once; ``release`` it when a task ends."""
    if (path, spaced) not in _ONE:
        _ONE[path, spaced] = BatchTokenizer(path, spaced)
    return _ONE[path, spaced]


class BatchTokenizer:
    """Memory is bounded: a table of 2**19 words by hash, where a later word takes a place over, and an arena of ids."""

    def __init__(self, path: str, spaced: bool, bits: int = 19, arena: int = 1 << 21):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # strings of added tokens (<|endoftext|>) have ids of their own, wherever they stand in a word
        added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.spaced, self.mask, self.most = spaced, np.uint64((1 << bits) - 1), arena
        self.release()

    def release(self) -> None:
        """Drops what it remembers, so that a worker that waits for other tasks holds no more than the vocabulary."""
        self.keys = self.at = self.n = self.ids = np.zeros(0, np.uint64)
        self.used = 0
        self.parts: dict[bytes, bytes] = {}  # ids of 4 bytes: lists of numbers take several times as much

    def _ready(self) -> None:
        if not len(self.keys):
            size = int(self.mask) + 1
            self.keys, self.at, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            self.ids = np.zeros(1 << 20, np.uint32)

    def _part(self, part: bytes) -> bytes:
        own = self.parts.get(part)
        if own is None:
            text = part if self.spaced else part.decode().lower().encode()
            own = array("I", [x.id for x in self.library.model.tokenize(text.decode("latin-1").translate(_ALPHABET))]).tobytes()
            if len(self.parts) >= 100_000:
                self.parts.clear()
            self.parts[part] = own
        return own

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, 4 bytes each: of its letters and punctuation by the model, or of any other piece by the whole pipeline."""
        out: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            m = _SIMPLE.fullmatch(piece)
            if not m:
                rest.append(i)
                continue
            line, letters, marks = m.groups()
            ids = self._part(letters)
            if line:
                ids = self._part(line) + ids
            out[i] = ids + self._part(marks) if marks else ids
        texts = [pieces[i].decode() for i in rest]
        for i, x in zip(rest, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = array("I", x.ids).tobytes()
        return out

    def _keep(self, lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        total = int(n.sum())
        if self.used + total > self.most:
            self.keys[:] = 0
            self.used = 0
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(lists), np.uint32)
        at = self.used + np.cumsum(n) - n
        self.used += total
        return at, n

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin (with the end after them)."""
        if self._whole(data):
            return self._rows(data, offs)
        if len(data) > _words.PIECE and len(offs) == 2:
            return self._long(data)
        return self._encode(data, offs)

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            start, end, first, h = self._pieces(data, offs)
        else:
            w = _words.words(data, offs)
            start, end, first, h = w.start, w.end, w.first, w.hash
        self._ready()
        slot = (h & self.mask).astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != h)
        at, n = self.at[slot], self.n[slot]
        if len(missed):
            new, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            one = missed[one]
            whole = data.tobytes()
            lists = self._new([whole[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            if self.used and self.used + sum(map(len, lists)) // 4 > self.most:
                self.keys[:] = 0
                self.used = 0
                if len(lists) < len(h):
                    return self._encode(data, offs)
            own_at, own_n = self._keep(lists)
            spot = (new & self.mask).astype(np.int64)
            self.keys[spot], self.at[spot], self.n[spot] = new, own_at, own_n
            at[missed], n[missed] = own_at[back], own_n[back]
        ends = np.concatenate([[0], np.cumsum(n)])
        pick = np.repeat(at - ends[:-1], n) + np.arange(ends[-1])
        return self.ids[pick], ends[first]

    def _whole(self, data: np.ndarray) -> bool:
        """Whether texts must go to the library as they are: odd white space, or a string of an added token."""
        raw = None
        if self.spaced and _LEAD[data].any():
            raw = data.tobytes()
            if _ODD.search(raw):
                return True
        return self.added is not None and (data == 124).any() and bool(self.added.search(raw or data.tobytes()))

    def _rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        lists = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, lists)])
        return np.concatenate([*lists, np.zeros(0, np.uint32)]), ends

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long text in pieces that begin at white space behind a word, where both vocabularies split it too."""
        got, i = [], 0
        while i < len(data):
            j = i + _words.PIECE
            while j < len(data):
                space = _words.SPACES[data[j - 1 : j + _words.PIECE]]
                begins = space[1:] & ~space[:-1]
                if begins.any():
                    j += int(begins.argmax())
                    break
                j += _words.PIECE
            j = min(j, len(data))
            got.append(self._encode(data[i:j], np.array([0, j - i]))[0])
            i = j
        ids = np.concatenate(got)
        return ids, np.array([0, len(ids)])

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of white space each with the word behind it; such a run at a row's end stands alone."""
        n = len(data)
        space = _words.SPACES[data]
        begin = np.zeros(n + 1, bool)
        begin[offs] = True
        if n:
            begin[1:n] |= space[1:] & ~space[:-1]
        begin[n] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n) if len(start) else start
        sums = _words._sums(_words._PLAIN[data], _words._R)
        h = (sums[end] - sums[start]) * _words.powers(pow(_words._R, -1, 1 << 64), n + 1)[start]
        h = _words.mix(h + (end - start).astype(np.uint64) * np.uint64(_words._Q))
        return start, end, np.searchsorted(start, offs), h
