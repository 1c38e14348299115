"""Ids of whole texts from a tokenizer file: pieces are split, found and put together as arrays."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from terrahaz.llm.words import hashes

REMEMBERED = 1_500_000
"""Pieces a worker remembers before it starts anew; results do not depend on it."""
_BITS = 22
_OTHER, _LETTER, _NUMBER, _SPACE, _NEW = range(5)

# fixed value: what the split of byte-level tokenizer files takes off at an apostrophe
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point; those that tables of different age know apart are new."""
    import unicodedata

    import regex

    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N"), (_SPACE, "White_Space")):
        for found in regex.finditer(rf"\p{{{name}}}+", points):
            a, b = ord(points[found.start()]), ord(points[found.end() - 1])
            table[a:b + 1] = kind
    fresh = [c for c in np.flatnonzero(table).tolist() if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    table[fresh] = _NEW
    return table


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level tokenizer files start, for texts that begin at ``first`` in ``points``.

    A piece is a run of letters, of numbers or of other signs with one blank before it;
    the last sign of white space before such a run stands apart from those before; an
    apostrophe that starts a piece takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    kind = _classes()[points]
    start = np.empty(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(n + 1, bool)
    opens[first[first < n]] = True
    start[opens[:n]] = True
    runs = np.flatnonzero(start[1:] & ~opens[1:n] & (kind[:-1] == _SPACE)) + 1  # runs behind white space
    start[runs - 1] = True
    start[runs[points[runs - 1] == 0x20]] = False
    marks = np.flatnonzero((points[:n - 1] == 0x27) & start[:n - 1] & (kind[1:] == _LETTER) & ~opens[1:n])
    if len(marks):
        padded = np.append(points, [0, 0])
        one, two = padded[marks + 1], np.where(opens[np.minimum(marks + 2, n)], 0, padded[marks + 2])
        size = np.where(np.isin(one, [ord(x) for x in _SHORT]), 2, 0)
        for a, b in _LONG:
            size[(one == ord(a)) & (two == ord(b))] = 3
        marks, size = marks[size > 0], size[size > 0]
        start[marks + 1] = False
        ends = marks + size
        start[ends[size == 3] - 1] = False
        start[ends[ends < n]] = True
    return start


class _Memory:
    """Pieces by 64-bit hash in an open table, their ids in one pool."""

    def __init__(self, dtype: np.dtype):
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.spans = np.zeros(1 << _BITS, np.int64)  # place in the pool << 24 | number of ids
        self.pool, self.used, self.size = np.zeros(1 << 16, dtype), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        slot = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)
            held = self.keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = slot[left[same]]
            left = left[~same & (held != 0)]
        return out

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """New distinct keys with their ids."""
        counts = np.array([len(x) for x in ids], np.int64)
        whole = np.concatenate(ids)
        while self.used + len(whole) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(whole)] = whole
        spans = self.used + np.cumsum(counts) - counts << 24 | counts
        self.used += len(whole)
        self.size += len(keys)
        slot, left = (keys >> np.uint64(64 - _BITS)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, won = np.unique(slot[free], return_index=True)
            put = free[won]
            self.keys[slot[put]], self.spans[slot[put]] = keys[put], spans[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)


class Encoder:
    """Ids of whole texts, as the library gives them without special tokens.

    The library's byte-level files split a text before they merge; with such a
    file each distinct piece goes through the library once and is remembered by a
    64-bit hash. Texts that hold an added token, which the library takes out before
    the split, or letters newer than Python's tables go whole; so do all texts of any other file.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [token["content"].encode() for token in said.get("added_tokens") or []]
        split = said.get("pre_tokenizer") or {}
        self.by_piece = (said.get("normalizer") is None and split.get("type") == "ByteLevel"
                         and not split.get("add_prefix_space") and split.get("use_regex", True))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # fixed value: the sign that stands for the blank byte in byte-level vocabularies
        self.blank = np.zeros(size, bool)
        self.blank[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        self.memory = _Memory(self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces; those of a blank and letters go through the library in rows of many.

        Behind one another they split into themselves again, and a token that starts with a blank starts a
        piece; a row with another number of such tokens than pieces is taken piece by piece.
        """
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        rows = [plain[k:k + 256] for k in range(0, len(plain), 256)]
        for row, ids in zip(rows, self._library(["".join([pieces[i] for i in r]) for r in rows])):
            first = np.flatnonzero(self.blank[ids])
            if len(first) == len(row) and first[0] == 0:
                for i, part in zip(row, np.split(ids, first[1:])):
                    out[i] = part
        rest = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), 4096):
            for i, ids in zip(rest[k:k + 4096], self._library([pieces[i] for i in rest[k:k + 4096]])):
                out[i] = ids
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` and the number of ids of each text."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        raw = data.tobytes()
        points = _points(raw)
        lead = None if len(points) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
        first = offsets[:-1] if lead is None else np.searchsorted(lead, offsets[:-1])
        starts = np.flatnonzero(piece_starts(points, first))
        starts = starts if lead is None else lead[starts]
        ends = np.append(starts[1:], len(data))
        keys = hashes(data, starts, ends)
        keys[keys == 0] = 1
        if self.memory.size > REMEMBERED:
            self.memory = _Memory(self.dtype)
        memory = self.memory
        slots = memory.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            fresh, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            for k in range(0, len(fresh), 1 << 17):
                some = at[k:k + (1 << 17)]
                memory.add(fresh[k:k + (1 << 17)],
                           self._new([raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())]))
            slots[missing] = memory.find(keys[missing])
        spans = memory.spans[slots]
        counts = spans & (1 << 24) - 1
        until = np.cumsum(counts)
        ids = memory.pool[np.repeat((spans >> 24) - until + counts, counts) + np.arange(until[-1])]
        total = np.append(0, until)
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another and the number of ids of each; texts are UTF-8 from offset to offset."""
        raw = data.tobytes()
        whole = np.zeros(len(offsets) - 1, bool)
        if not self.by_piece:
            whole[:] = True
        elif any(token in raw for token in self.added) or (_classes()[_points(raw)] == _NEW).any():
            texts = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            whole[:] = [any(token in text for token in self.added) or (_classes()[_points(text)] == _NEW).any() for text in texts]
        if not whole.any():
            return self._pieces(data, offsets)
        out = []
        for i in range(len(whole)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            out.append(self._library([raw[a:b].decode()])[0] if whole[i] else self._pieces(data[a:b], np.array([0, b - a]))[0])
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def __call__(self, texts: list[str]) -> list[bytes]:
        rows = [text.encode() for text in texts]
        ids, counts = self.flat(np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64))
        packed, cut = ids.tobytes(), (np.append(0, np.cumsum(counts)) * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip(cut, cut[1:])]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)
