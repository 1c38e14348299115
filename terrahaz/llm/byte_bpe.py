"""Byte-level BPE by ranks: a hierarchical-bitmap rank queue, encoding and decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrahaz.llm.frames import text_slices

CACHED_PIECES = 150_000
"""Pieces a worker remembers in each of two generations; results do not depend on it."""

# Characters on which ``re`` and the Unicode classes of the pattern agree; other texts take the slower library.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ‘-”–—…€]")
_LETTERS = (("\\p{L}", "[^\\W\\d_]"), ("\\p{N}", "\\d"))


class Pieces:
    """The matches of a split pattern over ``\\p{L}``, ``\\p{N}`` and ``\\s``."""

    def __init__(self, pattern: str):
        import regex

        self.any = regex.compile(pattern).findall
        # fixed value: the two Unicode classes outside and inside a negated set, in the terms of ``re``
        plain = pattern.replace("[^\\s\\p{L}\\p{N}]+", "(?:[^\\s\\w]|_)+")
        for name, same in _LETTERS:
            plain = plain.replace(name, same)
        self.plain = None if "\\p" in plain else re.compile(plain).findall

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.plain is None or _PLAIN.search(text) else self.plain(text)


class RankQueue:
    """Positions in buckets by merge rank; three levels of bitmaps tell the lowest rank in use.

    A rank is split into 6 + 6 + the remaining bits. ``pop`` walks from the
    top bitmap to the leaf by find-first-set, so it costs the same for any
    number of ranks, and hands out the whole bucket of the lowest one.
    """

    __slots__ = ("top", "middle", "leaf", "buckets")

    def __init__(self):
        self.top, self.middle, self.leaf, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        group, region = rank >> 6, rank >> 12
        self.leaf[group] = self.leaf.get(group, 0) | 1 << (rank & 63)
        self.middle[region] = self.middle.get(region, 0) | 1 << (group & 63)
        self.top |= 1 << region

    def pop(self) -> tuple[int, list[np.ndarray]]:
        """The lowest rank and its positions as they were pushed; only while ``top`` is not 0."""
        region = (self.top & -self.top).bit_length() - 1
        bits = self.middle[region]
        group = region << 6 | (bits & -bits).bit_length() - 1
        bits = self.leaf[group]
        rank = group << 6 | (bits & -bits).bit_length() - 1
        self.leaf[group] = bits & (bits - 1)
        if not self.leaf[group]:
            self.middle[region] &= self.middle[region] - 1
            if not self.middle[region]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class ByteBpe:
    """Encoder and decoder of one rank file.

    Pieces are merged many at a time: they lie behind one another in one
    linked list without links across piece borders, so one bucket of the queue
    holds the pairs of a rank in all of them, and joining it is one array step.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, Pieces(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[token[:k]] << 32 | ranks[token[k:]]: rank
                 for token, rank in ranks.items() for k in range(1, len(token))
                 if token[:k] in ranks and token[k:] in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens joined, or -1."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    @staticmethod
    def _pushed(queue: RankQueue, ranks: np.ndarray, positions: np.ndarray) -> None:
        some = ranks >= 0
        ranks, positions = ranks[some], positions[some]
        if len(ranks) == 1:
            queue.push(int(ranks[0]), positions)
        elif len(ranks):
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            edges = [0, *cuts.tolist(), len(ranks)]
            for rank, a, b in zip(ranks[[0, *cuts]].tolist(), edges, edges[1:]):
                queue.push(rank, positions[a:b])

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece: join the pair of lowest rank, leftmost first, until no pair has a rank."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        token = np.append(self.byte[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours; n stands for none
        after[starts[1:] - 1] = n
        before[starts[:-1]] = n
        after[n], before[n] = n, n
        pair = np.full(n + 1, -1, np.int64)  # rank of the pair that starts at a symbol
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self._rank(token[inner], token[inner + 1])
        queue = RankQueue()
        self._pushed(queue, pair[inner], inner)
        while queue.top:
            rank, parts = queue.pop()
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                touching = after[at[:-1]] == at[1:]
                if touching.any():  # of overlapping pairs every second one, from the left
                    fresh = np.append(True, ~touching)
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            right = after[at]
            beyond, left = after[right], before[at]
            token[at], token[right] = rank, -1
            pair[at], pair[right] = -1, -1
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            first = np.concatenate([at[beyond < n], left[left < n]])
            if not len(first):
                continue
            first = np.unique(first)
            ranks = self._rank(token[first], token[after[first]])
            pair[first] = ranks
            self._pushed(queue, ranks, first)
        kept = np.flatnonzero(token[:n] >= 0)
        packed = token[kept].astype("<u4").tobytes()
        cuts = (np.searchsorted(kept, starts) * 4).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(text) for text in texts]
        wanted = set().union(*split)
        if len(self.cache) + len(wanted) > CACHED_PIECES:
            self.cache, self.old = {}, self.cache
        fresh = [piece for piece in wanted if piece not in self.cache]
        again = [piece for piece in fresh if piece in self.old]
        if again:
            self.cache.update(zip(again, map(self.old.__getitem__, again)))
            fresh = [piece for piece in fresh if piece not in self.old]
        whole = [piece.encode() for piece in fresh]
        known = [self.ranks.get(piece) for piece in whole]
        self.cache.update((p, np.uint32(r).tobytes()) for p, r in zip(fresh, known) if r is not None)
        rest = [(p, w) for p, w, r in zip(fresh, whole, known) if r is None]
        if rest:
            self.cache.update(zip((p for p, _ in rest), self.merge([w for _, w in rest])))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, field in enumerate(batch.schema) if field.name != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [column],
                                      names=[batch.schema[i].name for i in kept] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind, False)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``ids`` (array of int).

    A null or empty text has no ids. All other columns and repeated rows stay;
    a column that is already named ``ids`` is replaced. No shuffle: texts
    are encoded where they are read, and a lost task is simply run again.
    ``path`` is a rank file that every worker can read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch, texts in text_slices(batches, text):
            packed = bpe.encode(texts.to_pylist())
            values = np.frombuffer(b"".join(packed), "<i4")
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType(), False)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for as ``out`` (binary); null ids give no bytes.

    Bytes, because ids may be cut in the middle of a character. A column that
    is already named ``out`` is replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = part.column(part.schema.get_field_index(ids))
                whole = [b"" if not row.is_valid else bpe.decode(row.values.to_numpy()) for row in rows]
                yield _with(part, out, pa.array(whole, pa.binary()))

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian u32) and decoded_sha256."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            sums = [hashlib.sha256(row.values.to_numpy().astype("<u4").tobytes()).hexdigest() for row in rows]
            back = [hashlib.sha256(row.as_buffer()).hexdigest() for row in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.list_value_length(rows).cast(pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", ids, decoded).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
