"""Token ids on disk: raw id payloads in shards, each with a minimal perfect hash index of its documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahaz.llm.encoder import load
from terrahaz.llm.frames import flat, text_slices
from terrahaz.llm.words import mix

PAYLOAD_BYTES = 2_000_000
"""Payload of one shard; a longer document is a shard of its own."""
SHARD_TEXT_BYTES = 32_000_000
"""Text behind one range of documents, which one task writes."""
_TRIES = 64
_LEAST = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by buckets and displacements.

    ``seeds[b]`` >= 0 is the displacement that sends the keys of bucket b to
    free slots; a bucket of one key stores its slot as -slot - 1. ``fingerprints``
    tell keys that are not in the set (with an error of 2**-32).
    """

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        count = max(1, n // 4)
        bucket = (keys % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=count)
        first = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, bool)
        seeds = np.zeros(count, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own = keys[order[first[b]:first[b + 1]]]
            at = 0
            while True:
                tried = np.arange(at, at + _TRIES, dtype=np.uint64)
                slots = (mix(own[None] + tried[:, None] * _STEP) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(1)
                for k in np.flatnonzero(good).tolist():
                    if len(np.unique(slots[k])) == len(own):
                        break
                else:
                    at += _TRIES
                    continue
                seeds[b] = at + k
                taken[slots[k]] = True
                break
        single = np.flatnonzero(sizes == 1)
        seeds[single] = -np.flatnonzero(~taken)[:len(single)] - 1
        return cls(seeds, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        seed = self.seeds[(keys % np.uint64(len(self.seeds))).astype(np.int64)]
        moved = (mix(keys + seed.astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)
        return np.where(seed < 0, -seed - 1, moved)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _STEP) >> np.uint64(32)).astype(np.uint32)


def hash_keys(ids: np.ndarray, copies: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """64-bit key of a document id (or of its absence) and the number of its equal before it."""
    number = copies.astype(np.uint64) + (missing.astype(np.uint64) << np.uint64(40))
    return mix(mix(ids.astype(np.uint64)) + number * np.uint64(0xD1342543DE82EF95))


_SHARD = ("shard int, part int, before long, n_docs int, n_ids long, width int, "
          "keys binary, missing binary, seeds binary, slots binary, payload binary")


def _pack(shard: int, part: int, before: int, ids: list, rows: list[bytes], width: int, copies: list[int]) -> pa.RecordBatch:
    """One shard: in slot order a fingerprint, the first id's place and the number of ids."""
    missing = np.array([x is None for x in ids])
    keys = np.array([_LEAST if x is None else x for x in ids], np.int64)
    hashed = hash_keys(keys, np.array(copies), missing)
    index = PerfectHash.build(hashed)
    slot = index.slots(hashed)
    sizes = np.array([len(r) // width for r in rows], np.int64)
    slots = np.zeros(len(rows), [("fingerprint", "<u4"), ("place", "<i8"), ("size", "<i8"), ("row", "<i4")])
    slots["fingerprint"][slot] = _fingerprint(hashed)
    slots["place"][slot] = np.cumsum(sizes) - sizes
    slots["size"][slot] = sizes
    slots["row"][slot] = np.arange(len(rows))
    values = [[shard], [part], [before], [len(rows)], [int(sizes.sum())], [width], [keys.astype("<i8").tobytes()],
              [np.packbits(missing).tobytes()], [index.seeds.astype("<i8").tobytes()], [slots.tobytes()], [b"".join(rows)]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                      names=[c.strip().split()[0] for c in _SHARD.split(",")])


class Shard:
    """A written shard, opened: constant-time access to the ids of a document."""

    def __init__(self, row: dict):
        self.n_docs, self.width, self.payload = row["n_docs"], row["width"], row["payload"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=self.n_docs).astype(bool)
        self.index = PerfectHash(np.frombuffer(row["seeds"], "<i8"), self.n_docs)
        self.slots = np.frombuffer(row["slots"], [("fingerprint", "<u4"), ("place", "<i8"), ("size", "<i8"), ("row", "<i4")])

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Slot of each hashed key, -1 for keys that are not here."""
        slot = self.index.slots(hashed)
        return np.where(self.slots["fingerprint"][slot] == _fingerprint(hashed), slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        entry = self.slots[slot]
        return np.frombuffer(self.payload, f"<u{self.width}", int(entry["size"]), int(entry["place"]) * self.width)


def write(df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write shards in ascending ``doc_id`` order below ``folder``.

    Documents are dealt to ranges of doc_id by quantiles; texts are encoded
    before the one shuffle, which carries packed ids (two bytes each
    for vocabularies up to 65,536). A task writes its range in order as shards
    of bounded payload, so it never holds more than one shard. Null texts are
    empty, null doc_ids come first, equal doc_ids follow one another in the order of
    their ids. Other columns are left out. Files are committed by Spark's
    writer, so a lost task leaves nothing behind.
    """
    total = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    n = max(1, -(-int(total) // SHARD_TEXT_BYTES))
    cuts = []
    if n > 1:
        cuts = df.select(F.percentile_approx(doc_id, [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    edges = np.array(sorted(set(cuts)), np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch, texts in text_slices(batches, "text"):
            ids = batch.column(0)
            shard = np.searchsorted(edges, ids.fill_null(_LEAST).to_numpy(), "right").astype(np.int32)
            found, counts = encode.flat(*flat(texts))
            packed, cut = found.tobytes(), (np.append(0, np.cumsum(counts)) * encode.dtype.itemsize).tolist()
            rows = [packed[a:b] + end for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(rows, pa.binary())], names=["shard", "doc_id", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = load(path).dtype.itemsize
        shard, part, before, size = None, 0, 0, 0
        ids, rows, copies = [], [], []
        for batch in batches:
            for s, i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if rows and (s != shard or size + len(r) > PAYLOAD_BYTES and ids[-1] != i or size > 64 * PAYLOAD_BYTES):
                    yield _pack(shard, part, before, ids, rows, width, copies)
                    part, before = (part + 1, before + size // width) if s == shard else (0, 0)
                    ids, rows, copies, size = [], [], [], 0
                shard = s
                copies.append(copies[-1] + 1 if ids and ids[-1] == i else 0)
                ids.append(i)
                rows.append(r)
                size += len(r)
        if rows:
            yield _pack(shard, part, before, ids, rows, width, copies)

    wanted = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    (wanted.mapInArrow(encoded, "shard int, doc_id long, ids binary")
     .repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(packed, _SHARD)
     .write.mode("overwrite").option("compression", "none").option("parquet.block.size", 8 << 20).parquet(folder))


def _starts(shards: DataFrame) -> np.ndarray:
    """For each range the number of ids in all ranges before: eight bytes per 32 MB of text."""
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    sizes = np.zeros(max([r["shard"] for r in totals], default=-1) + 1, np.int64)
    for r in totals:
        sizes[r["shard"]] = r["n"]
    return np.cumsum(sizes) - sizes


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each found through the index of its shard."""
    shards = spark.read.parquet(folder)
    starts = _starts(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                shard = Shard(row)
                same = np.append(False, (shard.keys[1:] == shard.keys[:-1]) & (shard.missing[1:] == shard.missing[:-1]))
                place = np.arange(shard.n_docs)
                copies = place - np.maximum.accumulate(np.where(same, 0, place))
                found = shard.find(hash_keys(shard.keys, copies, shard.missing))
                sums = [zlib.crc32(shard.ids(s).astype("<u4").tobytes()) for s in found.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys, mask=shard.missing), pa.array(starts[row["shard"]] + row["before"] + shard.slots["place"][found]),
                     pa.array(shard.slots["size"][found]), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select(
        "shard", "before", "n_docs", "width", "keys", "missing", "seeds", "slots", "payload").mapInArrow(
            run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int) of the wanted documents that are there, first of equal ids.

    Only the shards whose range holds a wanted key are opened, each with its
    own keys; a key that is not in the shard fails the fingerprint.
    """
    shards = spark.read.parquet(folder)
    ranges = shards.select("shard", "part", F.col("keys").substr(1, 8).alias("low"), F.expr("substring(keys, -8)").alias("high"))
    bounds = [(int.from_bytes(bytes(r["low"]), "little", signed=True), r["shard"], r["part"])
              for r in ranges.collect()]
    bounds.sort()
    lows = np.array([b[0] for b in bounds], np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(lows, batch.column(0).to_numpy(), "right") - 1
            some = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array([bounds[i][1] for i in at[some]], pa.int32()),
                 pa.array([bounds[i][2] for i in at[some]], pa.int32())], names=["doc_id", "shard", "part"])

    wanted = keys.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().mapInArrow(
        placed, "doc_id long, shard int, part int").groupBy("shard", "part").agg(F.collect_list("doc_id").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                shard, ids = Shard(row), np.array(row["wanted"], np.int64)
                found = shard.find(hash_keys(ids, np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)))
                there = found >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[there]), pa.array([shard.ids(s).astype(np.int32) for s in found[there].tolist()], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"])

    return wanted.join(shards, ["shard", "part"]).select(
        "n_docs", "width", "keys", "missing", "seeds", "slots", "payload", "wanted").mapInArrow(run, "doc_id long, ids array<int>")
