"""Best-two-fit packing: whole results, against packing one sequence at a time, and near the least number."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrahaz.llm import packing, queries
from terrahaz.llm.frames import new_folder

FILE = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, size):
    left, out = sorted(lengths), []
    while left:
        taken, gap = [], size
        while True:
            fit = [x for x in left if x <= gap]
            if not fit:
                break
            taken.append(max(fit))
            left.remove(taken[-1])
            gap -= taken[-1]
        while gap:
            least = min(taken)
            pairs = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[i + 1:] if least < a + b <= least + gap]
            if not pairs:
                break
            total, a, b = max(pairs, key=lambda p: (p[0], -p[1]))
            top = [p for p in pairs if p[0] == total]
            a, b = min(p[1:] for p in top if p[1] >= p[2])
            taken.remove(least)
            taken += [a, b]
            left.remove(a)
            left.remove(b)
            left = sorted(left + [least])
            gap = size - sum(taken)
        out.append(sorted(taken, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_histogram_packs_as_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 40, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 120))] + [size // 3] * rng.randint(0, 60)
    made = packing.best_two_fit(np.bincount(lengths, minlength=size + 1))
    whole = [sorted(taken, reverse=True) for many, taken in made for _ in range(many)]
    assert sorted(x for t in whole for x in t) == sorted(lengths)
    assert all(sum(t) <= size for t in whole)
    assert len(whole) == len(one_by_one(lengths, size))


def test_smallest_goes_out_for_two_that_fit():
    assert packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11)) == [(1, [6, 2, 2]), (1, [3])]


def checked(found, docs, size=2048):
    tokenizer = Tokenizer.from_file(FILE)
    expected = []
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % size + 1
        for k, a in enumerate([0, *range(first, len(ids), size)]):
            part = ids[a:first if k == 0 else a + size]
            expected.append((doc_id, k, a, len(part), zlib.crc32(part.tobytes())))
    rows = list(map(tuple, found.collect()))
    assert sorted((r[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= size
    return len(bins), -(-sum(r[3] for r in rows) // size)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    bins, least = checked(queries.QUERIES["op12_best_two_fit"](spark, folder), docs)
    assert bins <= least + max(1, least // 200)


def test_odd_rows(spark):
    docs = [(1, None), (1, None), (None, ""), (None, "a <|endoftext|> b"), (4, "word " * 30_000), (5, "a" * 9000), (-2, "zß²"), (7, " ".join("x" * 2047))]
    docs += [(100 + i, "same text here") for i in range(300)]
    folder = new_folder(spark, "t")
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("length", F.lit(-1)).repartition(
        5).write.parquet(f"{folder}/documents.parquet")
    bins, least = checked(queries.QUERIES["op12_best_two_fit"](spark, folder), docs)
    assert bins == least
    folder = new_folder(spark, "t")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert queries.QUERIES["op12_best_two_fit"](spark, folder).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "many words " * (i % 50)) for i in range(200)], "doc_id long, text string")
    folder = new_folder(spark, "p")
    packing.write_pieces(docs, folder, FILE, 0, size=64)
    assigned = packing.assign(spark.read.parquet(folder), size=64)
    wanted = {}
    for r in sorted(assigned.collect(), key=lambda r: r["offset"]):
        wanted[r["sequence_id"]] = wanted.get(r["sequence_id"], b"") + bytes(r["ids"])
    rows = packing.sequences(assigned).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in rows} == wanted
    assert all(r["length"] == sum(r["doc_lengths"]) <= 64 for r in rows)
