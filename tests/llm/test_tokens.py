"""Byte-level BPE against tiktoken, token shards against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from terrahaz.llm import byte_bpe, encoder, queries, token_shards
from terrahaz.llm.frames import new_folder

RANKS, FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_rank_queue_pops_the_lowest_rank_first():
    queue = byte_bpe.RankQueue()
    ranks = [50_000, 3, 64, 4_096, 63, 4_095, 3]
    for i, rank in enumerate(ranks):
        queue.push(rank, np.array([i]))
    popped = []
    while queue.top:
        popped.append(queue.pop()[0])
    assert popped == sorted(set(ranks))


def test_encoding_equals_the_library(bpe, library):
    rng = random.Random(7)
    letters = ["ab<éß 1\n\t ²\x1c", "aaab ", "the a²½Ⅷ́ 한", "thiscanot '’sdl,."]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 5001, "ab" * 3000, "é" * 2000, "the" * 3000, "<|endoftext|>", ""]
    for text, ids in zip(texts, bpe.encode(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_cache_limit_changes_nothing(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 3)
    fresh = byte_bpe.ByteBpe(bpe.ranks, public_tokenizers.PATTERN)
    for text in ("one two three four", "four three two one", "one one"):
        assert np.frombuffer(fresh.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_op4_digests(spark, small, documents, library):
    expected = []
    for doc_id, text in documents:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        expected.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.QUERIES["op4_byte_bpe"](spark, small).collect())) == sorted(expected)


def test_encode_keeps_rows_and_replaces_a_clashing_column(spark, library):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "y")], "doc_id long, text string, ids string")
    rows = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in rows) == [(0, library.encode_ordinary("a b")), (1, []), (1, [])]
    assert byte_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def expected_shards(rows):
    tokenizer = Tokenizer.from_file(FILE)
    encoded = [(d, tokenizer.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in rows]
    encoded.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    out, place = [], 0
    for d, ids in encoded:
        out.append((d, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    return sorted(out, key=str)


def test_added_tokens_as_the_library_reads_them():
    tokenizer = Tokenizer.from_file(FILE)
    texts = ["one two", "one <|endoftext|> two", "<|endoftext|><|endoftext|>", "", "<|endoftext|", "x<|endoftext|>\n y one"]
    expected = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    own = encoder.Encoder(FILE)
    found = [np.frombuffer(x, own.dtype).tolist() for x in own(texts)]
    assert found == expected and found[2] == [50256, 50256]


def test_array_encoder_equals_the_library(monkeypatch):
    rng, tokenizer = random.Random(5), Tokenizer.from_file(FILE)
    letters = ["ab<éß 1\n\t ²\x1c\x85\xa0\u3000", "aaab ", "the a²½Ⅷ́ 한", "thiscanot '’sdl,.revm", "'s 'll've'd're'm't x'"]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    points = [lambda: rng.randrange(0xD800), lambda: rng.randrange(0xE000, 0x110000), lambda: rng.choice(b" 's1a\n")]
    texts += ["".join(chr(rng.choice(points)()) for _ in range(40)) for _ in range(3000)]
    texts += ["a" * 5001, "ab" * 3000, " " * 4000 + "x", "don't've", "'", "'l", "x'", "''s", " 's", "\u088f a", ""]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    own = encoder.Encoder(FILE)
    assert [np.frombuffer(x, own.dtype).tolist() for x in own(texts)] == expected
    monkeypatch.setattr(encoder, "REMEMBERED", 50)
    for k in range(0, 400, 20):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own(texts[k:k + 20])] == expected[k:k + 20]


def test_op10_against_the_library(spark, small, documents, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_TEXT_BYTES", 100_000)
    monkeypatch.setattr(token_shards, "PAYLOAD_BYTES", 20_000)
    assert sorted(map(tuple, queries.QUERIES["op10_token_shards"](spark, small).collect()), key=str) == expected_shards(documents)


def test_shards_of_odd_rows_and_lookup(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "c"), (None, "x"), (None, None), (7, None), (3, ""), (-4, "zß²"), (9, "a <|endoftext|> b")]
    folder = new_folder(spark, "shards")
    token_shards.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, FILE, 2)
    assert sorted(map(tuple, token_shards.read_documents(spark, folder).collect()), key=str) == expected_shards(rows)
    wanted = spark.createDataFrame([(7,), (99,), (-4,), (-9,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_shards.lookup(spark, folder, wanted).collect()}
    assert set(found) == {7, -4} and found[7] == [2]


def test_empty_table_of_shards(spark):
    folder = new_folder(spark, "shards")
    token_shards.write(spark.createDataFrame([], "doc_id long, text string"), folder, FILE, 2)
    assert token_shards.read_documents(spark, folder).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64)
    index = token_shards.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(3000))
