"""Cover tree, n-gram join and passage removal against brute force."""

import collections
import gc
import hashlib
import random
import re
import weakref

import numpy as np
from pyspark.sql import functions as F

from terrahaz.llm import cover_tree, group_join, queries, substring_dedup
from terrahaz.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self.find(i)] = self.find(j)


def least(ids, union):
    out = {}
    for i, x in enumerate(ids):
        root = union.find(i)
        out[root] = min(out.get(root, x), x)
    return [out[union.find(i)] for i in range(len(ids))]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def linked_vectors(rows, threshold=0.9):
    def good(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)

    ok = [i for i, (_, v) in enumerate(rows) if good(v)]
    counts, union = [0] * len(rows), Union(len(rows))
    x = np.array([rows[i][1] for i in ok], float)
    if len(ok):
        x /= np.linalg.norm(x, axis=1)[:, None]
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        for a, b in zip(*np.nonzero(link)):
            counts[ok[a]] += 1
            union.join(ok[a], ok[b])
    return sorted(zip([r[0] for r in rows], counts, least([r[0] for r in rows], union)))


def test_op1_against_all_pairs(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    found = queries.QUERIES["op1_cover_tree"](spark, small).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == linked_vectors(rows)


def test_cover_tree_on_crowds_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 96)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * (0.05 + 0.08 * (i % 5))).tolist()) for i in range(400)]
    rows += [(600, None), (601, [0.0] * 8), (602, [1.0] + [None] * 7), (603, [float("nan")] * 8), (604, [])]
    rows += [(610 + i, rows[3][1]) for i in range(50)]
    found = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == linked_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_cover_tree_on_an_empty_table(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_cover_tree_blocks_are_written_once_and_not_sent_to_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 32)
    monkeypatch.setattr(cover_tree, "GROUP", 4)
    monkeypatch.setattr(cover_tree, "SPANS", 50)
    written, plans, checkpointed = [], [], cover_tree.checkpointed

    def counted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        df = checkpointed(df)
        kinds = [c for c, kind in df.dtypes if kind == "binary"]
        written.append(sum(df.agg(*[F.sum(F.octet_length(c)) for c in kinds]).first()) if kinds else 0)
        return df

    monkeypatch.setattr(cover_tree, "checkpointed", counted)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(90, 64))
    x = (base[rng.integers(0, 90, 1200)] + 0.1 * rng.normal(size=(1200, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == linked_vectors(rows)
    assert sum(written) < 3.5 * x.nbytes
    walked = [p for p in plans if "Cartesian" in p]
    assert len(walked) == 1 and "Repartition" not in walked[0] and "Exchange" not in walked[0]


def test_forests_connect_the_same():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 30), (200, 180), (300, 900)):
        a, b = rng.integers(0, n, k) * 7, rng.integers(0, n, k) * 7
        p, q = cover_tree._forest(a, b)
        one, two = Union(7 * n), Union(7 * n)
        for union, pairs in ((one, zip(a, b)), (two, zip(p, q))):
            for i, j in pairs:
                union.join(int(i), int(j))
        assert len(set(p)) == len(p) <= n and least(list(range(7 * n)), one) == least(list(range(7 * n)), two)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def linked_texts(rows, k=3, percent=90):
    sets, union, where = [shingles(x, k) for _, x in rows], Union(len(rows)), collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for token in s for j in where[token])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                union.join(i, j)
        for token in s:
            where[token].append(i)
    return sorted(zip([d for d, _ in rows], map(len, sets), least([d for d, _ in rows], union)))


def family_rows(seed):
    rng, rows = random.Random(seed), []
    for size in (5, 20, 60, 150, 40):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(size)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 1 + size // 20)):
                w[rng.randrange(size)] = "X%d" % rng.randint(0, 5)
            rows.append((len(rows), " ".join(w)))
    return rows + [(900, ""), (901, "a"), (902, "A"), (903, "a b"), (904, "   "), (905, "a b c"), (899, "A  B\nc"), (906, None)]


def test_op8_against_brute_force(spark, small, documents):
    assert sorted(map(tuple, queries.QUERIES["op8_group_join"](spark, small).collect())) == linked_texts(documents)


def test_group_join_on_families_of_near_copies(spark, monkeypatch):
    for name, value in (("QUERIES", 16), ("HUB", 20), ("GROUP", 8)):
        monkeypatch.setattr(group_join, name, value)
    rows = family_rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    assert sorted(map(tuple, group_join.similar_documents(df).collect())) == linked_texts(rows)


def test_what_is_of_no_more_use_goes_before_the_large_steps(spark, monkeypatch):
    alive, steps = [], []
    checkpointed, clear, led, grouped = group_join.checkpointed, group_join.clear, group_join._led, group_join._grouped

    def written(df):
        out = checkpointed(df)
        alive.append((weakref.ref(out), out.columns))
        steps.append("written")
        return out

    def cleared(session):
        clear(session)
        steps.append("cleared")

    def before(step, name):
        def call(*given):
            gc.collect()
            counters = [c for r, c in alive if r() is not None and "cells" in c]
            assert not counters and steps[-1] == "cleared", name
            steps.append(name)
            return step(*given)

        return call

    monkeypatch.setattr(group_join, "checkpointed", written)
    monkeypatch.setattr(group_join, "clear", cleared)
    monkeypatch.setattr(group_join, "_grouped", before(grouped, "grouped"))
    monkeypatch.setattr(group_join, "_led", before(led, "led"))
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[i % 2:58 + i % 2])) for i in range(6)] + [(9, "other words of nobody else")]
    rows = group_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {**{i: 0 for i in range(6)}, 9: 9}
    assert [s for s in steps if s in ("grouped", "led")] == ["grouped", "led"]


def test_every_similar_pair_shares_a_signature():
    import pyarrow as pa

    for percent in (80, 90, 100):
        rows = family_rows(5)[:-8]
        sets, _ = group_join.sets(pa.array([x for _, x in rows], pa.large_string()))
        cells = np.random.default_rng(percent).integers(0, 5, group_join.CELLS)
        marks = [set(group_join._signatures(s, percent, cells).tolist()) for s in sets]
        for i in range(0, len(rows), 7):
            for j in range(i):
                if group_join._similar(sets[i], sets[j], percent):
                    assert marks[i] & marks[j]


def test_keep_one_of_each_group(spark):
    text, other = "a b c d e f g", "q w e r t y u"
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "y"), (3, "", "z"), (3, "", "z"), (None, text, "n"), (None, None, None),
            (5, other, "k"), (4, other, "k"), (4, "some other words that stand alone", "k")]
    kept = group_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(
        [(1, text, "x"), (3, "", "z"), (3, "", "z"), (None, None, None), (4, other, "k"), (4, "some other words that stand alone", "k")], key=str)


def without_repeats(rows, k=20):
    seen, out = set(), []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = WORD.findall(x or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in seen:
                gone[i:i + k] = [True] * k
            seen.add(tuple(w[i:i + k]))
        kept = " ".join(a for a, b in zip(w, gone) if not b)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op5_against_brute_force(spark, small, documents):
    assert sorted(map(tuple, queries.QUERIES["op5_substring_dedup"](spark, small).collect()), key=str) == without_repeats(documents)


def test_passages_in_many_places(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 5000)
    rng = random.Random(4)
    passages = [" ".join(rng.choice("abcde") + str(rng.randint(0, 30)) for _ in range(rng.randint(15, 120))) for _ in range(12)]
    rows = [(i or None, " ".join(rng.choice(passages) if rng.random() < 0.5 else "w%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 8))))
            for i in range(250)]
    rows += [(1000, "a " * 100), (1001, "x y " * 60), (1002, None), (1003, ""), (1004, "a " * 19), (1005, "a " * 20), (7, passages[0]), (7, passages[1])]
    df = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    cut = substring_dedup.remove_repeats(df)
    assert sorted(map(tuple, cut.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == without_repeats(list(dict.fromkeys(rows)))
    for r in cut.where("n_removed > 0").collect():
        assert hashlib.sha256(" ".join(WORD.findall(r["text"])).encode()).hexdigest() == r["kept_sha256"]


def test_passages_of_equal_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "k " * 25), (1, "k " * 25)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()] == [24, 24]
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []
