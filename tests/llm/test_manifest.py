"""Merkle manifest against a plain recursive tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from terrahaz.llm import merkle, queries
from terrahaz.llm.frames import new_folder


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, sibling texts level by level of every leaf, (place in run) and runs for folding)."""
    steps, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            steps[k].append((run[:i % 16], run[i % 16 + 1:]))
            at[k] = i // 16
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text), doc_ids distinct within a source."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        made[s] = plain_tree([plain_leaf(r) for r in groups[s]])
    root, top = plain_tree([made[s][0] for s in order])
    out = []
    for s, above in zip(order, top):
        for r, steps in zip(groups[s], made[s][1]):
            whole = steps + above
            proof = h(*(x for left, right in whole for x in left + right))
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf(r[:4] + (text,))
            for left, right in whole:
                folded = h(*left, folded, *right)
            out.append((r[0], plain_leaf(r), made[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, queries.QUERIES["op11_merkle_manifest"](spark, folder).collect()), key=repr)


@pytest.mark.parametrize("leaves", [1, 2, 16, 17, 255, 256, 257, 300, 4096])
def test_closed_form_places(leaves):
    log, at = merkle.AppendLog(merkle.height(leaves)), {}
    write = log.append

    def noted(digest, level=0):
        at[level, sum(1 for l, _ in at if l == level)] = len(log.nodes) // 32
        write(digest, level)

    log.append = noted
    for i in range(leaves):
        log.append(i.to_bytes(32, "big"))
    log.finish()
    assert at == {key: merkle.place(*key, leaves) for key in at}
    assert max(at.values()) + 1 == len(at) == len(log.nodes) // 32


def test_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted(map(tuple, queries.QUERIES["op11_merkle_manifest"](spark, small).collect()), key=repr)
    assert found == plain(rows)
    assert {r[-1] for r in found} == {True, False}


def test_hot_source_of_several_builders_and_many_sources(spark):
    rows = [(i * 7 - 900, "hot", "en", i, f"Text {i}") for i in range(8200)]
    rows += [(i, f"s{i % 700}", None, None, f"Other {i}") for i in range(1400)]
    assert run(spark, new_folder(spark, "t"), rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, "", "x", -3, ""), (None, "a", "é", 2, "É ABC"), (None, "a", "é", 2, "É ABC"), (5, "a", "-", 0, "Zß²"),
            (5, "a", "-", 0, "Zß²"), (5, "a", "-", 0, "zß²"), (-9, "=a", "1:", 1, "A" * 300_000), (10, "ä", "l", 1, "plain")]
    assert run(spark, new_folder(spark, "t"), rows) == plain(rows)


def test_lone_leaf_is_the_root_and_empty_table(spark):
    (row,) = run(spark, new_folder(spark, "t"), [(3, "s", "en", 1, "A")])
    assert row[1] == row[2] == row[3] == row[5] == plain_leaf((3, "s", "en", 1, "A")) and row[4] == h()
    assert run(spark, new_folder(spark, "t"), []) == []
