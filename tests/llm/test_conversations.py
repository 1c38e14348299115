"""Conversation repair against a plain search over all edits."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from terrahaz.llm import conversations, queries
from terrahaz.llm.frames import new_folder

WHITE = " \t\n\x0b\x0c\r"


def search(rows):
    """(cost, audit, repaired) of (role, text, fault) rows: the least of all edits, kept per initials' last letter."""
    def fits(initials):
        return re.fullmatch("s?(ua)*u?", initials)

    def state(initials):
        return initials[-1:]

    def put(best, cost, audit, out):
        initials = "".join(r[:1] for r, _ in out)
        if fits(initials) and not any(r == "" for r, _ in out):
            key = state(initials)
            if key not in best or (cost, audit) < best[key][:2]:
                best[key] = (cost, audit, out)

    def inserts(best):
        for _ in range(2):
            for cost, audit, out in list(best.values()):
                for role in ("user", "assistant"):
                    put(best, cost + 5, audit + "I", out + [(role, "")])
        return best

    best = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for cost, audit, out in best.values():
            put(after, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                put(after, cost + more, audit + "K", out + [(role, text)])
                for other in ("user", "assistant"):
                    put(after, cost + more + 1, audit + "R", out + [(other, text)])
        best = inserts(after)
    ends = [b for b in best.values() if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in b[2]))]
    return min(ends, key=lambda b: b[:2])


def plain(table):
    groups = {}
    for conv, turn, role, text in table:
        kept = groups.setdefault(conv, [])
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
        if kind:
            kept += [(turn, "user" if kind == 4 else shown[2], text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, told, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in rows:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            told.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, fixed = search(told)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:])), cost, audit,
                    sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    folder = new_folder(spark, "t")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("clash")).withColumn(
        "present", F.lit(False)).write.parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, queries.QUERIES["op13_conversation_repair"](spark, folder).collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op13_conversation_repair"](spark, folder)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(400):
        turns = sorted(rng.sample(range(-3, 60), rng.randint(1, 12)))
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "union", None]),
                  rng.choice(["One.", "Two!", "no end", "  \t", "", None, "Three? ", f"Text {t}.", "."])) for t in turns]
    rows += [(None, None, "user", "A."), (None, 4, "assistant", "B."), (9000, None, "system", "C"), (9000, 7, "user", "C.")]
    assert run(spark, rows) == plain(rows)


def test_long_conversation_long_text_and_empty_table(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 900)} says{rng.choice(['.', '!', ' '])}") for t in range(3000)]
    rows += [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "end.")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_chunks_give_the_same_as_the_whole():
    rng = random.Random(2)
    for size in (1, 2, 7, 40, 333):
        codes = bytes(rng.choice([0, 1, 2, 3]) | rng.choice([0, 0, 0, 1, 2, 3]) << 2 for _ in range(size))
        (whole,) = conversations.solve([codes])
        assert {conversations.solve_long(codes, chunk) for chunk in (1, 3, 16, 1000)} == {whole}


def test_ranks_order_nodes_by_their_audits():
    import numpy as np

    codes = bytes([1, 1 | 12, 2, 0, 3 | 8, 1, 2 | 4, 2, 1])
    cost = np.array(conversations._costs(codes, conversations.END))
    letter, target = conversations._arcs(np.frombuffer(codes, np.uint8).astype(np.int64), cost, True)
    levels, length, rank = conversations._ranked(letter, target)
    audits = conversations._paths(levels, length, letter, np.arange(len(letter)))
    order = sorted(set(audits))
    assert [order.index(a) for a in audits] == np.unique(rank, return_inverse=True)[1].tolist()


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True), (1, 1, "user", "Yes.", True), (2, 0, "assistant", "Cut", True), (3, 0, "user", "x", False)],
                                 "conv_id long, turn long, role string, text string, present boolean")
    found = conversations.reports(rows)
    assert sorted(map(tuple, conversations.repaired(rows, found).collect())) == [
        (1, 0, "K", 0, "user", "Hi."), (1, 1, "R", 1, "assistant", "Yes.")]
    assert sorted(map(tuple, found.select("conv_id", "cost", "audit").collect())) == [(1, 1, "KR"), (2, 2, "D"), (3, 0, "")]
