"""Repair of conversations: the cheapest edits that make turns alternate, the least audit among equally cheap ones."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# fixed values: costs of the edits, and what a cut-off row that stays adds
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
CHUNK = 32_768
"""Rows whose nodes are ranked at once; longer conversations are worked chunk by chunk, from their end."""

_NONE = 1 << 40
# States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. An inserted or renamed row leads to _NEXT, a kept one to _KEPT.
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.full((4, 4), -1)  # by state and initial (s, u, a, other)
_KEPT[0, 0], _KEPT[[0, 1, 3], 1], _KEPT[2, 2] = 1, 2, 3
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_INITIAL = {"s": 0, "u": 1, "a": 2}
_OK, _BLANK, _COPY, _CUT = range(4)
_LETTERS = np.frombuffer(b"DIKR", np.uint8)


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of ``df`` damaged by crc32('conv_id:turn') % 20, nulls as one blank.

    0 drops a row (it stays with ``present`` false, so that its conversation is still known), 1 empties
    its text, 2 takes its ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text, role = F.col("kind"), F.coalesce(F.col("text").cast("string"), blank), F.coalesce(F.col("role").cast("string"), blank)
    return (df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(said.cast("binary")), F.lit(20)).alias("kind"))
            .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))))
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    (kind != 0).alias("present")))


def _digest() -> Column:
    """128 bits of role and text: tells repeats, and orders rows of one turn and role."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))


def _costs(codes: bytes, after: tuple[int, ...]) -> list[int]:
    """Least cost to the end from each state before each row and after the last, where ``after`` holds; row by row."""
    f0, f1, f2, f3 = after
    out = [f3, f2, f1, f0]
    for code in reversed(codes):
        start, fault = code & 3, code >> 2
        g0, g1, g2, g3 = f0 + DELETE, f1 + DELETE, f2 + DELETE, f3 + DELETE
        if fault not in (_BLANK, _COPY):
            extra = CUT_OFF if fault == _CUT else 0
            to_user, to_other = f2 + extra, f3 + extra
            more = to_user if start == 1 else to_user + RENAME
            g0, g1, g3 = min(g0, more), min(g1, more), min(g3, more)
            g2 = min(g2, to_other if start == 2 else to_other + RENAME)
            if start == 0:
                g0 = min(g0, f1 + extra)
        f0, f1 = min(g0, g2 + INSERT, g3 + 2 * INSERT), min(g1, g2 + INSERT, g3 + 2 * INSERT)
        f2, f3 = min(g2, g3 + INSERT), min(g3, g2 + INSERT)
        out += (f3, f2, f1, f0)
    out.reverse()
    return out


END = (0, 2 * INSERT, INSERT, 0)
"""Least cost from each state behind the last row."""


def _arcs(codes: np.ndarray, cost: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letter and target of the least optimal arc of each node (row, state), -1 and itself where an audit ends.

    An arc is optimal if its price is what the cost falls by. Arcs of one node bear different
    letters, so the least letter is one arc. Nodes behind the last row of a chunk that is not the last have none.
    """
    m = len(codes)
    node = np.arange(4 * (m + 1))
    state, row = node & 3, node >> 2
    start, fault = np.append(codes & 3, 3)[row], np.append(codes >> 2, _BLANK)[row]
    extra = np.where(fault == _CUT, CUT_OFF, 0)
    inside, free = row < m, (fault == _OK) | (fault == _CUT)
    kept = _KEPT[state, start]
    below = 4 * (row + 1)
    letter, target = np.full(len(node), -1), node.copy()
    for k, to, price, can in (
            (3, below + _NEXT[state], RENAME + extra, inside & free), (2, below + kept, extra, inside & free & (kept >= 0)),
            (1, 4 * row + _NEXT[state], INSERT, inside | last), (0, below + state, DELETE, inside)):
        to = np.where(can, to, node)
        best = can & (cost == cost[to] + price)
        letter[best], target[best] = k, to[best]
    return letter, target


def _ranked(letter: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pointers over 1, 2, 4, ... letters, length of each node's audit, rank of nodes by their least audits.

    ``rank`` after k rounds orders nodes by the first 2**k letters of their audit: the pair of a node's rank and that
    of the node 2**k letters on gives twice as many. An audit that ends stays where it is and comes first.
    """
    rank, pointer, length, levels = letter + 1, target, (letter >= 0).astype(np.int64), []
    while True:
        levels.append(pointer)
        beyond = pointer[pointer]
        if (beyond == pointer).all():
            return levels, length, rank
        length = length + length[pointer]
        _, rank = np.unique(rank * (len(rank) + 5) + rank[pointer], return_inverse=True)
        pointer = beyond


def _paths(levels: list[np.ndarray], length: np.ndarray, letter: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The audit from each start: the node after t letters by the pointers of t's binary digits."""
    sizes = length[starts]
    until = np.cumsum(sizes)
    step = np.arange(until[-1] if len(until) else 0) - np.repeat(until - sizes, sizes)
    node = np.repeat(starts, sizes)
    for k, pointer in enumerate(levels):
        on = (step >> k & 1).astype(bool)
        node[on] = pointer[node[on]]
    said = _LETTERS[letter[node]].tobytes()
    return [said[a:b] for a, b in zip((until - sizes).tolist(), until.tolist())]


def solve(conversations: list[bytes]) -> list[tuple[int, bytes]]:
    """Cost and audit of each conversation, given as one code a row: initial (s, u, a, other) + 4 * fault."""
    parts, letters, targets, at = [], [], [], 0
    for codes in conversations:
        cost = np.array(_costs(codes, END), np.int64)
        letter, target = _arcs(np.frombuffer(codes, np.uint8).astype(np.int64), cost, True)
        parts.append((at, int(cost[0])))
        letters.append(letter)
        targets.append(target + at)
        at += len(cost)
    if not parts:
        return []
    letter = np.concatenate(letters)
    levels, length, _ = _ranked(letter, np.concatenate(targets))
    audits = _paths(levels, length, letter, np.array([a for a, _ in parts]))
    return [(cost, audit) for (_, cost), audit in zip(parts, audits)]


def solve_long(codes: bytes, chunk: int = CHUNK) -> tuple[int, bytes]:
    """``solve`` of one conversation in chunks from its end: each keeps the audits and ends of its four first nodes."""
    after, done = END, []
    for low in reversed(range(0, max(1, len(codes)), chunk)):
        part, last = codes[low:low + chunk], not done
        cost = np.array(_costs(part, after), np.int64)
        letter, target = _arcs(np.frombuffer(part, np.uint8).astype(np.int64), cost, last)
        levels, length, _ = _ranked(letter, target)
        done.append((_paths(levels, length, letter, np.arange(4)), (levels[-1][:4] & 3).tolist()))
        after = tuple(cost[:4].tolist())
    state, audit = 0, []
    for audits, ends in reversed(done):
        audit.append(audits[state])
        state = ends[state]
    return after[0], b"".join(audit)


class _Report:
    """What a conversation's rows tell, one after the other."""

    def __init__(self, conv):
        self.conv, self.codes, self.faults, self.illegal = conv, bytearray(), [0, 0, 0, 0], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, initial: str, blank: bool, cut: bool, copy: int) -> None:
        start = _INITIAL.get(initial, 3)
        if self.codes and (self.codes[-1] & 3, start) not in _LEGAL:
            self.illegal += 1
        fault = _BLANK if blank else _COPY if copy > 1 else _CUT if cut else _OK
        self.faults[fault] += 1
        self.codes.append(start | fault << 2)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def row(self, cost: int, audit: bytes) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, cost, audit.decode())


_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit.

    ``rows`` has conv_id, turn, role, text and present; rows that are not present only name their conversation.
    Rows go by turn, nulls first; those of one turn by role and a digest of their text, so equal rows are neighbours.
    A null role or text counts as one blank. The audit is the string of edits Keep, Rerole, Delete, Insert of least
    cost, the ASCII-least of them. Conversations without rows have zeros and ''.

    Repeats are numbered by a window over equal rows, before rows meet by conversation; there a row is
    one byte, so a conversation costs a task no more than its audit does, however long its texts are.
    """
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    trimmed = F.btrim("text", F.lit(WHITE))
    light = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "present", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).select("conv_id", "turn", "present", "role", _digest().alias("digest"), (trimmed == "").alias("blank"),
             (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    equal = Window.partitionBy("conv_id", "present", "role", "digest").orderBy("turn")
    ordered = (light.withColumn("copy", F.row_number().over(equal)).repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "digest", "copy")
               .select("conv_id", "turn", "present", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "copy"))
    schema = ", ".join([f"conv_id {kind.simpleString()}"] + [f"{c} long" for c in _COLUMNS[1:-1]] + ["audit string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def solved() -> pa.RecordBatch:
            short = [r for r in held if len(r.codes) <= CHUNK]
            found = dict(zip(map(id, short), solve([bytes(r.codes) for r in short])))
            out = [r.row(*(found[id(r)] if id(r) in found else solve_long(bytes(r.codes)))) for r in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], arrow), *(pa.array([o[k] for o in out], pa.int64()) for k in range(1, 7)),
                 pa.array([o[7] for o in out], pa.string())], names=_COLUMNS)

        for batch in batches:
            for conv, turn, present, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if not held or conv != held[-1].conv:
                    if size > CHUNK:
                        yield solved()
                        held, size = [], 0
                    held.append(_Report(conv))
                if present:
                    held[-1].add(turn, *rest)
                    size += 1
        if held:
            yield solved()

    return ordered.mapInArrow(run, schema)


class _Repair:
    """Applies an audit to the rows of its conversation in order."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.place = conv, audit, 0, 0
        self.shift = sum(map(audit.count, "IKR")) % 2  # an odd number begins with the system row

    def _put(self, edit: str, turn, role: str, text: str) -> tuple:
        self.place += 1
        return (self.conv, self.place - 1, edit, turn, role, text)

    def _due(self) -> str:
        return "user" if (self.place - self.shift) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put("I", None, self._due(), "")

    def row(self, turn, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(edit, turn, role if edit == "K" else self._due(), text)


def _repairs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows as one table, each audit before the rows of its conversation, in their order."""
    audits = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
                          "audit", F.lit(None).cast("binary").alias("digest"))
    texts = rows.where("present").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(None).cast("string").alias("audit"),
    ).withColumn("digest", _digest())
    return (audits.unionByName(texts).repartition("conv_id")
            .sortWithinPartitions("conv_id", F.isnull("audit"), "turn", "role", "digest").drop("digest"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired rows, conversation by conversation, and one of place -1 at the start of each."""
    now = None
    for batch in batches:
        for conv, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if now is not None:
                    yield from now.inserted()
                now = _Repair(conv, audit)
                yield (conv, -1, "", None, "", "")
            else:
                yield from now.row(turn, role, text)
    if now is not None:
        yield from now.inserted()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), turn (null if inserted), role, text.

    ``found`` is ``reports(rows)``. Rows stream through a task in order; none is held.
    """
    kind = rows.schema["conv_id"].dataType
    kinds = (to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(_stream(batches)):
            batch = [r for r in batch if r[1] >= 0]
            if batch:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in batch], t) for k, t in enumerate(kinds)],
                                                 names=["conv_id", "place", "edit", "turn", "role", "text"])

    return _repairs(rows, found).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, edit string, turn long, role string, text string")


def batches_of(rows: Iterator[tuple], size: int = 1024, most: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows in lists of at most ``size``, or as many as hold ``most`` characters of text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[5])
        if len(held) >= size or chars > most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: lowercase hex SHA-256 of each repaired conversation's 'role:text', joined by newlines."""
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, sums, state = [], [], sha256()
        for conv, place, _, _, role, text in _stream(batches):
            if place < 0:
                if convs:
                    sums.append(state.hexdigest())
                if len(convs) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(sums)], names=["conv_id", "repaired_sha256"])
                    convs, sums = [], []
                convs.append(conv)
                state = sha256()
            else:
                state.update(("\n" * (place > 0) + role + ":" + text).encode())
        if convs:
            sums.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(sums)], names=["conv_id", "repaired_sha256"])

    return _repairs(rows, found).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")
