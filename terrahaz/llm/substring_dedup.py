"""Repeated word passages across and within documents, removed by suffix automata of reference shards."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrahaz.llm import words
from terrahaz.llm.frames import bitmap, checkpointed, flat, in_bitmap, release, slot, text_slices, total_bytes

WINDOW = 20
"""Words of a passage that counts as repeated."""
ANCHOR = 8
"""Words of an anchor; each window has the anchor of least hash among its own."""
REACH = 128
"""Words of a reference document behind one family of anchors."""
SHARD_BYTES = 1_500_000
"""Text of one automaton, about."""
_LEAST = -(1 << 63)


class SuffixAutomaton:
    """All substrings of the sequences added so far.

    States are rows of flat arrays with one edge each, which is all that nearly every state has;
    only the further edges of branching states lie in dicts. A state takes some 24 bytes.
    """

    def __init__(self):
        self.word, self.to = array("Q", [0]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.size = array("i", [-1]), array("i", [0])

    def _get(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def _set(self, state: int, c: int, to: int) -> None:
        if self.to[state] < 0 or self.word[state] == c:
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, link: int, size: int) -> int:
        self.word.append(0)
        self.to.append(-1)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.link[q], self.size[p] + 1)
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = self.more[q].copy()
        while p >= 0 and self._get(p, c) == q:
            self._set(p, c, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, c: int) -> tuple[int, int]:
        """Add ``c`` behind the state ``last``; the new state and the length of the longest suffix seen before."""
        q = self._get(last, c)
        if q >= 0:
            state = q if self.size[q] == self.size[last] + 1 else self._clone(last, c, q)
            return state, self.size[state]
        state = self._state(0, self.size[last] + 1)
        p = last
        while p >= 0 and self._get(p, c) < 0:
            self._set(p, c, state)
            p = self.link[p]
        if p >= 0:
            q = self._get(p, c)
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
        return state, self.size[self.link[state]]

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each place the length of the longest substring that ends there and is known."""
        word, after, more, link, size = self.word, self.to, self.more, self.link, self.size
        state, length, found = 0, 0, []
        for c in sequence:
            while True:
                to = after[state] if word[state] == c else more[state].get(c, -1) if state in more else -1
                if to >= 0 or not state:
                    break
                state = link[state]
                length = size[state]
            if to < 0:
                length = 0
            else:
                state = to
                length += 1
            found.append(length)
        return found


class Shard:
    """Passages in their order; tells which windows of each stood before and learns the others."""

    def __init__(self, window: int):
        self.automaton, self.window, self.whole = SuffixAutomaton(), window, set()

    def repeats(self, hashed: np.ndarray) -> np.ndarray:
        """Ends (last words) of the windows that also start earlier."""
        n, w = len(hashed), self.window
        key = (words.mix(hashed + np.arange(n, dtype=np.uint64) * words._RUN).sum(dtype=np.uint64).item(), n)
        if key in self.whole:
            return np.arange(w - 1, n)
        self.whole.add(key)
        sequence = hashed.tolist()
        known = np.array(self.automaton.statistics(sequence)) >= w
        known[:w - 1] = True  # no window ends there
        fresh = np.flatnonzero(~known)
        if len(fresh):
            cut = np.flatnonzero(np.append(True, fresh[1:] != fresh[:-1] + 1))
            for a, b in zip(fresh[cut].tolist(), fresh[np.append(cut[1:], len(fresh)) - 1].tolist()):
                last = 0
                for i in range(a - w + 1, b + 1):
                    last, before = self.automaton.extend(last, sequence[i])
                    known[i] |= before >= w
        return np.flatnonzero(known[w - 1:]) + w - 1


def _anchors(texts: pa.Array, window: int, anchor: int):
    """Word bounds and hashes, then of each window its first word and the first word of its anchor (with its hash)."""
    data, offsets = flat(texts)
    starts, ends, first = words.bounds(data, offsets)
    hashed = words.hashes(data, starts, ends)
    n, span = len(hashed) - window + 1, window - anchor + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return starts, ends, first, hashed, empty, empty, np.zeros(0, np.uint64)
    grams = hashed[:len(hashed) - anchor + 1].copy()
    for k in range(1, anchor):
        grams *= words._RUN
        grams += hashed[k:k + len(grams)]
    grams = words.mix(grams)
    least, at = grams[:n].copy(), np.arange(n)
    for k in range(1, span):
        lower = grams[k:k + n] < least
        least[lower] = grams[k:k + n][lower]
        at[lower] = np.flatnonzero(lower) + k
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    keep = np.arange(n) + window <= first[row + 1]
    return starts, ends, first, hashed, np.flatnonzero(keep), at[keep], least[keep]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, copy, slot, row): a number for each distinct document and the columns of ``docs`` as ``row``.

    Rows of one doc_id with different texts are told apart by their order by text.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), F.struct(*docs.columns).alias("row"))
    if keyed.groupBy("doc").count().where("count > 1").isEmpty():
        keyed = keyed.withColumn("copy", F.lit(0))
    else:
        keyed = keyed.withColumn("copy", F.dense_rank().over(Window.partitionBy("doc").orderBy("row.text")) - 1)
    return keyed.withColumn("slot", slot("doc", "copy"))


def _repeated(keyed: DataFrame, window: int, anchor: int, shards: int) -> DataFrame:
    """(doc, copy, pos, shard) of every anchor that stands in several places."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            _, _, first, _, _, at, least = _anchors(texts, window, anchor)
            at, index = np.unique(at, return_index=True)
            row = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(least[index].view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array((at - first[row]).astype(np.int32))], names=["anchor", "doc", "copy", "pos"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: the first of an anchor is its reference; the last row waits for what follows
        held = None
        family = np.uint64(0)
        several = False

        def emit(rows, families):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32)),
                 pa.array((families % np.uint64(shards)).astype(np.int32))], names=["doc", "copy", "pos", "shard"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            carried = held is not None
            rows = np.concatenate([held, rows]) if carried else rows
            start = np.append(True, rows[1:, 0] != rows[:-1, 0])
            number = np.cumsum(start) - 1
            heads = rows[start]
            own = words.mix(words.mix(heads[:, 1].astype(np.uint64)) + (heads[:, 2] << 32 | heads[:, 3] // REACH).astype(np.uint64))
            if carried:
                own[0] = family
            count = np.bincount(number)
            more = count > 1
            if carried and several:
                more[0] = True
            out = more[number]
            out[-1] = False
            yield emit(rows[out], own[number[out]])
            held, family, several = rows[-1:], own[-1], bool(more[-1])
        if held is not None and several:
            yield emit(held, np.array([family]))

    found = keyed.select("doc", "copy", "row.text").mapInArrow(find, "anchor long, doc long, copy int, pos int")
    return found.repartition("anchor").sortWithinPartitions("anchor", "doc", "copy", "pos").mapInArrow(
        gather, "doc long, copy int, pos int, shard int")


def _sieved(keyed: DataFrame, wanted: DataFrame, other: bool = False) -> DataFrame:
    """Rows of ``keyed`` whose slot the wanted documents use (``other``: does not)."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap(wanted.select(slot("doc", "copy"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = in_bitmap(shared.value, batch.column(batch.schema.get_field_index("slot")).to_numpy())
            yield batch.filter(pa.array(~inside if other else inside))

    return keyed.mapInArrow(run, keyed.schema)


def _pieces(keyed: DataFrame, repeated: DataFrame, window: int, anchor: int) -> DataFrame:
    """(shard, doc, copy, start, text): the stretches of windows whose anchors belong to one shard."""
    texts = _sieved(keyed.select("doc", "copy", "slot", F.col("row.text").alias("text")), repeated).distinct().select(
        "doc", "copy", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("shard"), "text")
    rows = texts.union(repeated.select("doc", "copy", F.lit(0).alias("kind"), "pos", "shard", F.lit(None).cast("string").alias("text")))

    def cut(doc, copy, marks, text):
        starts, ends, first, _, begin, at, _ = _anchors(pa.array([text or ""], pa.large_string()), window, anchor)
        data = (text or "").encode()
        order = np.argsort(marks[0])
        pos, shard = marks[0][order], marks[1][order]
        k = np.minimum(np.searchsorted(pos, at), len(pos) - 1)
        own = np.where(pos[k] == at, shard[k], -1)
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(own)).tolist()):
            if own[a] >= 0:
                yield int(own[a]), doc, copy, a, data[starts[a]:ends[b + window - 2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pos, shard = None, [], []
        for batch in batches:
            out = []
            doc, copy, kind = (batch.column(i).to_numpy() for i in range(3))
            change = np.append(True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1]))
            edges = np.flatnonzero(change)
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(doc)).tolist()):
                key = (int(doc[a]), int(copy[a]))
                if key != current:
                    current, pos, shard = key, [], []
                if kind[a] == 0:
                    pos.append(batch.column(3).slice(a, b - a).to_numpy())
                    shard.append(batch.column(4).slice(a, b - a).to_numpy())
                elif pos:
                    out += cut(*key, (np.concatenate(pos), np.concatenate(shard)), batch.column(5)[a].as_py())
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                names=["shard", "doc", "copy", "start", "piece"])

    return rows.repartition("doc", "copy").sortWithinPartitions("doc", "copy", "kind").mapInArrow(
        run, "shard int, doc long, copy int, start int, piece binary")


def _matched(pieces: DataFrame, window: int) -> DataFrame:
    """(doc, copy, begin, end): runs of words to remove, found by the automaton of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        for batch in batches:
            out = []
            data, offsets = flat(batch.column(4).cast(pa.large_binary()))
            starts, ends, first = words.bounds(data, offsets)
            hashed = words.hashes(data, starts, ends)
            columns = (batch.column(i).to_pylist() for i in range(4))
            for k, (number, doc, copy, start) in enumerate(zip(*columns)):
                if number != current:
                    current, shard = number, Shard(window)
                last = shard.repeats(hashed[first[k]:first[k + 1]])
                if len(last):
                    edge = np.flatnonzero(np.append(True, last[1:] != last[:-1] + 1))
                    for a, b in zip(last[edge].tolist(), last[np.append(edge[1:], len(last)) - 1].tolist()):
                        out.append((doc, copy, start + a - window + 1, start + b + 1))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=["doc", "copy", "begin", "end"])
        shard = None
        release()

    return pieces.repartition("shard").sortWithinPartitions("shard", "doc", "copy", "start").mapInArrow(
        run, "doc long, copy int, begin int, end int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and n_words, n_removed, spans and kept_sha256.

    A word (run of bytes other than white space) goes when it lies in a window of ``window``
    words whose sequence also starts earlier: in a smaller doc_id, or earlier in the same text.
    Windows are judged on the input. ``spans`` lists the removed runs as (begin, end) in words,
    ``kept_sha256`` is of the kept words joined by one space; a text without removals stays as it is,
    in others a span goes with the white space behind it.

    1. Each window has an anchor, its ``anchor``-word sequence of least hash: equal windows have equal ones.
       Only anchors that stand in several places go on, each with a family (its first place).
    2. The stretches of text under the anchors of a family go to one shard, so all copies of a
       window meet, usually as one piece per passage.
    3. A shard streams its pieces in document order over a suffix automaton of what was new so far:
       matching statistics of at least ``window`` words are repeats, the rest is added. Equal pieces are
       recognised at once. Memory grows with the distinct text of a shard, not with its copies.

    Null and empty texts have no words. Rows of one doc_id with different texts are ordered by text;
    equal rows are one document and are treated alike; a null doc_id comes first. Columns
    named like the new ones are replaced. An empty table gives an empty result.
    """
    added = ("n_words", "n_removed", "spans", "kept_sha256")
    docs = docs.drop(*added)
    keyed = _keyed(docs)
    shards = max(1, int(0.6 * total_bytes(docs)) // SHARD_BYTES)
    repeated = checkpointed(_repeated(keyed, window, anchor, shards))
    ranges = checkpointed(_matched(_pieces(keyed, repeated, window, anchor), window))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
                           T.StructField("kept_sha256", T.StringType(), False)])
    plain = _sieved(keyed, ranges, other=True).select("doc", "copy", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("begin"),
                                                      F.lit(None).cast("int").alias("end"), "row")
    some = _sieved(keyed, ranges).select(plain.columns[0], "copy", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("begin"),
                                         F.lit(None).cast("int").alias("end"), "row")
    marks = ranges.select("doc", "copy", F.lit(0).alias("kind"), "begin", "end", F.lit(None).cast(some.schema["row"].dataType).alias("row"))
    cut = _cut(schema)
    return plain.mapInArrow(cut, schema).union(
        some.union(marks).repartition("doc", "copy").sortWithinPartitions("doc", "copy", "kind").mapInArrow(cut, schema))


def _cut(schema: T.StructType):
    import hashlib

    names = schema.names[:-4]
    at = names.index("text")

    def one(text: str | None, marks: list[tuple[int, int]]):
        data = (text or "").encode()
        starts, ends, _ = words.bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        n = len(starts)
        spans: list[list[int]] = []
        for begin, end in sorted(marks):
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])
        kept, parts, place, word = [], [], 0, 0
        for begin, end in [*spans, [n, n]]:
            kept += [data[a:b] for a, b in zip(starts[word:begin].tolist(), ends[word:begin].tolist())]
            if begin < n:
                parts.append(data[place:starts[begin]])
                place = int(starts[end]) if end < n else len(data)
            word = end
        parts.append(data[place:])
        return (text if not spans else b"".join(parts).decode(), n, sum(b - a for a, b in spans),
                [{"begin": a, "end": b} for a, b in spans], hashlib.sha256(b" ".join(kept)).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        current, marks = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = part.column(5)
                out, kept = [], []
                texts = rows.field("text")
                for i, (doc, copy, kind, begin, end) in enumerate(zip(*(part.column(c).to_pylist() for c in range(5)))):
                    if (doc, copy) != current:
                        current, marks = (doc, copy), []
                    if kind == 0:
                        marks.append((begin, end))
                    else:
                        out.append(one(texts[i].as_py(), marks))
                        kept.append(i)
                columns = [rows.field(name).take(pa.array(kept, pa.int64())) for name in names]
                fresh = list(zip(*out)) or [[]] * 5
                columns[at] = pa.array(fresh[0], kinds.field(at).type)
                columns += [pa.array(fresh[c], kinds.field(len(names) + c - 1).type) for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    return run
