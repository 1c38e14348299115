"""Scores of texts under a hierarchical Pitman-Yor model of words in context."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.llm import words
from terrahaz.llm.frames import by_number, checkpointed, clear, release, text_slices, total_bytes

CHUNK_BYTES = 10_000_000
"""Text whose words are looked up together."""
BUCKET_BYTES = 16_000_000
"""Text behind one bucket of the word table, about."""
BURN_IN, SAMPLES = 2, 2
"""Gibbs sweeps before the first sample, and sweeps whose predictive probabilities are averaged."""
LOT = 1 << 18
"""Customers whose draws are held at once."""
STRENGTH = 1.0
_END = np.uint64(0x5DEECE66D1234567)
_START = np.uint64(0x2020 << 48 | 0x0E66D1234567)
_WIDE, _NARROW = 1 << 16, 1 << 8
_SIZE = 2 * _WIDE + 2 * _NARROW + 2


def _seat(customers: np.ndarray, opening: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers left and were seated anew, one after the other.

    ``opening(dishes, tables)`` is the weight of a new table when a dish has so many; the k-th customer
    opens one with probability opening / (opening + k - 1 - discount * tables). Customers of a lot have their
    draws at once, then all are decided again until each one has met just the tables that those before left:
    the first customer's decision is final at once, the next one's after it, so what stays is the outcome of seating one by one.
    """
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        step = max(1, min(seated, LOT // len(live)))
        before = seated + np.arange(step)
        drawn = rng.random((len(live), step))
        drawn[before >= customers[live, None]] = 2  # nobody there
        opened, rows = np.zeros(drawn.shape, bool), np.arange(len(live))
        while len(rows):
            last, dishes = opened[rows], live[rows]
            met = tables[dishes, None] + (np.cumsum(last, 1) - last)
            free = opening(dishes, met)
            now = drawn[rows] * (free + before - discount * met) < free
            opened[rows] = now
            rows = rows[(now != last).any(1)]
        tables[live] += opened.sum(1)
        seated += step
        live = live[customers[live] > seated]
    return tables


def _served(customers: np.ndarray, tables: np.ndarray, restaurant: tuple[np.ndarray, np.ndarray], own: np.ndarray, discount: float,
            beyond: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Probabilities of dishes in the parent restaurant while their own customers there, one a table, come anew.

    Given are the parent's customers and tables of the dish and of the restaurant, the ``own`` customers that leave
    first, and the probability ``beyond`` it. A dish without customers left has no table, one with customers has one at least.
    """
    others, all_others = customers - own, restaurant[1] + (STRENGTH - own)
    least, else_ = np.maximum(tables, 1), (STRENGTH + discount * (restaurant[0] - tables)) * beyond
    slope = discount * (beyond - 1)

    def chance(dishes: np.ndarray, now: np.ndarray) -> np.ndarray:
        here = others[dishes, None] + now
        return (here + slope[dishes, None] * np.minimum(least[dishes, None], here) + else_[dishes, None]) / (all_others[dishes, None] + now)

    return chance


def _opening(tables: np.ndarray, own: np.ndarray, discount: float, chance: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Weights of a new table in restaurants of so many ``tables``, which the dishes' ``own`` ones have left."""
    others = STRENGTH + discount * (tables - own)
    return lambda dishes, now: (others[dishes, None] + discount * now) * chance(dishes, now)


class Bucket:
    """The restaurants of some words: each word in its contexts of two bytes, of one byte, and alone.

    All contexts of a word are here, so what a restaurant sends to its parent stays
    inside; only the totals of restaurants come from all buckets.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, counts: np.ndarray):
        self.context, self.counts = context.astype(np.int64), counts
        key, self.up = np.unique(word.astype(np.int64) << 8 | self.context & 0xFF, return_inverse=True)
        self.narrow, own = key & 0xFF, key >> 8
        self.top = np.unique(own, return_inverse=True)[1]

    def predict(self, seats, totals: np.ndarray, discounts, uniform: float):
        """Probabilities of a word alone and in its contexts, given seats and totals (none: even)."""
        n1, n0 = len(self.narrow), int(self.top.max()) + 1 if len(self.top) else 0
        if seats is None:
            return np.full(n0, uniform), np.full(n1, uniform), np.full(len(self.context), uniform)
        (t2, c1, t1, c0, t0), (d2, d1, d0) = seats, discounts
        t_wide, c_wide = totals[:_WIDE], totals[_WIDE:2 * _WIDE]
        t_narrow, c_narrow = totals[2 * _WIDE:2 * _WIDE + _NARROW], totals[2 * _WIDE + _NARROW:-2]
        p0 = (c0 - d0 * t0 + (STRENGTH + d0 * totals[-2]) * uniform) / (STRENGTH + totals[-1])
        p1 = (c1 - d1 * t1 + (STRENGTH + d1 * t_narrow[self.narrow]) * p0[self.top]) / (STRENGTH + c_narrow[self.narrow])
        p2 = (self.counts - d2 * t2 + (STRENGTH + d2 * t_wide[self.context]) * p1[self.up]) / (STRENGTH + c_wide[self.context])
        return p0, p1, p2

    def sweep(self, seats, totals: np.ndarray, discounts, uniform: float, rng: np.random.Generator):
        """Seats of one Gibbs sweep: from the widest contexts up, each dish given the state that the last one left of the others."""
        n1, n0 = len(self.narrow), int(self.top.max()) + 1 if len(self.top) else 0
        p0, _, _ = self.predict(seats, totals, discounts, uniform)
        t2, c1, t1, c0, t0 = seats or (np.zeros(n) for n in (len(self.counts), n1, n1, n0, n0))
        d2, d1, d0 = discounts
        t_narrow, c_narrow = totals[2 * _WIDE + self.narrow], totals[2 * _WIDE + _NARROW + self.narrow]
        parent = _served(c1[self.up], t1[self.up], (t_narrow[self.up], c_narrow[self.up]), t2, d1, p0[self.top][self.up])
        t2 = _seat(self.counts, _opening(totals[self.context], t2, d2, parent), d2, rng)
        c1 = np.bincount(self.up, t2, n1).astype(np.int64)
        parent = _served(c0[self.top], t0[self.top], (np.full(n1, totals[-2]), np.full(n1, totals[-1])), t1, d0, np.full(n1, uniform))
        t1 = _seat(c1, _opening(t_narrow, t1, d1, parent), d1, rng)
        c0 = np.bincount(self.top, t1, n0).astype(np.int64)
        t0 = _seat(c0, _opening(np.full(n0, totals[-2]), t0, d0, lambda dishes, now: uniform), d0, rng)
        return t2, c1, t1, c0, t0

    def totals(self, seats) -> np.ndarray:
        """Tables and customers of every restaurant, from these words."""
        t2, c1, t1, c0, t0 = seats
        return np.concatenate([
            np.bincount(self.context, t2, _WIDE), np.bincount(self.context, self.counts, _WIDE),
            np.bincount(self.narrow, t1, _NARROW), np.bincount(self.narrow, c1, _NARROW), [t0.sum(), c0.sum()]])

    def once_twice(self) -> list[int]:
        """How many dishes of each level have one and two customers when each dish has one table."""
        c1 = np.bincount(self.up, self.counts > 0, len(self.narrow))
        c0 = np.bincount(self.top, c1 > 0)
        return [int((c == k).sum()) for c in (self.counts, c1, c0) for k in (1, 2)]


class Words:
    """The restaurants of whole words before: each word after each of these, over a ``Bucket`` of the bytes they end in.

    Pairs are sorted by word and context; ``before`` are the contexts (their last bytes on top) and ``where`` says which one a
    pair has. A restaurant's dishes lie in all buckets, so its customers and tables come from outside. A pair that
    occurs once has one table whatever is drawn; seats are kept for the others.
    """

    def __init__(self, widths: np.ndarray, before: np.ndarray, where: np.ndarray, counts: np.ndarray):
        self.where, self.counts, self.shape = where, counts, len(before)
        key = np.repeat(np.arange(len(widths)), widths) << 16 | (before >> np.uint64(48)).astype(np.int64)[where]
        fresh = np.append(True, key[1:] != key[:-1])
        self.up = np.cumsum(fresh) - 1
        self.live = np.flatnonzero(counts > 1)
        self.bytes = Bucket(key[fresh] >> 16, key[fresh] & 0xFFFF, np.zeros(int(fresh.sum()), np.int64))

    def tables(self, seats) -> np.ndarray:
        """Tables of every pair."""
        if seats is None:
            return np.zeros(len(self.counts))
        tables = (self.counts > 0).astype(np.float64)
        tables[self.live] = seats[0]
        return tables

    def _sit(self, seats) -> None:
        self.bytes.counts = np.bincount(self.up, self.tables(seats), len(self.bytes.context)).astype(np.int64)

    def sweep(self, seats, totals: np.ndarray, opened: np.ndarray, discounts, uniform: float, rng: np.random.Generator):
        """Seats of one Gibbs sweep; ``opened`` are the tables of every context after the last one."""
        self._sit(seats)
        own, lower = (np.zeros(len(self.live)), None) if seats is None else (seats[0], seats[1:])
        discount, *rest = discounts
        _, p1, _ = self.bytes.predict(lower, totals, rest, uniform)
        up = self.up[self.live]
        context = self.bytes.context[up]
        t2 = np.zeros(len(up)) if lower is None else lower[0][up]
        parent = _served(self.bytes.counts[up], t2, (totals[context], totals[_WIDE + context]), own, rest[0], p1[self.bytes.up][up])
        own = _seat(self.counts[self.live], _opening(opened[self.where[self.live]], own, discount, parent), discount, rng)
        self._sit((own,))
        return own, *self.bytes.sweep(lower, totals, rest, uniform, rng)

    def totals(self, seats):
        """Tables and customers of the restaurants of bytes, and of those of the words before, from these words."""
        self._sit(seats)
        return self.bytes.totals(seats[1:]), np.bincount(self.where, self.tables(seats), self.shape), np.bincount(
            self.where, self.counts, self.shape)

    def predict(self, seats, totals: np.ndarray, opened: np.ndarray, customers: np.ndarray, discounts, uniform: float) -> np.ndarray:
        """Probabilities of the words after the words before."""
        self._sit(seats)
        discount, *rest = discounts
        beyond = self.bytes.predict(seats[1:], totals, rest, uniform)[2][self.up]
        weight = (STRENGTH + discount * opened)[self.where]
        return (self.counts - discount * self.tables(seats) + weight * beyond) / (STRENGTH + customers[self.where])

    def once_twice(self) -> list[int]:
        """How many dishes of each level have one and two customers when each dish has one table."""
        self.bytes.counts = np.bincount(self.up, self.counts > 0, len(self.bytes.context)).astype(np.int64)
        return [int((self.counts == k).sum()) for k in (1, 2)] + self.bytes.once_twice()


def _shut(*arrays: np.ndarray) -> bytes:
    """Arrays packed for the way, bytes of one place side by side."""
    raw = pickle.dumps([(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(body: bytes) -> list[np.ndarray]:
    raw = pickle.loads(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True))
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for t, b in raw]


def _packed(docs: DataFrame, learn: Column, chunks: int) -> DataFrame:
    """Texts compressed for the way, each with the number of its chunk."""
    rows = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), "text",
                       F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int").alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            raw = [t.as_buffer() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(0), batch.column(1), pa.array([b.size for b in raw], pa.int64()),
                 pa.array([pa.compress(b, "zstd", asbytes=True) for b in raw], pa.binary())],
                names=["chunk", "doc_id", "learn", "size", "packed"])

    return rows.mapInArrow(run, f"chunk int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, learn boolean, size long, packed binary")


class Chunk:
    """The tokens of some texts as pairs of a word and the word before, sorted and counted."""

    def __init__(self, sizes: list[int], packed: list[bytes], buckets: int):
        raw = [pa.decompress(p, s, "zstd", asbytes=True) if s else b"" for s, p in zip(sizes, packed)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = words.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        starts, ends, first = words.bounds(data, offsets)
        self.first = first + np.arange(len(first))  # each text has one token more: its end
        total = int(self.first[-1])
        hashed = np.full(total, _END, np.uint64)
        place = np.arange(len(starts)) + np.repeat(np.arange(len(sizes)), np.diff(first))
        hashed[place] = words.hashes(data, starts, ends)
        distinct, own = np.unique(hashed, return_inverse=True)
        last = data[ends - 1].astype(np.uint64)
        two = np.zeros(len(distinct) + 1, np.uint64)
        two[own[place]] = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0x20).astype(np.uint64) << np.uint64(8) | last
        before = two << np.uint64(48) | np.append(distinct, np.uint64(0)) >> np.uint64(16)
        before[-1] = _START
        by_before = np.argsort(before)
        rank = np.empty(len(before), np.int64)
        rank[by_before] = np.arange(len(before))
        context = np.full(total, rank[-1], np.int64)
        context[place + 1] = rank[own[place]]
        key = own * len(before) + context
        self.order = np.argsort(key)
        key = key[self.order]
        fresh = np.append(True, key[1:] != key[:-1]) if total else np.zeros(0, bool)
        self.edge = np.flatnonzero(fresh)
        self.pair = np.cumsum(fresh) - 1
        word, context = np.divmod(key[self.edge], len(before))
        self.hashed, self.before = distinct[word], before[by_before[context]]
        bucket = (self.hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.cut = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))

    def per_token(self, values: np.ndarray) -> np.ndarray:
        """Values of pairs, for each token in the order of the texts."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = values[self.pair]
        return out


def _widths(fresh: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin where ``fresh`` is true."""
    return np.diff(np.append(np.flatnonzero(fresh), len(fresh))).astype("<u4")


def _runs(values: np.ndarray) -> np.ndarray:
    return np.append(True, values[1:] != values[:-1])


_ROWS = "bucket int, part int, body binary"


def _row(bucket: int, part: int, body: bytes, *kind: int) -> pa.RecordBatch:
    numbers = [*kind, bucket, part]
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in numbers), pa.array([body], pa.binary())],
                                      names=["kind", "bucket", "part", "body"][-len(numbers) - 1:])


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows of one bucket together, by part."""
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "part")


def _bodies(held: list[pa.RecordBatch], *columns: int) -> list[tuple]:
    return [row for b in held for row in zip(*(b.column(c).to_pylist() for c in columns))]


def _table(packed: DataFrame, chunks: int, buckets: int, shards: int) -> DataFrame:
    """One row per bucket of words: its pairs with their training tokens, and which of them each chunk holds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in by_number(batches):
            learn, sizes, raw = zip(*_bodies(held, 1, 2, 3))
            chunk = Chunk(list(sizes), list(raw), buckets)
            token = np.repeat(np.array(learn), np.diff(chunk.first))[chunk.order]
            counts = np.add.reduceat(token.astype(np.int64), chunk.edge)
            for k, (a, b) in enumerate(zip(chunk.cut[:-1].tolist(), chunk.cut[1:].tolist())):
                if b > a:
                    fresh = _runs(chunk.hashed[a:b])
                    yield _row(k, number, _shut(chunk.hashed[a:b][fresh], _widths(fresh), chunk.before[a:b], counts[a:b].astype("<u4")))
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in by_number(batches):
            rows = [(chunk, *_opened(body)) for chunk, body in _bodies(held, 1, 2)]
            hashed = np.concatenate([np.repeat(r[1], r[2]) for r in rows])
            before = np.concatenate([r[3] for r in rows])
            counts = np.concatenate([r[4] for r in rows])
            chunks_, sizes = [r[0] for r in rows], [len(r[3]) for r in rows]
            del rows
            order = np.lexsort((before, hashed))
            h, c = hashed[order], before[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            member = np.empty(len(h), np.int64)
            member[order] = np.cumsum(fresh) - 1
            total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(fresh))
            widths = _widths(_runs(h[fresh]))
            distinct, where = np.unique(c[fresh], return_inverse=True)
            by_shard = np.argsort(distinct % np.uint64(shards), kind="stable")
            place = np.empty(len(distinct), np.int64)
            place[by_shard] = np.arange(len(distinct))
            distinct, where = distinct[by_shard], place[where]
            known = np.add.reduceat(total, np.cumsum(np.append(0, widths[:-1]).astype(np.int64)))
            cut = np.cumsum([0, *sizes]).tolist()
            steps = [np.diff(member[a:b], prepend=0).astype("<u4") for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in (
                    (number, pa.int32()), (_shut(widths, distinct, where.astype("<u4"), total), pa.binary()),
                    (_shut(np.array(chunks_, "<u4"), np.array(sizes, "<u4"), np.concatenate(steps)), pa.binary()),
                    (int(total.sum()), pa.int64()), (int((known > 0).sum()), pa.int64()),
                    (Words(widths, distinct, where, total).once_twice(), pa.list_(pa.int64())))],
                names=["bucket", "body", "members", "tokens", "types", "rare"])
        release()

    spread = packed.select("chunk", "learn", "size", "packed").repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(count, _ROWS)
    return _dealt(spread, buckets).mapInArrow(
        gather, "bucket int, body binary, members binary, tokens long, types long, rare array<bigint>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables and customers of the contexts of one shard over all buckets, for each of these in its own order."""
    for shard, held in by_number(batches):
        rows = [(part, *_opened(body)) for part, body in _bodies(held, 1, 2)]
        distinct, own = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        sums = [np.bincount(own, np.concatenate([r[k] for r in rows]), len(distinct)).astype("<i8")[own] for k in (2, 3)]
        cut = np.cumsum([0, *(len(r[1]) for r in rows)]).tolist()
        for r, a, b in zip(rows, cut, cut[1:]):
            yield _row(r[0], shard, _shut(*(x[a:b] for x in sums)))
    release()


def _arrived(held: list[pa.RecordBatch]):
    """What a bucket has before a step: its words, the contexts, the latest seats, the samples with their tables of contexts, and the latest sums."""
    found = dict(_bodies(held, 1, 2))
    widths, before, where, counts = _opened(found[-2])
    state = [x.astype(np.float64) for x in _opened(found[-1])] if -1 in found else []
    samples = [(tuple(state[k:k + 6]), state[k + 6]) for k in range(6, len(state), 7)]
    sums = [_opened(found[k]) for k in sorted(found) if k >= 0]
    opened, customers = [np.concatenate(x) for x in zip(*sums)] if sums else [np.zeros(len(before)), np.zeros(len(before))]
    seats = tuple(x.astype(np.int64) if k in (2, 4) else x for k, x in enumerate(state[:6])) or None
    return Words(widths, before, where.astype(np.int64), counts), widths, before, seats, samples, opened, customers


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    Tokens are the words of a text (ASCII letters in lower case) and one end. The rows on
    which ``learn`` is true are the training texts. The model is a hierarchy of Pitman-Yor
    restaurants over the words: a context is the word before (or the beginning of a text); contexts whose last two
    bytes are equal share a parent (two spaces for the beginning), those that end in the same byte a parent in turn, these share
    one restaurant without context, and its parent draws evenly from the words of the training texts and one
    more that stands for all others. Seating is sampled by Gibbs sweeps over dishes: the customers of a dish leave, with
    their tables and with the customers these are in the parent, and are seated anew one after the other given the others'
    state of the last sweep and their own tables so far; the predictive probabilities of ``SAMPLES`` sweeps after
    ``BURN_IN`` are averaged. Perplexity is 10 ** (-sum(score) / sum(n_tokens)).

    The table of words in contexts is spread over buckets by word, with all contexts of a word together: a
    sweep is one pass over it. What a bucket adds to the restaurant of a word before goes to the shard of that word, which sends
    the sums back to the buckets that hold it; restaurants of bytes, at most 65,793, go through the driver. Seeds
    make seats repeatable, so a lost task gives the same ones again. Distinct pairs of a chunk of texts travel packed
    and come back as probabilities. Null texts are empty (one end); repeated rows and doc_ids
    are texts of their own; without training texts all scores are 0. Other columns are left out.
    """
    size = total_bytes(docs)
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    shards = -(-buckets // 4)
    spark = docs.sparkSession
    packed = _packed(docs, learn, chunks)
    table = checkpointed(_table(packed, chunks, buckets, shards))
    clear(spark)
    rare = [F.coalesce(F.sum(F.col("rare")[k]), F.lit(0)).alias(f"r{k}") for k in range(8)]
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types")], *rare).first()
    tokens, types = sums["tokens"], sums["types"]
    discounts = tuple(min(0.95, max(0.05, sums[f"r{k}"] / max(1, sums[f"r{k}"] + 2 * sums[f"r{k + 1}"]))) for k in (0, 2, 4, 6))
    uniform = 1 / (types + 1)
    static = table.select("bucket", F.lit(-2).alias("part"), "body")
    given, after = static, [np.zeros(_SIZE)]
    for k in range(BURN_IN + SAMPLES):
        last = spark.sparkContext.broadcast(after[-1])

        def seat(batches: Iterator[pa.RecordBatch], k=k, last=last) -> Iterator[pa.RecordBatch]:
            total = np.zeros(_SIZE)
            for number, held in by_number(batches):
                own, _, before, seats, samples, opened, _ = _arrived(held)
                if k > BURN_IN:
                    samples.append((seats, opened))
                seats = own.sweep(seats, last.value, opened, discounts, uniform, np.random.default_rng([k, number]))
                level, tables, customers = own.totals(seats)
                total += level
                kept = [x for sample, t in samples for x in (*sample, t)]
                yield _row(number, -1, _shut(*(x.astype("<i8") for x in (*seats, *kept))), 0)
                cut = np.searchsorted(before % np.uint64(shards), np.arange(shards + 1).astype(np.uint64)).tolist()
                for shard, (a, b) in enumerate(zip(cut, cut[1:])):
                    if b > a:
                        yield _row(shard, number, _shut(before[a:b], tables[a:b].astype("<i8"), customers[a:b].astype("<i8")), 1)
            place = np.flatnonzero(total)
            yield _row(0, 0, _shut(place, total[place].astype(np.int64)), 2)
            release()

        found = checkpointed(_dealt(given, buckets).mapInArrow(seat, f"kind int, {_ROWS}"))

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(2).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _opened(body)], names=["place", "n"])

        parts = [found.where(F.col("kind") == kind).drop("kind") for kind in range(3)]
        sums = parts[2].mapInArrow(levels, "place long, n long").groupBy("place").agg(
            F.sum("n").alias("n")).toPandas()  # restaurants of bytes, of bounded number
        totals = np.zeros(_SIZE)
        totals[sums["place"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
        after.append(totals)
        given = static.union(parts[0]).union(_dealt(parts[1], shards).mapInArrow(_summed, _ROWS))
        del found, parts
        clear(spark)
    states = spark.sparkContext.broadcast(after[BURN_IN + 1:])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in by_number(batches):
            own, widths, _, seats, samples, opened, customers = _arrived(held)
            chance = sum(own.predict(s, totals, t, customers, discounts, uniform)
                         for (s, t), totals in zip([*samples, (seats, opened)], states.value))
            chance = np.log10(chance / SAMPLES).astype("<f4")
            word = np.repeat(np.arange(len(widths)), widths)
            alone = np.bincount(word, own.counts).astype("<i8")
            chunks_, sizes, steps = _opened(dict(_bodies(held, 1, 2))[-3])
            cut = np.cumsum([0, *sizes.tolist()]).tolist()
            for to, a, b in zip(chunks_.tolist(), cut, cut[1:]):
                member = np.cumsum(steps[a:b].astype(np.int64))
                mine = word[member]
                yield _row(to, number, _shut(chance[member], alone[mine[_runs(mine)]]))
        release()

    members = table.select("bucket", F.lit(-3).alias("part"), F.col("members").alias("body"))
    replies = checkpointed(_dealt(members.union(given), buckets).mapInArrow(reply, _ROWS))
    del table, static, members, given
    clear(spark)
    kind = docs.schema["doc_id"].dataType
    none = F.lit(None)
    rows = replies.select(F.col("bucket").alias("chunk"), F.col("part").alias("bucket"), none.cast(kind).alias("doc_id"),
                          none.cast("long").alias("size"), F.col("body").alias("packed")).union(
        packed.select("chunk", F.lit(-1).alias("bucket"), "doc_id", "size", "packed"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_number(batches):
            whole = pa.Table.from_batches(held)
            text = np.flatnonzero(whole.column("bucket").to_numpy() < 0)
            told = np.flatnonzero(whole.column("bucket").to_numpy() >= 0)
            texts, others = whole.take(pa.array(text)), whole.take(pa.array(told))
            if not len(text):
                continue
            chunk = Chunk(texts.column("size").to_pylist(), texts.column("packed").to_pylist(), buckets)
            chance, count = np.zeros(len(chunk.hashed)), np.zeros(len(chunk.hashed), np.int64)
            for number, p in zip(*(others.column(c).to_pylist() for c in ("bucket", "packed"))):
                own = slice(int(chunk.cut[number]), int(chunk.cut[number + 1]))
                chance[own], known = _opened(p)
                count[own] = np.repeat(known, _widths(_runs(chunk.hashed[own])))
            begin = chunk.first[:-1]
            base = np.log10(count + 1.0) - np.log10(tokens + types + 1.0)
            yield pa.RecordBatch.from_arrays([
                texts.column("doc_id").combine_chunks(), pa.array(np.diff(chunk.first)),
                pa.array(np.add.reduceat(chunk.per_token((count > 0).astype(np.int64)), begin)), pa.array(np.full(len(text), tokens)),
                pa.array(np.add.reduceat(chunk.per_token(base), begin)), pa.array(np.add.reduceat(chunk.per_token(chance), begin))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.repartition(chunks, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(
        final, f"doc_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
