"""Exact Jaccard self-join of documents on word n-grams by token groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahaz.llm import words
from terrahaz.llm.components import components
from terrahaz.llm.frames import FILTER_BITS, bitmap, checkpointed, clear, flat, in_bitmap, slot, text_slices, total_bytes

SHINGLE = 3
PERCENT = 90
BUCKET_BYTES = 24_000_000
"""Signatures that one task sorts at a time."""
QUERIES = 256
"""Query documents of one task."""
GROUP = 64
"""Documents behind one token union."""
BITS = 2048
"""Positions of the sketches that stand for a set until it has to be compared."""
CELLS, SLABS = 1 << 20, 64
"""Counters of token frequencies (any hash order gives the right result, this one the fewest comparisons)."""
HUB = 2000
"""Documents compared with one leader in one task."""


def sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text and one 64-bit key of each set (0: empty)."""
    data, offsets = flat(texts)
    data = words.LOWER[data]
    starts, ends, first = words.bounds(data, offsets)
    hashed = words.hashes(data, starts, ends)
    at, runs = words.runs(hashed, first, shingle)
    cut = np.searchsorted(at, first)
    found, keys = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if a < b:
            own = np.sort(runs[a:b])
            if b - a > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
        elif first[i] < first[i + 1]:  # fewer words than a shingle: the whole sequence is the only one
            few = hashed[first[i]:first[i + 1]]
            own = words.runs(few, np.array([0, len(few)]), len(few))[1] ^ np.uint64(len(few))
        else:
            own = np.zeros(0, np.uint64)
        found.append(own)
        if len(own):
            both = np.array([words.mix(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(own)])
            both = words.mix(both + np.array([len(own), 1], np.uint64))
            keys[i] = int((both[:1] * words._RUN + both[1:])[0] >> np.uint64(1)) | 1
    return found, keys


def _signatures(own: np.ndarray, percent: int, cells: np.ndarray) -> np.ndarray:
    """The rarest tokens of a set, as many as any set similar enough must share one of.

    A similar set holds at least percent / 100 of the tokens. Tokens are ranked by the count of their cell,
    then by hash: the same order for all sets, with frequent passages at its end.
    """
    size = len(own) - -(-percent * len(own) // 100) + 1
    return own[np.lexsort((own, cells[(own & np.uint64(CELLS - 1)).astype(np.int64)]))[:size]]


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """n_shingles and node of each row beside its other columns; the text goes.

    Rows with a ``slab`` count tokens: of a part of the ``CELLS`` cells, the tokens one task has seen.
    """
    kept = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("slab", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        cells = np.zeros(CELLS, np.int64)
        for batch, texts in text_slices(batches):
            found, keys = sets(texts, shingle)
            tokens = np.concatenate(found) if found else np.zeros(0, np.uint64)
            cells += np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(s) for s in found], pa.int64()), pa.array(keys), pa.nulls(len(found), pa.int32()),
                 pa.nulls(len(found), pa.binary())], names=kinds.names)
        slabs = np.split(np.minimum(cells, 0xFFFF).astype("<u2"), SLABS)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(SLABS, kinds.field(f.name).type) for f in kept), pa.nulls(SLABS, pa.int64()), pa.nulls(SLABS, pa.int64()),
             pa.array(range(SLABS), pa.int32()), pa.array([x.tobytes() for x in slabs], pa.binary())], names=kinds.names)

    return docs.mapInArrow(run, schema)


def _cells(profiles: DataFrame) -> np.ndarray:
    """Counts of all cells; two bytes each, whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[slab] = total.get(slab, 0) + np.frombuffer(raw, "<u2").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFF).astype("<u2").tobytes() for x in total.values()], pa.binary())],
            names=["slab", "cells"])

    found = profiles.where("slab IS NOT NULL").select("slab", "cells").repartition(SLABS, "slab").mapInArrow(
        run, "slab int, cells binary").collect()
    cells = np.zeros((SLABS, CELLS // SLABS), np.uint16)
    for row in found:
        cells[row["slab"]] = np.frombuffer(row["cells"], "<u2")
    return cells.ravel()


def _grouped(docs: DataFrame, shingle: int, percent: int, cells: np.ndarray) -> DataFrame:
    """(signature, node, leader, comparable) of the signatures that several sets of similar sizes have.

    Signatures travel packed, many to a row, with 32 bits each beside their bucket: two that fall
    together bring sets to a comparison that fails. The leader of a signature is the set that shares most
    with others.
    """
    size = 2.5 * (100 - percent) / 100 * total_bytes(docs)  # of all signatures with their sets, about
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    buckets = max(1, -(-int(size) // BUCKET_BYTES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_slices(batches):
            found, keys = sets(texts, shingle)
            made, of, sizes = [], [], []
            for own, key in zip(found, keys.tolist()):
                if key and key not in seen:
                    seen.add(key)
                    made.append(_signatures(own, percent, shared.value))
                    of.append(key)
                    sizes.append(len(own))
            if made:
                mark = np.concatenate(made)
                owner = np.repeat(np.arange(len(of)), [len(m) for m in made])
                bucket = (mark % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((owner, bucket))
                owner, bucket, short = owner[order], bucket[order], (mark[order] >> np.uint64(32)).astype("<u4")
                # of each bucket: the nodes, how many signatures each has, and 32 bits of every signature
                run = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])))
                width = np.diff(np.append(run, len(owner))).astype("<u4")
                node, size = np.array(of, "<i8")[owner[run]], np.array(sizes, "<u4")[owner[run]]
                cut = np.flatnonzero(np.append(True, bucket[run][1:] != bucket[run][:-1]))
                ends = np.append(cut[1:], len(run))
                first = np.append(run, len(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[run[cut]]), *(pa.array([x[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()) for x in (node, size, width)),
                     pa.array([short[first[i]:first[j]].tobytes() for i, j in zip(cut, ends)], pa.binary())],
                    names=["bucket", "nodes", "sizes", "widths", "marks"])

    def groups(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        order = np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))
        rows = rows[order]
        return rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        # a group ends where the next larger set is too large to be similar
        mark, size = rows[:, 0], rows[:, 2]
        start = np.append(True, (mark[1:] != mark[:-1]) | (100 * size[:-1] < percent * size[1:]))
        number = np.cumsum(start) - 1
        count = np.bincount(number)
        several = count[number] > 1
        rows, number, count = rows[several], number[several], count[number[several]]
        names = ["signature", "node", "leader", "comparable"]
        if not len(rows):
            return pa.RecordBatch.from_arrays([*[pa.array([], pa.int64())] * 3, pa.array([], pa.bool_())], names=names)
        node, place = np.unique(rows[:, 1], return_inverse=True)
        weight = np.bincount(place, count)[place]
        order = np.lexsort((rows[:, 1], -weight, number))
        rows, number = rows[order], number[order]
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        head = np.repeat(first, np.diff(np.append(first, len(rows))))
        size, most = rows[:, 2], rows[head, 2]
        signature = words.mix(rows[:, 0].astype(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signature), pa.array(rows[:, 1]), pa.array(rows[head, 1]),
             pa.array(100 * np.minimum(size, most) >= percent * np.maximum(size, most))], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held, base = None, [], 0, 0
        for batch in batches:
            for bucket, nodes, sizes, widths, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current and parts:
                    yield emit(groups(parts))
                    parts, held, base = [], 0, 0
                current = bucket
                mark = np.frombuffer(marks, "<u4").astype(np.int64) | bucket << 32
                width = np.frombuffer(widths, "<u4")
                parts.append(np.stack([mark, np.repeat(np.frombuffer(nodes, "<i8"), width), np.repeat(np.frombuffer(sizes, "<u4"), width)], 1))
                held += len(parts[-1])
                if held > 2 * base + BUCKET_BYTES // 12:  # repeated rows go early
                    parts = [groups(parts)]
                    held = base = len(parts[0])
        if parts:
            yield emit(groups(parts))

    return (docs.mapInArrow(spread, "bucket int, nodes binary, sizes binary, widths binary, marks binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(gather, "signature long, node long, leader long, comparable boolean"))


def _wanted(docs: DataFrame, wanted: DataFrame, shingle: int, sketch: bool) -> DataFrame:
    """(node, tokens) or sketches of the wanted nodes: texts pass a bitmap of fixed size first, then a join.

    A sketch is (node, size, parity, presence): of ``BITS`` hashed positions those with an odd number of tokens, and
    those with any. Positions that differ in parity are at most as many as tokens that differ, and each
    position of a set that a union lacks stands for a token it lacks: both bounds are exact.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(wanted.select(F.pmod("node", F.lit(1 << FILTER_BITS)) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for _, texts in text_slices(batches):
            found, keys = sets(texts, shingle)
            maybe = (keys != 0) & in_bitmap(bits, keys % (1 << FILTER_BITS) + 1)
            kept = [i for i in np.flatnonzero(maybe).tolist() if keys[i] not in seen and not seen.add(keys[i])]
            if not sketch:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[kept]), pa.array([found[i].tobytes() for i in kept], pa.binary())], names=["node", "tokens"])
                continue
            counts = [np.bincount((found[i] >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) for i in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[kept]), pa.array([len(found[i]) for i in kept], pa.int64()),
                 pa.array([np.packbits(c & 1 == 1).tobytes() for c in counts], pa.binary()),
                 pa.array([np.packbits(c > 0).tobytes() for c in counts], pa.binary())], names=["node", "size", "parity", "presence"])

    schema = "node long, size long, parity binary, presence binary" if sketch else "node long, tokens binary"
    made = docs.mapInArrow(run, schema).join(wanted, "node", "left_semi")
    return made.groupBy("node").agg(*[F.min(c).alias(c) for c in made.columns[1:]])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _led(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (node, leader) that are similar enough; a crowded leader goes to several tasks."""
    lots = pairs.groupBy("leader").agg(F.expr(f"cast(ceil(count(*) / {HUB}) as int)").alias("lots"))
    members = pairs.join(lots, "leader").join(tokens, "node").select(
        "leader", F.expr("cast(pmod(xxhash64(node), lots) as int)").alias("lot"), F.lit(1).alias("kind"), "node", "tokens")
    heads = lots.join(tokens.withColumnRenamed("node", "leader"), "leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("kind"),
        F.col("leader").alias("node"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            left, right = [], []
            for leader, kind, node, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(4)):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    head = own.copy()
                elif _similar(own, head, percent):
                    left.append(node)
                    right.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = members.union(heads)
    return rows.repartition("leader", "lot").sortWithinPartitions("leader", "lot", "kind").mapInArrow(run, "a long, b long")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _near(apart: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``total`` tokens together that differ in at least ``apart`` may be similar."""
    return apart.astype(np.int64) * (100 + percent) <= (100 - percent) * total


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, leader) that their sketches allow to be similar."""
    heads = sketches.select(F.col("node").alias("leader"), F.col("size").alias("size_b"), F.col("parity").alias("parity_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = np.bitwise_count(_bits(batch.column(2)) ^ _bits(batch.column(4))).sum(1)
                near = _near(apart, batch.column(3).to_numpy() + batch.column(5).to_numpy(), percent)
                yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.join(sketches.select("node", "size", "parity"), "node").join(heads, "leader").select(
        "node", "leader", "parity", "size", "parity_b", "size_b").mapInArrow(run, "node long, leader long")


def _blocks(families: DataFrame) -> DataFrame:
    """(family, block, kind, node, root): the queries of a family in blocks (kind 0), each with all its documents (kind 1)."""
    blocks = families.where("asks").groupBy("family").agg(F.expr(f"cast(ceil(count(*) / {QUERIES}) as int)").alias("blocks"))
    asking = families.where("asks").join(blocks, "family").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    others = families.join(blocks, "family").select(
        "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "node", "root")
    return others.union(asking.select("family", "block", F.lit(0).alias("kind"), "node", "root"))


def _grouped_likely(families: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of ``families`` that have a partner in another group of it, as far as sketches can tell."""
    rows = _blocks(families).join(sketches, "node").select("family", "block", "kind", "root", "node", "size", "parity", "presence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, group = None, [], []

        def close():
            hit: set[int] = set()
            if queries and group:
                (root, node, size, odd, some), (root_b, node_b, size_b, odd_b, some_b) = (
                    (*(np.array([r[k] for r in rows]) for k in range(3)), *(np.frombuffer(b"".join(r[k] for r in rows), np.uint8).reshape(len(rows), -1)
                                                                              for k in (3, 4))) for rows in (queries, group))
                lacks = np.bitwise_count(some & ~np.bitwise_or.reduce(some_b)).sum(1)
                asks = np.flatnonzero(100 * (size - lacks) >= percent * size)  # the others cannot find enough in the union
                for i in asks.tolist():
                    near = _near(np.bitwise_count(odd[i] ^ odd_b).sum(1), size[i] + size_b, percent) & (root_b != root[i])
                    if near.any():
                        hit.add(int(node[i]))
                        hit.update(node_b[near].tolist())
            group.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0] if current else 0] * len(hit), pa.int64()), pa.array(list(hit), pa.int64())], names=["family", "node"])

        for batch in batches:
            for family, block, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (family, block) != current:
                    yield close()
                    current, queries = (family, block), []
                if kind == 0:
                    queries.append(row)
                    continue
                group.append(row)
                if len(group) >= GROUP:
                    yield close()
        yield close()

    found = rows.repartition("family", "block").sortWithinPartitions("family", "block", "kind", "root", "node").mapInArrow(
        run, "family long, node long").distinct()
    return families.join(found, ["family", "node"])


def _opened(families: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between the queries of a family and its other documents.

    ``families`` holds (family, node, root, asks). Each block of queries meets the
    family's documents in groups of similar ones: a query opens a group only
    when the union of its tokens covers enough of the query.
    """
    rows = _blocks(families).join(tokens, "node").select("family", "block", "kind", "root", "node", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, group = None, [], []
        linked: set[tuple[int, int]] = set()

        def close():
            found = []
            if queries and group:
                union = np.unique(np.concatenate([own for _, _, own in group]))
                least, most = min(len(g[2]) for g in group), max(len(g[2]) for g in group)
                for node, root, own in queries:
                    if 100 * len(own) < percent * least or percent * len(own) > 100 * most:
                        continue
                    at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                    if 100 * int((union[at] == own).sum()) < percent * len(own):
                        continue
                    for other, its, tokens in group:
                        if its != root and (node, its) not in linked and _similar(own, tokens, percent):
                            linked.add((node, its))
                            found.append((node, other))
            group.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for family, block, kind, root, node, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                if (family, block) != current:
                    yield close()
                    current, queries = (family, block), []
                    linked.clear()
                own = np.frombuffer(raw.as_buffer(), np.uint64).copy()
                if kind == 0:
                    queries.append((node, root, own))
                    continue
                group.append((node, root, own))
                if len(group) >= GROUP:
                    yield close()
        yield close()

    return rows.repartition("family", "block").sortWithinPartitions("family", "block", "kind", "root", "node").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their
    distinct shingles of ``shingle`` words (ASCII letters in lower case); a shorter text is
    one shingle, texts without words (empty, null) link with nothing. component_id is the
    smallest doc_id reachable by links. Equal sets are one node from the start.

    1. The rarest tokens of each set, one of which similar sets must share, bring documents together
       (see ``_signatures``; frequencies come from counters of fixed size); every document is compared with the leader of each
       signature, in lots, and linked ones form groups.
    2. Where a signature still joins several groups, the documents outside its
       largest group query that family: token unions decide which groups of 64 are
       opened, and the opened ones are compared exactly.

    Both steps ask sketches of 256 bytes first, whose bounds are exact; only documents that these leave over send their sets. Rows are never dropped
    or sampled; repeated doc_ids are rows of their own; a null doc_id takes part and never
    names a component unless it is alone. Other columns are left out, an
    empty table gives an empty result.
    """
    named = _named(docs.select("doc_id", "text"), shingle, percent)
    least = named.where("node <> 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def _named(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The columns of ``docs`` but text, n_shingles, node and root (the node that stands for the component)."""
    counted = checkpointed(_profiles(docs, shingle))
    cells = _cells(counted)
    profiles = checkpointed(counted.where("slab IS NULL").drop("slab", "cells"))
    del counted  # the counters of all tasks go before the next steps
    clear(docs.sparkSession)
    texts = docs.select("text")
    grouped = checkpointed(_grouped(texts, shingle, percent, cells))
    clear(docs.sparkSession)
    sketches = checkpointed(_wanted(texts, grouped.select("node").distinct(), shingle, sketch=True))
    pairs = grouped.where("node <> leader AND comparable").select("node", "leader").distinct()
    likely = checkpointed(_likely(pairs, sketches, percent))
    ends = likely.select("node").union(likely.select("leader")).distinct()
    tokens = checkpointed(_wanted(texts, ends, shingle, sketch=False))
    clear(docs.sparkSession)  # the sets were sent to be written; next they are sent to their leaders
    led = checkpointed(_led(likely, tokens, percent))
    del pairs, likely, ends, tokens
    clear(docs.sparkSession)
    roots = checkpointed(components(led))
    placed = grouped.select("signature", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("signature").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("signature")
    loose = placed.join(open_, "signature")
    sizes = loose.groupBy("signature", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("signature").agg(F.max(F.struct("n", "root")).alias("m")).select("signature", F.col("m.root").alias("family"))
    families = checkpointed(loose.join(main, "signature").select("family", "node", "root", (F.col("root") != F.col("family")).alias("asks")).distinct())
    families = checkpointed(_grouped_likely(families, sketches, percent))
    del grouped, sketches, roots, placed, open_, loose, sizes, main
    clear(docs.sparkSession)
    links = led.union(_opened(families, _wanted(texts, families.select("node").distinct(), shingle, sketch=False), percent))
    final = components(links)
    return profiles.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component (see ``similar_documents``): that of the smallest doc_id.

    Among rows of that doc_id the one of least row hash stays, of equal rows one. A null
    doc_id comes last. Texts without words are in no component and all stay. Only the
    rows that may go are joined; the others are passed on where they are read.
    """
    hashed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    named = _named(hashed.select("doc_id", "text", "__row"), shingle, percent).where("node <> 0")
    groups = named.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")).where("n > 1")
    inside = checkpointed(named.join(groups, "root").select(
        "doc_id", "__row", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__row") == F.col("first.__row"))).alias("first")))
    kept = inside.where("first").groupBy("doc_id", "__row").count().where("count > 1")
    gone = inside.where("NOT first").select("doc_id", "__row").distinct()
    several = not kept.isEmpty()
    if several:
        gone = gone.union(kept.select("doc_id", "__row"))
    gone = checkpointed(gone)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(slot("doc_id", "__row"))))
    placed = hashed.withColumn("__slot", slot("doc_id", "__row"))

    def sieve(inverse: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside = in_bitmap(shared.value, batch.column(batch.num_columns - 1).to_numpy())
                yield batch.filter(pa.array(inside != inverse))

        return placed.mapInArrow(run, placed.schema)

    right = gone.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    left = sieve(True).union(sieve(False).join(right, same, "left_anti"))
    if several:
        again = kept.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__hash"))
        left = left.union(sieve(False).join(again, same, "left_semi").dropDuplicates(["doc_id", "__row"]))
    return left.select(*docs.columns)
