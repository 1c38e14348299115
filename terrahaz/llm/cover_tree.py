"""Embedding near-duplicates: cover trees over blocks of vectors, traversed in pairs."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.llm import words
from terrahaz.llm.components import components
from terrahaz.llm.frames import by_number, checkpointed, clear

BLOCK = 4096
"""Vectors of one tree, and so of one side of a task."""
MAX_PIVOTS = 1024
"""Top nodes of the tree over all blocks; they alone reach the driver."""
RADII = (math.pi, math.pi / 4, math.pi / 8, math.pi / 16)
"""Covering radii of the levels (angles); each level's nodes are nodes of the next one, too."""
SLACK = 1e-9
GROUP = 32
"""Blocks of a partition, about, in a large table: a task compares those of two partitions, and has one partition in memory."""
SPANS = 1 << 20
"""Spanning links a task holds before it reduces them."""


def _single(df: DataFrame, embedding: str) -> bool:
    return df.select(F.col(embedding).alias("e")).schema["e"].dataType.simpleString() == "array<float>"


def _vectors(df: DataFrame, vec_id: str, embedding: str, raw: bool = True) -> DataFrame:
    """(vec_id, digest, raw): a digest of the vector of length one and components as given; null for a vector that links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            given = column.values.to_numpy(zero_copy_only=False)  # a null component is NaN
            begin = column.offsets.to_numpy()[:-1]
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            digests, bodies = [None] * batch.num_rows, [None] * batch.num_rows
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                x = given[begin[rows][:, None] + np.arange(size)]
                keep = np.isfinite(x).all(1) & (x != 0).any(1)
                x = np.ascontiguousarray(x[keep])
                for i, unit, body in zip(rows[keep].tolist(), _scaled(x.astype(np.float64)), x):
                    digests[i] = hashlib.blake2b(unit, digest_size=16).digest()
                    bodies[i] = body.tobytes() if raw else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), *([pa.array(bodies, pa.binary())] if raw else [])],
                names=["vec_id", "digest", "raw"][:2 + raw])

    kind = df.schema[vec_id].dataType.simpleString()
    components_ = F.col(embedding) if _single(df, embedding) else F.col(embedding).cast("array<double>")
    return df.select(F.col(vec_id).alias("vec_id"), components_.alias("e")).mapInArrow(
        run, f"vec_id {kind}, digest binary" + ", raw binary" * raw)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _unit(raw: bytes, n: int, kind: type) -> np.ndarray:
    """Vectors of length one as doubles, from the components of ``n`` as given."""
    return _scaled(np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64))


class Tree:
    """Nested levels over the rows of ``x``: of each level the centres, each row's node and the nodes' parents."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.centres = [np.zeros(1, np.int64)]
        self.node = [np.zeros(n, np.int64)]
        self.parent = [np.zeros(1, np.int64)]
        near = [np.empty((n, n), bool) for _ in RADII[1:]]
        for i in range(0, n, 512):
            cosine = x[i:i + 512] @ x.T
            for level, radius in enumerate(RADII[1:]):
                near[level][i:i + 512] = cosine >= math.cos(radius)
        for close in near:
            above = self.node[-1]
            node = np.full(n, -1, np.int64)
            centres, parents = [], []
            order = np.concatenate([self.centres[-1], np.setdiff1d(np.arange(n), self.centres[-1])])
            for i in order.tolist():
                if node[i] < 0:
                    inside = close[i] & (node < 0) & (above == above[i])
                    inside[i] = True
                    node[inside] = len(centres)
                    centres.append(i)
                    parents.append(int(above[i]))
            self.centres.append(np.array(centres))
            self.node.append(node)
            self.parent.append(np.array(parents))
        leaves = self.node[-1]
        self.order = np.argsort(leaves, kind="stable")
        self.cut = np.searchsorted(leaves[self.order], np.arange(len(self.centres[-1]) + 1))
        own = np.einsum("ij,ij->i", x, x[self.centres[-1][leaves]]).clip(-1, 1)
        self.radius = np.zeros(len(self.centres[-1]))
        np.maximum.at(self.radius, leaves, np.arccos(own))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "x"}

    def rows(self, leaf: int) -> np.ndarray:
        return self.order[self.cut[leaf]:self.cut[leaf + 1]]

    def children(self, level: int) -> list[np.ndarray]:
        order = np.argsort(self.parent[level + 1], kind="stable")
        return np.split(order, np.searchsorted(self.parent[level + 1][order], np.arange(1, len(self.centres[level]))))


def _leaf_pairs(a: Tree, b: Tree, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold a link; of one tree with itself each pair once.

    Level by level: a pair of nodes whose centres are further apart than both
    covering radii and the threshold cannot hold one, nor can anything below.
    """
    same, last = a is b, len(RADII) - 1
    alive = None  # mask over pairs of nodes of the level above
    for level in range(1, last + 1):
        reach = 2 * RADII[level] + theta
        ca, cb = a.centres[level], b.centres[level]
        blunt = reach > math.pi / 2 and level < last and 4 * len(ca) * len(cb) > len(a.x) * len(b.x)
        pa_, pb_ = a.parent[level], b.parent[level]
        if alive is None or not blunt:
            mask = np.zeros((len(ca), len(cb)), bool)
            bound = -1.1 if blunt or reach >= math.pi else math.cos(reach) - SLACK
            for i in range(0, len(ca), 512):
                rows = slice(i, min(len(ca), i + 512))
                allowed = np.ones((rows.stop - i, len(cb)), bool) if alive is None else alive[pa_[rows]][:, pb_]
                if same:
                    allowed &= np.arange(len(cb)) >= np.arange(i, rows.stop)[:, None] if level == last else True
                if bound < -1:
                    mask[rows] = allowed
                    continue
                columns = np.flatnonzero(allowed.any(0))
                if len(columns):
                    mask[rows.start:rows.stop, columns] = allowed[:, columns] & (
                        a.x[ca[rows]] @ b.x[cb[columns]].T >= bound)
            alive = mask
        else:
            alive = alive[pa_][:, pb_]
    return np.nonzero(alive)


def _traverse(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, threshold: float):
    """Link counts of the rows of both sides (weighted by copies) and links that span the components."""
    theta = math.acos(threshold)
    same = a is b
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    left, right = _leaf_pairs(a, b, theta)
    apart = np.arccos(np.einsum(
        "ij,ij->i", a.x[a.centres[-1][left]], b.x[b.centres[-1][right]]).clip(-1, 1)) if len(left) else np.zeros(0)
    wide = a.radius[left] + b.radius[right]
    keep = apart <= wide + theta + SLACK
    for i, j, sure in zip(left[keep].tolist(), right[keep].tolist(), (apart + wide + SLACK <= theta)[keep].tolist()):
        p, q = a.rows(i), b.rows(j)
        own = same and i == j
        if own and len(p) == 1:
            continue
        if sure or own and 2 * a.radius[i] + SLACK <= theta:  # all pairs link, none is looked at
            na[p] += wb[q].sum() - (wb[p] if own else 0)
            if not own:
                nb[q] += wa[p].sum()
            spans.append((p, np.full(len(p), q[0])))
            if not own:
                spans.append((np.full(len(q), p[0]), q))
            continue
        link = a.x[p] @ b.x[q].T >= threshold
        if own:
            np.fill_diagonal(link, False)
        na[p] += link @ wb[q]
        if not own:
            nb[q] += wa[p] @ link
        la, lb = np.arange(len(p)), np.full(len(q), len(p))
        while True:  # least row of p that each row is connected to by these links
            lb = np.minimum(lb, np.where(link, la[:, None], len(p)).min(0))
            new = np.minimum(la, np.where(link, lb[None], len(p)).min(1))
            if own:
                new = lb = np.minimum(new, lb)
            if (new == la).all():
                break
            la = new
        hit = lb < len(p)
        spans.append((p[lb[hit]], q[hit]))
        if not own:
            first = link.argmax(1)
            hit = link.any(1)
            spans.append((p[hit], q[first[hit]]))
    return na, nb, spans


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``df``: cosine links of at least ``threshold``.

    Equal vectors are one weighted row first. Pivots (top nodes of a cover tree
    over a sample of at most ``MAX_PIVOTS`` rows) deal the rest into blocks of
    about ``BLOCK`` rows; a crowded pivot has several blocks. Each block gets a
    cover tree, and pairs of blocks whose pivots and covering radii allow a
    link are walked, both trees at once: node pairs too far apart are
    dropped whole, leaf pairs close enough are counted whole, only the rest is
    compared row by row, in double precision. A task walks the pairs of two partitions, which it reads where the
    blocks were written, so blocks are not sent to their pairs; it returns one count and one spanning link per vector at most.

    Vectors that are null, empty, zero or hold null or non-finite components
    have 0 links and are their own component; vectors of different lengths never
    link. A repeated vec_id is a vector of its own on each row. Other columns
    are left out. An empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = df.sparkSession
    nodes = checkpointed(
        _vectors(df, vec_id, embedding).where("digest IS NOT NULL").groupBy("digest").agg(
            F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("raw")))
    clear(spark)
    kind = np.float32 if _single(df, embedding) else np.float64
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = [_linked(nodes.where(F.col("dim") == dim).drop("dim"), n, threshold, kind) for dim, n in sizes.items()]
    if parts:
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        found = checkpointed(found)
        links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
        stars = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
        placed = nodes.join(links, "node", "left").join(stars, "node", "left").withColumn(
            "root", F.coalesce("root", "node")).select("digest", "first_id", "copies", "root", "links")
        least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
        placed = placed.join(least, "root").select(
            "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    else:
        placed = nodes.select("digest", F.col("first_id").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    return _vectors(df, vec_id, embedding, raw=False).join(placed, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes, one a node at most."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = at[:len(left)], at[len(left):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        if (root[u] == root[v]).all():
            break
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        while (root != root[root]).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _linked(nodes: DataFrame, n: int, threshold: float, kind: type) -> DataFrame:
    """(node, other, links): spanning links have other, link counts have links."""
    spark, theta = nodes.sparkSession, math.acos(threshold)
    wanted = min(MAX_PIVOTS, max(1, n // BLOCK))
    rows = nodes.select("digest", "raw").orderBy("digest").limit(2 * wanted).collect()
    sample = _unit(b"".join(r["raw"] for r in rows), len(rows), kind)
    chosen = [0]
    far = sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):  # the next pivot is the row furthest from those before
        k = int(far.argmin())
        if far[k] >= math.cos(RADII[-1]):
            break
        chosen.append(k)
        far = np.maximum(far, sample @ sample[k])
    pivots = sample[chosen]

    def nearest(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cosine = _unit(b"".join(raw.to_pylist()), len(raw), kind) @ pivots.T
        best = cosine.argmax(1)
        return best, np.arccos(cosine[np.arange(len(best)), best].clip(-1, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, angle = nearest(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(angle)], names=["pivot", "angle"])

    tops = {r["pivot"]: (r["n"], r["r"]) for r in nodes.select("raw").mapInArrow(measure, "pivot int, angle double").groupBy("pivot").agg(
        F.count("*").alias("n"), F.max("angle").alias("r")).collect()}
    shares = np.array([-(-tops[p][0] // BLOCK) if p in tops else 0 for p in range(len(pivots))])
    radius = np.array([tops[p][1] if p in tops else 0.0 for p in range(len(pivots))])
    begin, blocks = np.cumsum(shares) - shares, int(shares.sum())
    close = np.arccos((pivots @ pivots.T).clip(-1, 1)) <= radius[:, None] + radius + theta + SLACK
    groups = max(-(-blocks // GROUP), min(blocks, math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, _ = nearest(batch.column(2))
                lot = words.mix(batch.column(0).to_numpy().astype(np.uint64) + np.uint64(1)) % shares[best].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((begin[best] + lot.astype(np.int64)).astype(np.int32)), pa.array(best.astype(np.int32)), *batch.columns],
                    names=["block", "pivot", "node", "copies", "raw"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in by_number(batches):
            pivot, node, copies, raw = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (1, 2, 3, 4))
            raw = b"".join(raw)
            tree = pickle.dumps(Tree(_unit(raw, len(node), kind)))
            body = pickle.dumps((node, copies, raw, len(tree), pa.compress(tree, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([pivot[0]], pa.int32()), pa.array([close[pivot[0]].tolist()], pa.list_(pa.bool_())),
                 pa.array([body], pa.binary())], names=["block", "pivot", "close", "body"])

    dealt = nodes.select("node", "copies", "raw").mapInArrow(deal, "block int, pivot int, node long, copies long, raw binary")
    packed = checkpointed(dealt.repartitionById(groups, F.col("block") % groups).sortWithinPartitions("block").mapInArrow(
        pack, "block int, pivot int, close array<boolean>, body binary"))
    clear(spark)
    pairs = packed.hint("shuffle_replicate_nl").join(
        packed.select(F.col("block").alias("block_b"), F.col("pivot").alias("pivot_b"), F.col("body").alias("body_b")),
        # either order of two blocks, in turn, so that tasks on both sides of the diagonal have their half
        F.expr("close[pivot_b] AND (block = block_b OR (block < block_b) = ((block + block_b) % 2 = 0))"))

    def opened(body: bytes) -> tuple[np.ndarray, np.ndarray, Tree]:
        node, copies, raw, size, tree = pickle.loads(body)
        tree = pickle.loads(pa.decompress(tree, size, "zstd", asbytes=True))
        tree.x = _unit(raw, len(node), kind)
        return node, copies, tree

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, spans, left, a, held = {}, [], None, None, {}
        for batch in batches:
            for i, body, j, body_b in zip(*batch.columns):
                i, j = i.as_py(), j.as_py()
                if i != left:
                    left, a = i, opened(body.as_py())
                if i != j and j not in held:  # of one partition, which comes again for each block of the other
                    held[j] = opened(body_b.as_py())
                b = a if i == j else held[j]
                na, nb, found = _traverse(a[2], b[2], a[1], b[1], threshold)
                for block, ids, more in ((i, a[0], na), (j, b[0], nb)):
                    counts[block] = (ids, counts[block][1] + more if block in counts else more)
                spans += [(a[0][p], b[0][q]) for p, q in found]
                if sum(len(p) for p, _ in spans) > SPANS:
                    spans = [_forest(*map(np.concatenate, zip(*spans)))]
        if spans:
            p, q = _forest(*map(np.concatenate, zip(*spans)))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(np.zeros(len(p), np.int64))], names=["node", "other", "links"])
        for ids, links in counts.values():
            ids, links = ids[links > 0], links[links > 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(links)], names=["node", "other", "links"])

    return pairs.select("block", "body", "block_b", "body_b").mapInArrow(walk, "node long, other long, links long")
