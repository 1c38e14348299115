"""Merkle manifest of a table: postorder append logs of hash trees, proofs by closed-form places, folding of proofs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahaz.llm.ranks import ranked

FAN = 16
RISE = 3
"""Levels that one builder closes: it takes ``FAN ** RISE`` consecutive leaves, aligned to that number."""
BLOCK = FAN ** RISE
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: '-' for a null, else length in UTF-8 bytes, ':' and the value as text."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
            for v in values]
    return F.sha2(F.concat(*said), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def place(level: int, index: int, leaves: int) -> int:
    """Place of node ``index`` of ``level`` in the postorder log of a tree of ``leaves`` leaves.

    The node is written when its last leaf is there: before it lie all leaves
    up to that one, every inner node that they had completed, and the
    ``level`` nodes that end with the same leaf below it.
    """
    last = min((index + 1) * FAN ** level, leaves) - 1
    at, size = last + level, FAN
    while size <= last:
        at += last // size
        size *= FAN
    return at


class AppendLog:
    """Writes the nodes of one tree in the order of their completion: 32 bytes each, children before parents."""

    def __init__(self, levels: int):
        self.levels, self.nodes, self.open = levels, bytearray(), [[] for _ in range(levels)]

    def append(self, digest: bytes, level: int = 0) -> None:
        self.nodes += digest
        if level < self.levels:
            run = self.open[level]
            run.append(digest.hex())
            if len(run) == FAN:
                self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.append(sha256("".join(run).encode()).digest(), level + 1)

    def finish(self) -> bytes:
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return bytes(self.nodes)


def _leaves(n: int, block: int) -> int:
    return min(BLOCK, n - block * BLOCK)


def _levels(n: int) -> int:
    """Levels of a builder's log: all it can close where the tree goes on above it."""
    return RISE if n > BLOCK else height(n)


_SEGMENT = "tree string, block long, n long, log binary, keys array<long>, presented array<string>"
_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("log", pa.binary()),
                    ("keys", pa.list_(pa.int64())), ("presented", pa.list_(pa.string()))])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (tree, block, idx) to one row per builder."""
    tree, block, log, keys, presented, n = None, None, None, [], [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"tree": tree, "block": block, "n": n, "log": log.finish(),
                                            "keys": keys, "presented": presented}], schema=_ARROW)

    for batch in batches:
        for t, b, size, digest, key, shown in zip(*(c.to_pylist() for c in batch.columns)):
            if (t, b) != (tree, block):
                if log is not None:
                    yield done()
                tree, block, n, log, keys, presented = t, b, size, AppendLog(_levels(size)), [], []
            log.append(bytes.fromhex(digest))
            keys.append(key)
            presented.append(shown)
    if log is not None:
        yield done()


def _segments(leaves: DataFrame, folder: str) -> DataFrame:
    """Logs of all aligned builders over (tree, idx, n, digest, key, presented), written to ``folder``."""
    (leaves.withColumn("block", F.expr(f"idx div {BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
     .select("tree", "block", "n", "digest", "key", "presented").mapInArrow(_built, _SEGMENT).write.parquet(folder))
    return leaves.sparkSession.read.parquet(folder)


def _tops(segments: DataFrame) -> DataFrame:
    """The last node of each log, as leaf of the tree above it."""
    return segments.select(
        "tree", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
        F.lower(F.hex(F.substring("log", -32, 32))).alias("digest"), F.col("block").alias("key"),
        F.lit(None).cast("string").alias("presented"))


def _forest(leaves: DataFrame, folder: str) -> list[DataFrame]:
    """Segments of every tier of every tree, lowest first; the tiers follow from the largest tree alone."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    tiers = [_segments(leaves, f"{folder}/tier0")]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        tiers.append(_segments(_tops(tiers[-1]), f"{folder}/tier{len(tiers)}"))
    return tiers


def build(df: DataFrame, folder: str, fields: list[str], key: str = "doc_id", group: str = "source",
          presented: Column | None = None) -> None:
    """Write the manifest of ``df`` below ``folder``: a hash tree per ``group`` and one over their roots.

    A row's leaf is ``leaf`` of ``fields``. Leaves of a group ascend by ``key``
    (an integer; nulls first, equal keys by their leaf); groups ascend by UTF-8
    bytes, null first and apart from ''. Every 16 consecutive nodes become one
    until one remains, so a lone leaf is its tree's root. ``presented`` is the
    leaf of a copy to be checked, kept beside its row (null: the same leaf).
    Empty tables give an empty manifest, equal rows are leaves of their own,
    further columns are left out unless they are in ``fields``.

    A builder is one task's run of 4,096 aligned leaves: no group is ever in one
    task, and the rows of the next tier are fewer by 4,096. All tables are
    written by Spark's committer, so a lost executor costs its tasks only.
    """
    spark = df.sparkSession
    own = leaf(*(F.col(f) for f in fields))
    shown = F.lit(None).cast("string") if presented is None else presented
    df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).cast("long").alias("key"), own.alias("digest"), shown.alias("presented"),
    ).write.parquet(f"{folder}/leaves")
    tiers = _forest(ranked(spark.read.parquet(f"{folder}/leaves"), f"{folder}/ordered", "tree", ["key", "digest"]), f"{folder}/groups")
    roots = _tops(tiers[-1]).select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "key", "presented")
    ranked(roots, f"{folder}/roots", "tree", ["name"]).write.parquet(f"{folder}/names")
    _forest(spark.read.parquet(f"{folder}/names").drop("name"), f"{folder}/whole")


def _tiers(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The written tiers, lowest first: one whose largest tree has more than one builder has another above it."""
    tiers = []
    while True:
        tiers.append(spark.read.schema(_SEGMENT).parquet(f"{folder}/tier{len(tiers)}"))
        if (tiers[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return tiers


_PATH = "array<struct<left: string, right: string>>"
_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_SLICE = 512


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf of each log with its siblings, found by their places, and the path above the log."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            n, block, log = row["n"], row["block"], row["log"]
            m, levels = _leaves(n, block), _levels(n)
            runs = []
            for level in range(levels):
                nodes, size = [], -(-m // FAN ** level)
                for i in range(size):
                    at = 32 * place(level, i, m)
                    nodes.append(log[at:at + 32].hex())
                runs.append(["".join(nodes[i:i + FAN]) for i in range(0, size, FAN)])
            for low in range(0, m, _SLICE):
                out = []
                for i in range(low, min(m, low + _SLICE)):
                    path, j = [], i
                    for run in runs:
                        j, at = j // FAN, 64 * (j % FAN)
                        path.append({"left": run[j][:at], "right": run[j][at + 64:]})
                    at = 32 * place(0, i, m)
                    out.append((block * BLOCK + i, row["keys"][i], log[at:at + 32].hex(), row["presented"][i], path + row["path"]))
                idx, keys, digests, shown, paths = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(out)), pa.array(idx, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests),
                     pa.array(shown, pa.string()), pa.array(paths, _STEP), pa.array([row["subroot"]] * len(out), pa.string()),
                     pa.array([row["root"]] * len(out), pa.string())],
                    names=["tree", "idx", "key", "leaf", "presented", "path", "subroot", "root"])


_PROOF = f"tree string, idx long, key long, leaf string, presented string, path {_PATH}, subroot string, root string"


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """From ``above`` (tree, block, path, subroot, root of the highest tier) down to the leaves, tier by tier.

    Every join is on (tree, block), unique on both sides.
    """
    for tier in reversed(tiers):
        found = tier.join(above, ["tree", "block"]).select(
            "tree", "block", "n", "log", "keys", "presented", "path", "subroot", "root").mapInArrow(_opened, _PROOF)
        above = found.select("tree", F.col("idx").alias("block"), "path", "subroot", "root")
    return found


def proofs(spark: SparkSession, folder: str) -> DataFrame:
    """For every leaf of a manifest: group, idx, key, leaf, presented, path, subroot, root.

    ``path`` holds, level by level up to the root, the texts of the siblings to
    the left and to the right, '' where there are none.
    """
    whole = _tiers(spark, f"{folder}/whole")
    start = whole[-1].select(
        "tree", "block", F.expr(f"cast(array() as {_PATH})").alias("path"), F.lit("").alias("subroot"),
        F.lower(F.hex(F.substring("log", -32, 32))).alias("root"))
    names = spark.read.parquet(f"{folder}/names").select("idx", "name")
    top = _descend(whole, start).join(names, "idx").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("leaf").alias("subroot"), "root")
    found = _descend(_tiers(spark, f"{folder}/groups"), top)
    return found.select(F.expr("CASE WHEN tree <> '' THEN substring(tree, 2) END").alias("group"), *found.columns[1:])


def joined(path: Column) -> Column:
    """All siblings of a path as one text, left to right and level by level."""
    return F.aggregate(path, F.lit(""), lambda said, step: F.concat(said, step["left"], step["right"]))


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, own, lambda said, step: F.sha2(F.concat(step["left"], said, step["right"]), 256))
