"""Feature collections of any size as rows: one document spreads over as many tasks as its bytes need.

Spark's text reader cuts a document at closing braces, so its splits are plain byte ranges of any
store Spark can read. Where a split begins, nobody knows whether that is inside a string
and how deep; but each split can say what it would change in either case, and adding
that up split by split tells every split its true beginning. Then each cuts out its features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SIGN = np.zeros(256, np.int8)
_SIGN[[ord("{"), ord("[")]], _SIGN[[ord("}"), ord("]")]] = 1, -1
_QUOTE, _ESCAPE = ord('"'), ord("\\")
FEATURE_DEPTH = 3
"""Open brackets inside a feature: the collection, its list of features, the feature."""


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and signs of all brackets, whether an odd number of quotes lies before each, and the number of quotes.

    Escaped quotes do not count; ``data`` does not begin behind an escape.
    """
    quotes = np.flatnonzero(data == _QUOTE)
    suspect = quotes[(quotes > 0) & (data[quotes - 1] == _ESCAPE)] if len(quotes) else quotes
    if len(suspect):
        plain = np.flatnonzero(data != _ESCAPE)
        before = plain[np.maximum(np.searchsorted(plain, suspect) - 1, 0)]
        run = np.where(before < suspect, suspect - before - 1, suspect)
        quotes = np.setdiff1d(quotes, suspect[run % 2 == 1], assume_unique=True)
    places = np.flatnonzero(_SIGN[data])
    return places, _SIGN[data[places]].astype(np.int64), (np.searchsorted(quotes, places) & 1).astype(bool), len(quotes)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, np.ndarray]]:
    """(file and split, first row, bytes) of the rows of one split in a batch, each with the brace that ended it."""
    files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    values = batch.column(2)
    keys = list(zip(files, starts))
    a = 0
    while a < len(keys):
        b = a
        while b < len(keys) and keys[b] == keys[a]:
            b += 1
        text = "}".join(values.slice(a, b - a).to_pylist()) + "}"
        yield keys[a], a, np.frombuffer(text.encode(), np.uint8)
        a = b


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split changes: depth if it begins outside a string, depth if inside, whether quotes are odd."""
    key, outside, inside, odd = None, 0, 0, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "start": pa.array([key[1]], pa.int64()), "outside": pa.array([outside], pa.int64()),
                                           "inside": pa.array([inside], pa.int64()), "odd": pa.array([int(odd)], pa.int32())})

    for batch in batches:
        for found, _, data in _runs(batch):
            if found != key:
                if key is not None:
                    yield row()
                key, outside, inside, odd = found, 0, 0, False
            _, sign, behind, quotes = structure(data)
            outside += int(sign[behind == odd].sum())
            inside += int(sign[behind != odd].sum())
            odd ^= bool(quotes & 1)
    if key is not None:
        yield row()


class _Cutter:
    """Cuts the features out of the bytes of one split, given its true beginning."""

    def __init__(self, depth: int, in_string: bool):
        self.depth, self.in_string = depth, in_string
        self.open = [] if depth >= FEATURE_DEPTH else None
        self.kind = "middle"  # of the open piece, should the split end inside it

    def feed(self, data: np.ndarray) -> Iterator[tuple[str, str]]:
        places, sign, behind, quotes = structure(data)
        real = behind == self.in_string
        places, sign = places[real], sign[real]
        depth = self.depth + np.cumsum(sign)
        opens = places[(sign > 0) & (depth == FEATURE_DEPTH)]
        closes = places[(sign < 0) & (depth == FEATURE_DEPTH - 1)]
        raw = data.tobytes()
        if self.open is not None and len(closes):
            self.open.append(raw[:closes[0] + 1])
            yield ("whole" if self.kind == "begin" else "end"), b"".join(self.open).decode()
            closes, self.open = closes[1:], None
        elif self.open is not None:
            self.open.append(raw)
        for a, b in zip(opens.tolist(), closes.tolist()):
            yield "whole", raw[a:b + 1].decode()
        if len(opens) > len(closes):
            self.open, self.kind = [raw[opens[-1]:]], "begin"
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.in_string ^= bool(quotes & 1)

    def rest(self) -> Iterator[tuple[str, str]]:
        if self.open:
            yield self.kind, b"".join(self.open).decode()


def _cut(wanted: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter = None, None

        def rows(found: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            kept = [f for f in found if f[0] in wanted]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(kept)), pa.array([key[1]] * len(kept), pa.int64()), pa.array([k for k, _ in kept]),
                     pa.array([t for _, t in kept])], names=["file", "start", "kind", "feature"])

        for batch in batches:
            for found, at, data in _runs(batch):
                if found != key:
                    if cutter is not None:
                        yield from rows(cutter.rest())
                    key, cutter = found, _Cutter(batch.column(3)[at].as_py(), batch.column(4)[at].as_py())
                yield from rows(cutter.feed(data))
        if cutter is not None:
            yield from rows(cutter.rest())

    return run


_CUT = "file string, start long, kind string, feature string"


def read_features(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, feature) for every feature of the collections below ``paths``, as JSON texts.

    Files whose brackets or strings do not close are left out; what lies in a list of the collection but
    is no feature, too. The text is read three times, never shuffled: only the two
    pieces of features that lie over the border of splits meet again, by file. Per split one
    small row is broadcast, about a millionth of the text at Spark's default split size.
    """
    text = spark.read.option("lineSep", "}").text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    splits = text.mapInArrow(_lexed, "file string, start long, outside long, inside long, odd int")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    states = (
        splits.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
        .withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
        .withColumns({"depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "ends": F.sum("change").over(whole),
                      "odds": F.sum("odd").over(whole) % 2})
        # The text behind the last brace of a file is read as if one more followed.
        .filter("ends IN (0, -1) AND odds = 0").select("file", "start", "depth", "in_string"))
    known = text.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", "depth", "in_string")
    inner = known.mapInArrow(_cut({"whole"}), _CUT).select("file", "feature")
    pieces = known.mapInArrow(_cut({"begin", "middle", "end"}), _CUT)
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "begin")
    joined = (
        pieces.withColumn("number", F.sum((F.col("kind") == "begin").cast("long")).over(order))
        .groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("kind") == "begin").alias("later"), "feature"))).alias("p"))
        .select("file", F.array_join(F.transform("p", lambda p: p["feature"]), "").alias("feature")))
    return inner.unionByName(joined).filter(F.get_json_object("feature", "$.type") == "Feature")
