"""Packing documents into sequences of bounded length by best-two-fit over the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrahaz.llm.encoder import load
from terrahaz.llm.frames import flat, text_slices


def _cut(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of rows with ``counts`` ids: all of ``size`` but perhaps the first."""
    many = np.maximum(1, -(-counts // size))
    row = np.repeat(np.arange(len(counts)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    first = counts - (many - 1) * size
    start = np.where(number == 0, 0, first[row] + (number - 1) * size)
    return row, number, start, np.where(number == 0, first[row], size)


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many of the same length came before each; ``seen`` counts on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    place = np.arange(len(ordered))
    first = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
    out = np.empty(len(lengths), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0)) + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def write_pieces(df: DataFrame, folder: str, path: str, end_id: int, size: int = 2048, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, cut what is longer than ``size`` and write the pieces to ``folder``.

    Rows: doc_id, piece (from 0), start (ids before it), length, ids (little-endian unsigned 32-bit), and what
    ``assign`` needs: part (the task that wrote it) and at (pieces of this length that the task wrote before).
    Null texts are empty, repeated and null doc_ids are documents of their own, other columns are left
    out. No shuffle; Spark's committer keeps one attempt of each task.
    """
    kind = df.schema[doc_id].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seen = TaskContext.get().partitionId(), load(path), np.zeros(size + 1, np.int64)
        for batch, texts in text_slices(batches, "text"):
            ids, counts = encode.flat(*flat(texts))
            until = np.cumsum(counts)
            ids = np.insert(ids, until, end_id).astype("<u4")
            counts = counts + 1
            row, number, start, length = _cut(counts, size)
            begin = (np.cumsum(counts) - counts)[row] + start
            packed = ids.tobytes()
            held = [packed[a:b] for a, b in zip((begin * 4).tolist(), ((begin + length) * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)).cast(arrow), pa.array(number, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(held, pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(_numbered(length, seen))],
                names=["doc_id", "piece", "start", "length", "ids", "part", "at"])

    (df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
     .mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary, part int, at long")
     .write.parquet(folder))


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Sequences for ``counts[length]`` pieces of each length: (how many alike, lengths from the start on).

    A sequence takes the longest piece left and, again and again, the longest that still
    fits. While a gap remains, its smallest piece goes out if two pieces left over fill more of
    the gap it leaves, the fullest pair first. Sequences with the same lengths are
    made at once, as often as the pieces allow, which is what making them one by one gives;
    each time some length runs short of what a sequence takes, so there are at
    most about size * ln(size) kinds, whatever the number of pieces.
    """
    left, size, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    lengths = np.arange(size + 1)
    fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest piece left of at most this length
    while fits[size]:
        taken: list[int] = []
        gap = size

        def move(length: int, by: int) -> None:
            before = left[length]
            left[length] += by
            if (before > 0) != (left[length] > 0):
                fits[:] = np.maximum.accumulate(np.where(left > 0, lengths, 0))

        while fits[gap]:
            taken.append(int(fits[gap]))
            gap -= taken[-1]
            move(taken[-1], -1)
        while gap and taken:
            least = taken[-1]
            room = least + gap
            one = np.flatnonzero(left[:room] > 0)
            two = fits[np.minimum(one, room - one)]
            short = (two == one) & (left[one] < 2)
            two = np.where(short, fits[np.maximum(one - 1, 0)], two)
            total = np.where(two > 0, one + two, 0)
            if not len(total) or total.max() <= least:
                break
            k = int(total.argmax())
            taken.pop()
            for length in (int(one[k]), int(two[k])):
                taken.append(length)
                move(length, -1)
            move(least, 1)
            gap = room - int(total[k])
            taken.sort(reverse=True)
        kinds, needs = np.unique(taken, return_counts=True)
        more = int((left[kinds] // needs).min())
        for length, need in zip(kinds.tolist(), needs.tolist()):
            if more:
                move(length, -need * more)
        out.append((more + 1, taken))
    return out


def _places(kinds: list[tuple[int, list[int]]]) -> np.ndarray:
    """Per length the pieces of each kind of sequence: length, first piece, first sequence, pieces a sequence, offset."""
    rows, used, first = [], {}, 0
    for many, taken in kinds:
        offset = 0
        for length in dict.fromkeys(taken):
            need = taken.count(length)
            rows.append((length, used.get(length, 0), first, need, offset))
            used[length] = used.get(length, 0) + need * many
            offset += need * length
        first += many
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def assign(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Written ``pieces`` (part, at, length and any other columns) with sequence_id and offset instead of part and at.

    Only the histogram, ``size`` numbers, comes to the driver, and only the kinds of sequences, bounded by ``size``
    as well, go to the tasks. A piece's place among those of its length is found from the counts
    of the tasks before its own; no length is ever in one task.
    """
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    table = _places(best_two_fit(counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    kept = [c for c in pieces.columns if c not in ("part", "at")]
    numbered = pieces.join(shifts, ["part", "length"]).select(*kept, (F.col("at") + F.col("shift")).alias("number"))
    span = int(counts.max()) + 1
    keys = table[:, 0] * span + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.num_columns - 1).to_numpy()
            row = table[np.searchsorted(keys, length * span + number, "right") - 1]
            inside = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 2] + inside // row[:, 3]), pa.array(row[:, 4] + inside % row[:, 3] * length)],
                names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.mapInArrow(run, schema + ", sequence_id long, offset long")


def sequences(assigned: DataFrame) -> DataFrame:
    """The packed rows: sequence_id, length, ids (little-endian unsigned 32-bit), doc_lengths in their order.

    ``assigned`` still has ids. A row is at most one sequence, so no group is unbounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([sum(map(len, parts)) // 4], pa.int64()), pa.array([b"".join(parts)], pa.binary()),
                 pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64()))], names=["sequence_id", "length", "ids", "doc_lengths"])

        for batch in batches:
            for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if parts and sequence != now:
                    yield done()
                    parts = []
                now = sequence
                parts.append(ids)
        if parts:
            yield done()

    return (assigned.select("sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
            .select("sequence_id", "ids").mapInArrow(run, "sequence_id long, length long, ids binary, doc_lengths array<long>"))
