"""Small helpers shared by the text operators: Arrow batches in bounded slices, columns, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000
"""Text bytes worked on at once inside a task; a longer text is a slice of its own."""


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut to about ``SLICE_BYTES`` of text, each with its text column (nulls as '')."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > SLICE_BYTES:
                yield batch.slice(start, i - start), texts.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if len(sizes) > start:
            yield batch.slice(start), texts.slice(start)
    release()


def by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Sorted rows, number by number of their first column."""
    import numpy as np

    current, held = None, []
    for batch in batches:
        number = batch.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for i, j in zip(edge, edge[1:]):
            if j > i:
                if held and int(number[i]) != current:
                    yield current, held
                    held = []
                current = int(number[i])
                held.append(batch.slice(i, j - i))
    if held:
        yield current, held


def release() -> None:
    """Give freed memory back at the end of a task: the worker stays, beside those of other stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def flat(texts: pa.Array):
    """The bytes of a large_string array and the offsets of its rows in them."""
    import numpy as np

    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir``; a session without one gets a folder of its warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint(eager)


RELEASE_SECONDS = 1.2
"""Py4J tells the JVM once a second which objects Python has dropped; a collection before that finds them in use."""


def clear(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more, before the next large step.

    It does so by itself when the driver's memory is collected, which may be long after they are of no use.
    """
    import gc
    import time

    gc.collect()
    time.sleep(RELEASE_SECONDS)
    spark.sparkContext._jvm.System.gc()


FILTER_BITS = 23


def slot(*columns: str):
    """A place in a bitmap of ``2 ** FILTER_BITS`` bits (the bitmap functions count from 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS)) + 1


def bitmap(slots: DataFrame):
    """The slots in use, as packed bits of fixed size: a first sieve before an exact join, never the answer."""
    import numpy as np

    pieces = slots.toDF("p").groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for piece in pieces:
        low = (piece["b"] - 1) * 4096
        bits[low:low + 4096] = np.frombuffer(piece["bits"], np.uint8)
    return bits


def in_bitmap(bits, slots):
    """Whether each slot (from 1 on) is in use."""
    at = slots - 1
    return (bits[at >> 3] >> (at & 7).astype(bits.dtype)) & 1 == 1


ARROW_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most 8 MB where it has Spark's default of 64 MB (Python workers hold several)."""
    if spark.conf.get(ARROW_BATCHES, None) in (None, "67108864b", "64MB"):
        spark.conf.set(ARROW_BATCHES, "8m")
    return spark


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def crc_mod(doc_id, modulus: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder, or its warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
