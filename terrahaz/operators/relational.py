"""Row selection per key.

One row per key is a ``row_number`` with a limit of one: Spark keeps at most one row
per key and task before the shuffle, so a key that holds a large share of the
table does not travel whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (sort expressions)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the greatest ``order`` tuple, NULLs counted as smallest (``DESC NULLS LAST``)."""
    return top_per(df, keys, [_col(c).desc_nulls_last() for c in order])


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the smallest ``order`` tuple, NULLs counted as smallest."""
    return top_per(df, keys, [_col(c).asc_nulls_first() for c in order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Drop duplicates on ``keys`` keeping the first row in ``order``."""
    return first_per(df, keys, order)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def insert_new(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key (NULLs equal) is absent from ``target``."""
    on = reduce(lambda a, b: a & b, [batch[k].eqNullSafe(target[k]) for k in keys])
    return batch.join(target.select(*keys), on, "left_anti")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN marks a missing cell; every operator here expects NULL instead."""
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def distinct_keys_of(df: DataFrame, map_col: str) -> DataFrame:
    """Distinct keys of a map column."""
    return df.select(F.explode(F.map_keys(map_col)).alias("key")).distinct()


def count_failed(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """Number of distinct ids that have at least one NULL result."""
    return df.agg(F.count_distinct(F.when(F.col(value).isNull(), F.col(id_col))).alias("failed_ids"))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when ``keys`` is not unique; only one violating row travels to the driver."""
    clash = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key {clash[0].asDict()}")
