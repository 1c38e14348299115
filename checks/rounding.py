from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def r6(df: DataFrame, columns: Iterable[str] | None = None, digits: int = 6) -> DataFrame:
    """Doubles rounded so that summation order does not show."""
    names = set(columns) if columns is not None else {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])
