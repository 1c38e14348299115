"""Writers: keyed tables, GeoJSON feature lines, gzip CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.functions.values import ENSEMBLE_COLUMNS
from terrahaz.operators.relational import assert_unique, insert_new
from terrahaz.plans.asset_query import features
from terrahaz.sources import versions

CSV_VALUE_ORDER = ("ensemble_mean", "ensemble_median", "ensemble_min", "ensemble_max", "ensemble_stddev",
                   "ensemble_q1", "ensemble_q3")
assert set(CSV_VALUE_ORDER) == set(ENSEMBLE_COLUMNS)


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ("ssp",),
                sort_by: Sequence[str] = ("osm_id",)) -> None:
    """Parquet table with a unique key.

    Rows are clustered by key range, so files carry tight min/max statistics and
    a hot partition value spreads over many files. The batch is written to a folder of its own and its key
    checked there; then a new version of the table takes it in place of the partitions it holds (see
    ``sources.versions``). A batch with a repeated key or a job that fails changes nothing. Read it with ``read_keyed``.
    """
    staged = df.repartitionByRange(*partition_by, *sort_by).sortWithinPartitions(*partition_by, *sort_by)
    versions.commit(staged, path, partition_by, lambda batch: assert_unique(batch, keys))


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table of ``write_keyed``, as it is now or was at a version."""
    return versions.read(spark, path, version)


def append_new(batch: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append rows whose key the table does not hold yet."""
    spark = batch.sparkSession
    try:
        target = spark.read.parquet(path)
    except Exception as error:  # first load
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        target = spark.createDataFrame([], batch.schema)
    insert_new(target, batch, keys).write.mode("append").partitionBy(*partition_by).parquet(path)


def write_features(rows: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features; every task writes its own file."""
    features(rows).select("feature").write.mode("overwrite").text(path, compression="gzip")


def csv_columns(columns: Sequence[str]) -> list[str]:
    """Core, geometry text, time, statistics (always present), then the rest by name."""
    core = ["osm_id", "osm_type"] + (["osm_subtype"] if "osm_subtype" in columns else [])
    fixed = [*core, "geometry_wkt", "month", "decade", "ssp", *CSV_VALUE_ORDER]
    rest = sorted(c for c in columns if c not in fixed and c not in ("geom_type", "parts"))
    return fixed + rest


def csv_table(rows: DataFrame) -> DataFrame:
    if {"geom_type", "parts"} <= set(rows.columns):
        rows = rows.withColumn("geometry_wkt", geo.to_wkt())
    complex_types = {f.name for f in rows.schema.fields
                     if f.dataType.typeName() in ("array", "map", "struct") and f.name not in ("parts",)}
    return rows.select(*[
        (F.to_json(c) if c in complex_types else F.col(c) if c in rows.columns else F.lit(None)
         ).cast("string").alias(c)
        for c in csv_columns(rows.columns)
    ])


def write_csv(rows: DataFrame, path: str) -> None:
    csv_table(rows).write.mode("overwrite").csv(path, header=True, compression="gzip", emptyValue="", nullValue="")


SLICE = ("variable", "indicator", "model", "scenario", "member", "year")


def write_grid(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Grid table, one folder per slice, cells in order inside each file.

    A slice is every column of ``SLICE`` that ``df`` has; the year comes from
    ``month_start`` or ``date`` where there is no such column. Only slices in ``df`` are
    replaced: other models, members and years of a variable stay.
    """
    if partition_by is None:
        day = next((c for c in ("month_start", "date") if c in df.columns), None)
        if "year" not in df.columns and day:
            df = df.withColumn("year", F.year(day))
        partition_by = [c for c in SLICE if c in df.columns]
    df.repartitionByRange(*partition_by, "lat", "lon").sortWithinPartitions(*partition_by, "lat", "lon").write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
