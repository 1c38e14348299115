"""Regions, jobs, models and table catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions with their bounding box and state code.
REGIONS: tuple[tuple[str, float, float, float, float, str | None], ...] = (
    ("south_korea", 123.0, 32.6, 132.0, 39.3, None),
    ("washington", -126.1, 44.4, -114.0, 49.5, "WA"),
    ("california", -124.4, 32.5, -114.1, 42.0, "CA"),
    ("florida", -87.6, 24.5, -80.0, 31.0, "FL"),
    ("new_york", -79.8, 40.5, -71.8, 45.0, "NY"),
    ("oregon", -124.6, 42.0, -116.5, 46.3, "OR"),
    ("texas", -106.7, 25.8, -93.5, 36.5, "TX"),
    ("us_virgin_islands", -67.8, 17.1, -63.5, 19.1, "VI"),
)
REGION_SCHEMA = "region string, xmin double, ymin double, xmax double, ymax double, state string"


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGIONS), REGION_SCHEMA)


def region_of(lon: Column, lat: Column) -> Column:
    """First region whose box holds the point, from the fixed registry."""
    expr = F.lit(None).cast("string")
    for name, xmin, ymin, xmax, ymax, _ in reversed(REGIONS):
        inside = lon.between(xmin, xmax) & lat.between(ymin, ymax)
        expr = F.when(inside, F.lit(name)).otherwise(expr)
    return expr


def exposure_jobs(spark: SparkSession) -> DataFrame:
    """Exposure jobs: fire weather by decade, return levels and change factors by period."""
    # Scenarios per variable and the return periods that are loaded.
    rows = [("fwi", s, "mean", 20.0, "decade_month", None) for s in ("historical", "245", "585")]
    for rp in (100, 2, 500):
        for variable in ("pfe_mm_day", "pluvial_change_factor"):
            rows += [(variable, s, "mean", 20.0, "year_span_month", rp) for s in ("245", "585")]
    return spark.createDataFrame(
        rows, "variable string, scenario string, zonal_method string, area_threshold_km2 double, "
              "time_type string, return_period int")


def usable_models(models: DataFrame, scenario: str) -> DataFrame:
    """Registry rows marked usable whose scenario list holds the scenario."""
    return models.filter(F.col("use") & F.array_contains("scenarios", scenario))


def layer_tables(spark: SparkSession, category: str, database: str | None = None) -> DataFrame:
    """Catalogue tables whose name contains a category, with their columns."""
    found = [t.name for t in spark.catalog.listTables(database) if category in t.name]
    rows = [
        (name, [c.name for c in spark.catalog.listColumns(name, database)]) for name in sorted(found)
    ]
    return spark.createDataFrame(rows, "table_name string, columns array<string>")


def table_columns(spark: SparkSession, table: str) -> Sequence[str]:
    return [c.name for c in spark.catalog.listColumns(table)]
