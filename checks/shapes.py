"""Geometry columns for the flat domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo


def asset_geometry(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Points, rectangles and three-vertex lines from (kind, x0, y0, x1, y1)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    parts = (
        F.when(F.col(kind) == "ST_Point", geo.point_parts(x0, y0))
        .when(F.col(kind) == "ST_Polygon", geo.box_parts(x0, y0, x1, y1))
        .otherwise(geo.line_parts((x0, y0), (x1, y0), (x1, y1)))
    )
    return df.withColumns({
        "geom_type": F.col(kind), "parts": parts, "xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1,
    }).drop("kind", "x0", "y0", "x1", "y1", "w", "h")


def _boxes(df: DataFrame) -> DataFrame:
    return geo.with_box(df, *[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def zone_geometry(df: DataFrame) -> DataFrame:
    return _boxes(df)


def admin_geometry(df: DataFrame) -> DataFrame:
    return _boxes(df)
