"""Asset exposure to gridded hazards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.functions import values as V
from terrahaz.operators import spatial
from terrahaz.operators.grid import GridSpec, polygon_cells
from terrahaz.operators.relational import first_per


def line_aggregate(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sampled line vertices to one row per key: mean of the centre statistics,
    lowest of min and q1, highest of max and q3."""
    rules = {"mean": F.avg, "median": F.avg, "stddev": F.avg, "min": F.min, "q1": F.min,
             "max": F.max, "q3": F.max}
    return samples.groupBy(*keys).agg(*[rules[s](f"ensemble_{s}").alias(f"ensemble_{s}")
                                        for s in V.STATISTICS])


def _weighted_mean(v: str):
    return F.try_divide(F.sum(F.col(v) * F.col("weight")), F.sum(F.when(F.col(v).isNotNull(), F.col("weight"))))


# How sampled line vertices combine per statistic; others take the mean.
LINE_RULES = {"ensemble_min": F.min, "ensemble_q1": F.min, "ensemble_max": F.max, "ensemble_q3": F.max}


def zonal_by_kind(grid: DataFrame, assets: DataFrame, spec: GridSpec, time_keys: Sequence[str],
                  values: Sequence[str] = V.ENSEMBLE_COLUMNS, method: str = "mean",
                  tolerance: float = 0.0) -> DataFrame:
    """Exposure by geometry kind: points sample, lines sample and combine, polygons weigh.

    An asset inside one grid cell takes the values of that cell whatever its kind,
    so it needs the join only; that is nearly every asset, and its rows (assets x
    time keys, the bulk of the output) are not shuffled again. Assets over several
    cells become (id, cell, weight) lists, meet the grid in one join and are
    aggregated together.
    """
    if method not in ("mean", "max"):
        raise ValueError(f"unknown zonal method {method!r}")
    keyed = spec.keyed(grid).select("ix", "iy", *time_keys, *values)
    ix0, iy0 = spec.index(F.col("xmin"), F.col("ymin"))
    ix1, iy1 = spec.index(F.col("xmax"), F.col("ymax"))
    is_polygon = F.col("geom_type").isin(*geo.POLYGONS)
    has_area = (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))
    one_cell = (ix0 == ix1) & (iy0 == iy1) & (~is_polygon | (has_area & spec.covers(
        F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))))
    placed = assets.select("osm_id", *spatial.GEOMETRY_COLUMNS, one_cell.alias("_one"), ix0.alias("ix"), iy0.alias("iy"))
    single = placed.filter("_one").select("osm_id", "ix", "iy").join(keyed, ["ix", "iy"]).select(
        "osm_id", *time_keys, *values)
    spread = placed.filter(~F.col("_one")).drop("_one", "ix", "iy")
    vertices = spatial.line_vertices(spread, tolerance)
    vx, vy = spec.index(F.col("lon"), F.col("lat"))
    line_cells = vertices.groupBy("osm_id", vx.alias("ix"), vy.alias("iy")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")).withColumn("_line", F.lit(True))
    area_cells = polygon_cells(spread.filter(is_polygon), spec).withColumn("_line", F.lit(False))
    met = line_cells.unionByName(area_cells).join(keyed, ["ix", "iy"])
    whole = _weighted_mean if method == "mean" else F.max
    combined = met.groupBy("osm_id", "_line", *time_keys).agg(*[
        F.when(F.col("_line"), LINE_RULES.get(v, _weighted_mean)(v)).otherwise(whole(v)).alias(v) for v in values])
    return single.unionByName(combined.drop("_line"))


LINE_TOLERANCE = 0.0001
"""Degrees by which jobs simplify lines before they sample their vertices."""


@dataclass(frozen=True)
class ExposureSpec:
    """One exposure job."""

    variable: str
    scenario: str
    grid: GridSpec
    time_type: str = "decade_month"
    method: str = "mean"
    area_threshold_km2: float = 20.0
    return_period: int | None = None
    tolerance: float = LINE_TOLERANCE
    attrs: dict[str, str] = field(default_factory=dict)

    @property
    def time_keys(self) -> list[str]:
        return [k for k in V.TIME_KEYS[self.time_type] if k != "ssp"]


def _distinct_assets(assets: DataFrame) -> DataFrame:
    """One geometry per asset: with it a row per asset and time is unique, and no row of the result is shuffled for that."""
    return first_per(assets.select("osm_id", *spatial.GEOMETRY_COLUMNS), ["osm_id"], ["geom_type", *spatial.ENVELOPE])


def exposure(grid: DataFrame, assets: DataFrame, spec: ExposureSpec) -> DataFrame:
    """Exposure rows of one variable and scenario as a single lazy plan."""
    keys = spec.time_keys
    if spec.return_period is not None:
        grid = grid.filter(F.col("return_period") == spec.return_period)
    small = spatial.collapse_small(_distinct_assets(assets), spec.area_threshold_km2)
    rows = zonal_by_kind(
        grid.select("lon", "lat", *keys, *V.ENSEMBLE_COLUMNS), small, spec.grid, keys,
        method=spec.method, tolerance=spec.tolerance,
    )
    attrs = F.create_map(*[F.lit(x) for kv in sorted(spec.attrs.items()) for x in kv]) if spec.attrs \
        else F.create_map().cast("map<string,string>")
    rows = V.round_ensemble(rows.na.drop())
    rows = rows.withColumn("ssp", V.encode_ssp(F.lit(spec.scenario)))
    if spec.return_period is not None:
        rows = rows.withColumn("return_period", F.lit(spec.return_period))
    rows = rows.withColumn("metadata", V.metadata_json(attrs, {"zonal_method": spec.method}))
    return V.exposure_contract(rows, spec.time_type, spec.return_period is not None)


def burn_exposure(grid: DataFrame, assets: DataFrame, spec: GridSpec, method: str = "mean",
                  area_threshold_km2: float = 20.0) -> DataFrame:
    """Burn probability per asset: no time axis, no rounding, key osm_id."""
    small = spatial.collapse_small(_distinct_assets(assets), area_threshold_km2)
    return zonal_by_kind(grid, small, spec, [], ["burn_probability"], method, LINE_TOLERANCE).na.drop()
