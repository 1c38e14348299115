"""Composed jobs: flood load, grid jobs and the regional analyses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.functions.values import lit, unwrap_lon
from terrahaz.operators import spatial
from terrahaz.operators.exposure import line_aggregate
from terrahaz.operators.grid import (
    GridSpec, coarsen_max, positive_only, sample_points, within, zonal_pivot,
)
from terrahaz.operators.relational import insert_new, keep_first
from terrahaz.sources.files import event_rows

ZONE_KEY = ("dfirm_id", "fld_ar_id", "version_id", "flood_zone", "flood_zone_subtype", "is_sfha",
            "static_bfe", "flood_depth", "lomr_effective_date")


def load_zones(raw: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """New flood-zone rows: complete, first per nine-column key, absent from the target."""
    usable = raw.na.drop(subset=["fld_ar_id"])
    if "parts" in raw.columns:
        usable = usable.filter(F.col("parts").isNotNull())
    fresh = keep_first(usable, ZONE_KEY, ["source_url"])
    return fresh if target is None else insert_new(target, fresh, ZONE_KEY)


def burn_grid(raster: DataFrame, res: float = 500.0) -> DataFrame:
    """Burn-probability raster to lon/lat cells: block maximum, 0..360 longitudes, positive only.

    ``raster``: x, y (projected metres), lon, lat of the pixel, burn_probability.
    A coarse cell lies in the middle of its pixels, so the result is regular where the raster is.
    """
    block = [F.floor(F.col("x") / lit(res)).alias("_bx"), F.floor(F.col("y") / lit(res)).alias("_by")]
    best = raster.groupBy(*block).agg(
        F.max("burn_probability").alias("_p"), *[((F.min(c) + F.max(c)) / lit(2)).alias(c) for c in ("lon", "lat")])
    return best.select(
        unwrap_lon(F.col("lon")).alias("lon"), "lat", positive_only(F.col("_p")).alias("burn_probability"),
    ).filter(F.col("burn_probability").isNotNull())


def future_burn_grid(burn: DataFrame, fwi_now: DataFrame, fwi_future: DataFrame) -> DataFrame:
    """Burn probability per cell and fire-season month after the relative fire-weather change.

    ``burn``: lat, lon, burn_probability; the two others: lat, lon, month, fwi.
    """
    from terrahaz.operators.climate import future_burn_relative
    from terrahaz.operators.grid import fire_season

    now = fire_season(fwi_now).select("lat", "lon", "month", F.col("fwi").alias("_f0"))
    later = fire_season(fwi_future).select("lat", "lon", "month", F.col("fwi").alias("_f1"))
    return now.join(later, ["lat", "lon", "month"]).join(burn, ["lat", "lon"]).select(
        "lat", "lon", "month",
        future_burn_relative(F.col("burn_probability"), F.col("_f0"), F.col("_f1")).alias("burn_probability"))


# ------------------------------------------------------------- utility jobs


def utility_fire_metrics(
    areas: DataFrame, fires: DataFrame, severity: DataFrame, fire_weather: DataFrame,
    severity_spec: GridSpec, weather_spec: GridSpec, year: int, state: str, tile_deg: float = 0.5,
) -> DataFrame:
    """Fires of a year met by utility service areas, with severity and ignition-day fire weather.

    ``fires``: event_id, incident_type, ignition_date and geometry; ``severity``: lon, lat, severity;
    ``fire_weather``: lon, lat, date, fwi; ``areas``: utility_id and geometry.
    """
    chosen = event_rows(fires, "Wildfire", year, state)
    chosen = keep_first(chosen, ["event_id"], ["ignition_date"])
    masked = severity.withColumn("severity", within(F.col("severity"), 2, 4))
    sev = zonal_pivot(masked, chosen, severity_spec, "severity", id_col="event_id")
    days = fire_weather.withColumn("date", F.col("date").cast("date"))
    weather = zonal_pivot(
        days.join(chosen.select(F.col("ignition_date").alias("date")).distinct(), "date", "left_semi"),
        chosen, weather_spec, "fwi", ["date"], "event_id",
    ).withColumnRenamed("date", "ignition_date")
    enriched = chosen.join(weather, ["event_id", "ignition_date"], "left").join(sev, "event_id", "left")
    hits = spatial.intersecting(
        areas.select("utility_id", *spatial.GEOMETRY_COLUMNS),
        chosen.select("event_id", *spatial.GEOMETRY_COLUMNS), tile_deg).select("utility_id", "event_id")
    return (
        hits.join(enriched.select("event_id", "ignition_date", "fwi_mean", "fwi_max", "severity_mean", "severity_max"),
                  "event_id")
        .filter(F.col("severity_mean").isNotNull())
        .orderBy("utility_id", "ignition_date", "event_id")
    )


def weighted_income(income: DataFrame, shares: DataFrame) -> DataFrame:
    """Income per return by (utility, year), zip codes weighted by their covered share.

    ``income``: year, zipcode, returns, agi (thousands); ``shares``: zipcode, utility_id, overlap_share.
    """
    return (
        income.join(shares, "zipcode", "left")
        .filter(F.col("utility_id").isNotNull())
        .groupBy("utility_id", "year")
        .agg(F.try_divide(F.sum(F.col("agi") * lit(1000) * F.col("overlap_share")),
                          F.sum(F.col("returns") * F.col("overlap_share"))).alias("income_per_return"))
    )


def utility_income(income: DataFrame, zips: DataFrame, utilities: DataFrame,
                   box: tuple[float, float, float, float], tile_deg: float = 0.5) -> DataFrame:
    """Zip areas in the region box, their share per utility, and the weighted income."""
    inside = spatial.in_boxes(zips, [box])
    shares = spatial.overlap_shares(
        inside.select("zipcode", *spatial.GEOMETRY_COLUMNS),
        utilities.select("utility_id", *spatial.GEOMETRY_COLUMNS), tile_deg)
    return weighted_income(income, shares.select("zipcode", "utility_id", "overlap_share"))


# ------------------------------------------------------------ facility jobs


def left_chain(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Successive left joins that share the leading key."""
    return reduce(lambda df, p: df.join(p[0], list(p[1]), "left"), parts, base)


RADII_MILES = (5, 10, 25)


def max_within(points: DataFrame, cells: DataFrame, miles: Sequence[float], value: str, id_col: str,
               keys: Sequence[str] = ()) -> DataFrame:
    """Maximum cell value inside each radius per point (and key), 0 where a radius holds none.

    The values of a place, one per key, ride along as one array, so a pair of a point and a place is
    found and measured once, not once per key.
    """
    series = cells.groupBy("lon", "lat", *keys).agg(F.max(value).alias(value)).groupBy("lon", "lat").agg(
        F.collect_list(F.struct(*keys, value)).alias("_series"))
    pairs = spatial.within_radius(points.select(id_col, "lon", "lat"), series, max(miles))
    each = pairs.select(id_col, "distance_miles", F.explode("_series").alias("_v")).select(id_col, "distance_miles", "_v.*")
    return each.groupBy(id_col, *keys).agg(*[
        F.coalesce(F.max(F.when(F.col("distance_miles") <= m, F.col(value))), lit(0)).alias(f"{value}_max_{m:g}mi")
        for m in miles])


def facility_exposure(
    facilities: DataFrame, burn: DataFrame, spec: GridSpec, stations: DataFrame, substations: DataFrame,
    future_burn: DataFrame, miles: Sequence[float] = RADII_MILES,
) -> DataFrame:
    """Facilities with point burn probability, nearest station and substation, counts and radius maxima.

    ``future_burn``: lon, lat, month, burn_probability.
    """
    base = facilities.select("osm_id", "lon", "lat")
    at_point = sample_points(burn, base, spec).select(
        "osm_id", F.coalesce("burn_probability", lit(0)).alias("burn_probability"))
    near_station = spatial.nearest(base, stations, "osm_id", "station_id").withColumnsRenamed(
        {"distance_miles": "station_miles"})
    near_sub = spatial.nearest(base, substations, "osm_id", "substation_id").withColumnsRenamed(
        {"distance_miles": "substation_miles"})
    counts = spatial.counts_within(base, substations, miles, "osm_id")
    around = max_within(base, future_burn, miles, "burn_probability", "osm_id", ["month"])
    joined = left_chain(base, [
        (near_station, ["osm_id"]), (near_sub, ["osm_id"]), (counts, ["osm_id"]),
        (at_point, ["osm_id"]), (around, ["osm_id"]),
    ])
    return joined.na.fill(0.0, ["burn_probability", *[f"burn_probability_max_{m:g}mi" for m in miles]])


def line_asset_report(
    lines: DataFrame, center: tuple[float, float], miles: float, burn: DataFrame, burn_spec: GridSpec,
    weather: DataFrame, weather_spec: GridSpec, fires: DataFrame, before: str | None = None,
) -> DataFrame:
    """Lines near a place: burn probability, fire weather by decade and month, nearest past fire.

    ``weather`` is the union of historical and future rows (lon, lat, decade, month, ensemble_mean);
    ``fires``: fire_id, lon, lat and, where given, ignition_date: fires from ``before`` on are none of the past.
    """
    if before is not None and "ignition_date" in fires.columns:
        fires = fires.filter(F.col("ignition_date") < F.lit(before).cast("date"))
    lon, lat = (lit(float(v)) for v in center)
    reach = spatial.line_vertices(lines).filter(geo.haversine_miles(F.col("lon"), F.col("lat"), lon, lat) <= miles)
    near = lines.join(reach.select("osm_id"), "osm_id", "left_semi")
    vertices = spatial.line_vertices(near.select("osm_id", *spatial.GEOMETRY_COLUMNS), dedup=True)
    p_max = sample_points(burn, vertices, burn_spec).groupBy("osm_id").agg(
        F.max("burn_probability").alias("burn_probability"))
    fw = sample_points(weather, vertices, weather_spec).groupBy("osm_id", "decade", "month").agg(
        F.avg("ensemble_mean").alias("ensemble_mean"))
    c = geo.centroid()
    middles = near.withColumn("_c", c).select("osm_id", F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"))
    fire = spatial.nearest(middles, fires, "osm_id", "fire_id")
    return left_chain(near.select("osm_id"), [
        (p_max, ["osm_id"]), (fire, ["osm_id"]), (fw, ["osm_id"])])


def assign_manager(assets: DataFrame, rules: DataFrame, county: str = "county", kind: str = "asset_type") -> DataFrame:
    """Manager of the first rule that lists both the county and the type, else 'Unaffiliated'.

    ``rules``: priority, manager, counties array, types array; at most one row per manager.
    """
    flat = rules.select(
        "priority", "manager", F.explode("counties").alias(county), F.col("types")).select(
        "priority", "manager", county, F.explode("types").alias(kind))
    best = flat.groupBy(county, kind).agg(F.min_by("manager", "priority").alias("manager"))
    return assets.join(best, [county, kind], "left").withColumn(
        "manager", F.coalesce("manager", F.lit("Unaffiliated")))


def first_attributes(rows: DataFrame, columns: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First value per id and column in the given order."""
    by = F.struct(*order)
    return rows.groupBy("osm_id").agg(*[F.min_by(c, by).alias(c) for c in columns])
