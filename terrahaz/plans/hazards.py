"""Hazard views over exposure tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.operators import spatial
from terrahaz.operators.relational import latest_per, top_per

PRECIP_KEYS = ("osm_id", "month", "start_year", "end_year", "ssp", "return_period")


def historical_baseline(fwi: DataFrame) -> DataFrame:
    return (
        fwi.filter(F.col("ssp") == -999)
        .groupBy("osm_id", "month")
        .agg(F.avg("ensemble_mean").alias("ensemble_mean_historical_baseline"))
    )


def wildfire(fwi: DataFrame, burn: DataFrame) -> DataFrame:
    """Fire weather with its historical baseline and burn probability.

    Both joins share the ``osm_id`` prefix of the key; the baseline is at most
    twelve rows per asset and is aggregated before it is shuffled. A row of the
    burn probabilities is a few bytes of their file, so they are sorted, not broadcast.
    """
    return (
        fwi.select("osm_id", "month", "decade", "ssp", "ensemble_mean")
        .join(burn.select("osm_id", "burn_probability").hint("merge"), "osm_id", "left")
        .join(historical_baseline(fwi), ["osm_id", "month"], "left")
        .select(
            "osm_id", "month", "decade",
            F.col("decade").alias("start_year"), (F.col("decade") + 9).alias("end_year"),
            "ssp", "ensemble_mean", "ensemble_mean_historical_baseline", "burn_probability",
        )
    )


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def extreme_precip(levels: DataFrame, factors: DataFrame) -> DataFrame:
    """Return levels with the level implied for the baseline period."""
    factor = factors.select(
        *PRECIP_KEYS,
        F.col("ensemble_median").alias("_f_median"), F.col("ensemble_q3").alias("_f_q3"),
    )
    return levels.join(factor, list(PRECIP_KEYS), "left").select(
        *PRECIP_KEYS,
        F.col("ensemble_median").alias("pfe_ensemble_median"),
        F.col("ensemble_q3").alias("pfe_ensemble_q3"),
        _ratio(F.col("ensemble_median"), F.col("_f_median")).alias("pfe_ensemble_median_historical_baseline"),
        _ratio(F.col("ensemble_q3"), F.col("_f_q3")).alias("pfe_ensemble_q3_historical_baseline"),
    )


def latest_zones(zones: DataFrame) -> DataFrame:
    """Newest record of every flood area, undated records last."""
    ties = [F.col("zone_rank").asc()] if "zone_rank" in zones.columns else []
    return top_per(zones, ["fld_ar_id"], [F.col("lomr_effective_date").desc_nulls_last(), *ties])


def latest_zones_subdivided(zones: DataFrame, max_vertices: int = 64,
                            outline: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Newest zones in pieces of at most ``max_vertices`` vertices, one row per piece: a table for joins and drawing.

    ``outline`` adds the geometry to zones that come without it. It is called on the newest ones, so
    the outlines of older records are neither made nor sorted and shuffled.
    """
    newest = latest_zones(zones)
    return spatial.subdivide(outline(newest) if outline else newest, max_vertices)


ZONE_COLUMNS = ("flood_zone", "flood_zone_subtype", "is_sfha", "flood_depth")


def asset_latest_zone(assets: DataFrame, zones: DataFrame, tile_deg: float = 0.25) -> DataFrame:
    """Every asset with the newest zone it touches (least id on ties), or NULLs.

    Pairs go from the tile join into a ranking with a limit of one, which each
    task applies before the shuffle, so no list of zones per asset is ever held, and a
    zone may come in pieces (``latest_zones_subdivided``): met in several, it counts once.
    """
    zone = zones.select(
        "fld_ar_id", "lomr_effective_date", *ZONE_COLUMNS,
        *spatial.GEOMETRY_COLUMNS,
    )
    hits = spatial.intersecting(assets.select("osm_id", *spatial.GEOMETRY_COLUMNS), zone, tile_deg)
    newest = top_per(
        hits.select("osm_id", "fld_ar_id", "lomr_effective_date", *ZONE_COLUMNS), ["osm_id"],
        [F.col("lomr_effective_date").desc_nulls_last(), F.col("fld_ar_id").asc()])
    return assets.select("osm_id").join(newest.select("osm_id", *ZONE_COLUMNS), "osm_id", "left")


def decades_starting_in(start: Column, end: Column) -> Column:
    """Decades that begin inside [start, end]; an empty range gives NULL, dropped by explode."""
    low = (F.ceil(start / F.lit(10.0)) * 10).cast("int")
    high = (F.floor(end / F.lit(10.0)) * 10).cast("int")
    return F.when(high >= low, F.sequence(low, high, F.lit(10)))


def flood(precip: DataFrame, assets: DataFrame, zones: DataFrame, tile_deg: float = 0.25) -> DataFrame:
    """Extreme precipitation per asset and decade with the newest flood zone.

    ``assets`` is the union of the asset groups; only assets that have
    precipitation rows enter the spatial join.
    """
    order = ["geom_type", "xmin", "ymin", "xmax", "ymax"]
    wanted = latest_per(
        assets.select("osm_id", *spatial.GEOMETRY_COLUMNS)
        .join(precip.select("osm_id"), "osm_id", "left_semi"),
        ["osm_id"], order,
    )
    zone = asset_latest_zone(wanted, zones, tile_deg)
    return (
        precip.join(zone, "osm_id", "left")
        .withColumnsRenamed({
            "pfe_ensemble_median": "ensemble_median",
            "pfe_ensemble_q3": "ensemble_q3",
            "pfe_ensemble_median_historical_baseline": "ensemble_median_historical_baseline",
            "pfe_ensemble_q3_historical_baseline": "ensemble_q3_historical_baseline",
        })
        .withColumn("decade", F.explode(decades_starting_in(F.col("start_year"), F.col("end_year"))))
    )
