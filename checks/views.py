"""Hazard views and un-exposed ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.harness import Tables, check
from checks.shapes import asset_geometry, zone_geometry
from terrahaz.functions import geometry as geo
from terrahaz.plans import hazards


@check("hazard_wildfire", """
WITH hb AS (
  SELECT osm_id, month, avg(ensemble_mean) AS b FROM {fx_fwi} WHERE ssp = -999 GROUP BY osm_id, month)
SELECT f.osm_id, f.month, f.decade AS decade, f.decade AS start_year, cast(f.decade + 9 AS int) AS end_year,
       f.ssp, f.ensemble_mean, hb.b AS ensemble_mean_historical_baseline, p.burn_probability
FROM {fx_fwi} f LEFT JOIN {fx_burn} p ON f.osm_id = p.osm_id
LEFT JOIN hb ON f.osm_id = hb.osm_id AND f.month = hb.month
""")
def wildfire(t: Tables):
    return hazards.wildfire(t.fx_fwi, t.fx_burn)


EXTREME_PRECIP = """
SELECT f.osm_id, f.month, f.start_year, f.end_year, f.ssp, f.return_period,
       f.ensemble_median AS pfe_ensemble_median, f.ensemble_q3 AS pfe_ensemble_q3,
       f.ensemble_median / nullif(c.ensemble_median, 0) AS pfe_ensemble_median_historical_baseline,
       f.ensemble_q3 / nullif(c.ensemble_q3, 0) AS pfe_ensemble_q3_historical_baseline
FROM {fx_pfe} f LEFT JOIN {fx_pcf} c ON f.osm_id = c.osm_id AND f.month = c.month
 AND f.start_year = c.start_year AND f.end_year = c.end_year AND f.ssp = c.ssp
 AND f.return_period = c.return_period
"""


@check("hazard_extreme_precip", EXTREME_PRECIP)
def extreme_precip(t: Tables):
    return hazards.extreme_precip(t.fx_pfe, t.fx_pcf)


LATEST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fld_ar_id
  ORDER BY lomr_effective_date DESC NULLS LAST, zone_rank) AS rn FROM {fx_zones}) q WHERE rn = 1
"""

ZONE_PICK = f"""
WITH latest AS ({LATEST}),
hit AS (
  SELECT osm_id, flood_zone, flood_zone_subtype, is_sfha, flood_depth FROM (
    SELECT a.osm_id, z.*, row_number() OVER (PARTITION BY a.osm_id
      ORDER BY z.lomr_effective_date DESC NULLS LAST, z.fld_ar_id) AS pick
    FROM {{fx_assets}} a JOIN latest z ON a.x0 <= z.xmax AND z.xmin <= a.x1 AND a.y0 <= z.ymax AND z.ymin <= a.y1
     AND (a.kind <> 'ST_LineString' OR a.y0 >= z.ymin OR a.x1 <= z.xmax)) q WHERE pick = 1)
"""


@check("latest_flood_zones", f"""
SELECT fld_ar_id, zone_rank, flood_zone, flood_zone_subtype, is_sfha, flood_depth, lomr_effective_date
FROM ({LATEST}) l
""")
def latest_flood_zones(t: Tables):
    return hazards.latest_zones(zone_geometry(t.fx_zones)).select(
        "fld_ar_id", "zone_rank", "flood_zone", "flood_zone_subtype", "is_sfha", "flood_depth",
        "lomr_effective_date")


def _assets(t: Tables):
    return asset_geometry(t.fx_assets)


@check("asset_latest_zone", ZONE_PICK + """
SELECT a.osm_id, flood_zone, flood_zone_subtype, is_sfha, flood_depth
FROM {fx_assets} a LEFT JOIN hit ON a.osm_id = hit.osm_id
""")
def asset_latest_zone(t: Tables):
    zones = zone_geometry(hazards.latest_zones(t.fx_zones))
    return hazards.asset_latest_zone(_assets(t), zones)


@check("hazard_flood", ZONE_PICK + f""",
ep AS ({EXTREME_PRECIP}),
base AS (
  SELECT ep.osm_id, ep.month, ep.start_year, ep.end_year, ep.ssp, ep.return_period,
         pfe_ensemble_median AS ensemble_median, pfe_ensemble_q3 AS ensemble_q3,
         pfe_ensemble_median_historical_baseline AS ensemble_median_historical_baseline,
         pfe_ensemble_q3_historical_baseline AS ensemble_q3_historical_baseline,
         flood_zone, flood_zone_subtype, is_sfha, flood_depth
  FROM ep LEFT JOIN hit ON ep.osm_id = hit.osm_id)
SELECT base.*, cast(g.d AS int) AS decade FROM base
JOIN (SELECT unnest(generate_series(2000, 2110, 10)) AS d) g
  ON g.d BETWEEN ceil(start_year / 1e1) * 10 AND floor(end_year / 1e1) * 10
""")
def flood(t: Tables):
    zones = zone_geometry(hazards.latest_zones(t.fx_zones))
    return hazards.flood(hazards.extreme_precip(t.fx_pfe, t.fx_pcf), _assets(t), zones)


def _outlined(zones):
    """Zones as outlines of 160 vertices, so that joins go through pieces."""
    def side(x0, y0, x1, y1):
        return F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: geo.vertex(
            F.col(x0) + (F.col(x1) - F.col(x0)) * i / 40.0, F.col(y0) + (F.col(y1) - F.col(y0)) * i / 40.0))

    ring = F.concat(side("xmin", "ymin", "xmax", "ymin"), side("xmax", "ymin", "xmax", "ymax"), side("xmax", "ymax", "xmin", "ymax"),
                    side("xmin", "ymax", "xmin", "ymin"), F.array(geo.vertex(F.col("xmin"), F.col("ymin"))))
    return zones.withColumns({"geom_type": F.lit("ST_Polygon"), "parts": F.array(F.array(ring))})


@check("flood_zone_pieces", ZONE_PICK + """
SELECT a.osm_id, flood_zone, flood_zone_subtype, is_sfha, flood_depth
FROM {fx_assets} a LEFT JOIN hit ON a.osm_id = hit.osm_id
""")
def flood_zone_pieces(t: Tables):
    pieces = hazards.latest_zones_subdivided(t.fx_zones, 64, _outlined)
    return hazards.asset_latest_zone(_assets(t), pieces)
