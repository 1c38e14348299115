"""Geometry functions and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.harness import Tables, check
from checks.rounding import r6
from checks.shapes import admin_geometry, asset_geometry, zone_geometry
from terrahaz.functions import geometry as geo
from terrahaz.operators import exposure as E
from terrahaz.operators import grid as G
from terrahaz.operators import spatial as S
from terrahaz.operators.grid import GridSpec
from terrahaz.plans import jobs
from terrahaz.sources import files
from terrahaz.streaming import feeds

# An asset line runs (x0,y0) -> (x1,y0) -> (x1,y1); it misses a box only when the
# box lies in the open corner above its first leg and left of its second.
TOUCH = ("a.x0 <= b.xmax AND b.xmin <= a.x1 AND a.y0 <= b.ymax AND b.ymin <= a.y1 "
         "AND (a.kind <> 'ST_LineString' OR a.y0 >= b.ymin OR a.x1 <= b.xmax)")

R_KM = "6371.0072e0"
BOX_KM2 = ("radians({x1} - {x0}) * (sin(radians({y1})) - sin(radians({y0}))) * " + R_KM + " * " + R_KM)


def haversine(lon1, lat1, lon2, lat2) -> str:
    return (f"2e0 * 6371008.8e0 * asin(least(sqrt(pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2)), 1e0)) * 0.000621371e0")


def assets(t: Tables):
    return asset_geometry(t.fx_assets)


@check("tile_candidates", """
SELECT a.osm_id, b.fld_ar_id, b.zone_rank FROM {fx_assets} a JOIN {fx_zones} b
 ON a.x0 <= b.xmax AND b.xmin <= a.x1 AND a.y0 <= b.ymax AND b.ymin <= a.y1
""")
def tile_candidates(t: Tables):
    return S.tile_candidates(assets(t), zone_geometry(t.fx_zones), 0.25).select("osm_id", "fld_ar_id", "zone_rank")


@check("spatial_intersects", f"""
SELECT a.osm_id, b.fld_ar_id, b.zone_rank FROM {{fx_assets}} a JOIN {{fx_zones}} b ON {TOUCH}
""")
def spatial_intersects(t: Tables):
    return S.intersecting(assets(t), zone_geometry(t.fx_zones), 0.25).select("osm_id", "fld_ar_id", "zone_rank")


@check("spatial_join_inner_admin", f"""
SELECT a.osm_id, b.name, b.admin_level FROM {{fx_assets}} a JOIN {{fx_admin}} b ON {TOUCH}
""")
def spatial_join_inner_admin(t: Tables):
    areas = admin_geometry(t.fx_admin).select("name", "admin_level", *S.GEOMETRY_COLUMNS)
    return S.spatial_join(assets(t), areas, 0.5).select("osm_id", "name", "admin_level")


@check("spatial_join_left_admin", f"""
SELECT a.osm_id, b.name FROM {{fx_assets}} a LEFT JOIN (SELECT * FROM {{fx_admin}} WHERE admin_level = 8) b ON {TOUCH}
""")
def spatial_join_left_admin(t: Tables):
    areas = admin_geometry(t.fx_admin).filter("admin_level = 8").select("name", *S.GEOMETRY_COLUMNS)
    return S.spatial_join(assets(t), areas, 0.5, "left").select("osm_id", "name")


BOXES = [(-124.0, 20.1, -122.5, 20.5), (-119.0, 20.0, -118.0, 20.9)]


@check("multi_box_filter", "SELECT a.osm_id FROM {fx_assets} a WHERE " + " OR ".join(
    "(" + TOUCH.replace("b.xmin", f"{b[0]}e0").replace("b.ymin", f"{b[1]}e0").replace("b.xmax", f"{b[2]}e0")
    .replace("b.ymax", f"{b[3]}e0") + ")" for b in BOXES))
def multi_box_filter(t: Tables):
    return S.in_boxes(assets(t), BOXES).select("osm_id")


@check("geometry_centroid", """
SELECT osm_id, round(CASE kind WHEN 'ST_LineString' THEN (w * (x0 + x1) / 2e0 + h * x1) / (w + h) ELSE (x0 + x1) / 2e0 END, 6) AS lon,
       round(CASE kind WHEN 'ST_LineString' THEN (w * y0 + h * (y0 + y1) / 2e0) / (w + h) ELSE (y0 + y1) / 2e0 END, 6) AS lat
FROM {fx_assets}
""")
def geometry_centroid(t: Tables):
    c = geo.centroid()
    return r6(assets(t).withColumn("_c", c).select("osm_id", F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat")))


def num(e: str) -> str:
    return f"regexp_replace(cast(round({e}, 3) AS varchar), '\\.0$', '')"


@check("geometry_wkt", f"""
SELECT osm_id, CASE kind WHEN 'ST_Point' THEN 'POINT (' || {num('x0')} || ' ' || {num('y0')} || ')'
  WHEN 'ST_LineString' THEN 'LINESTRING (' || {num('x0')} || ' ' || {num('y0')} || ', ' || {num('x1')} || ' ' || {num('y0')}
      || ', ' || {num('x1')} || ' ' || {num('y1')} || ')'
  ELSE 'POLYGON ((' || {num('x0')} || ' ' || {num('y0')} || ', ' || {num('x1')} || ' ' || {num('y0')} || ', ' || {num('x1')} || ' '
      || {num('y1')} || ', ' || {num('x0')} || ' ' || {num('y1')} || ', ' || {num('x0')} || ' ' || {num('y0')} || '))' END AS wkt
FROM {{fx_assets}}
""")
def geometry_wkt(t: Tables):
    return assets(t).select("osm_id", geo.to_wkt(digits=3).alias("wkt"))


@check("display_geometry", """
SELECT osm_id, CASE WHEN kind = 'ST_Polygon' THEN 'ST_Point' ELSE kind END AS shown,
       CASE WHEN kind = 'ST_LineString' THEN 3 ELSE 1 END AS vertices FROM {fx_assets}
""")
def display_geometry(t: Tables):
    kind, parts = geo.display_geometry()
    return assets(t).select("osm_id", kind.alias("shown"), F.size(geo.vertices(parts)).alias("vertices"))


@check("geometry_area", f"""
SELECT osm_id, round(CASE WHEN kind = 'ST_Polygon' THEN {BOX_KM2.format(x0='x0', x1='x1', y0='y0', y1='y1')} ELSE 0e0 END, 5) AS km2
FROM {{fx_assets}}
""")
def geometry_area(t: Tables):
    polygon = F.col("geom_type").isin(*geo.POLYGONS)
    return r6(assets(t).select("osm_id", F.when(polygon, geo.area_km2("parts")).otherwise(0.0).alias("km2")), digits=5)


@check("approx_box_area", """
SELECT flood_zone, round(sum(abs(ymax - ymin) * 110.574e0 * abs(xmax - xmin) * 111.320e0 * cos(radians((ymin + ymax) / 2e0))), 4) AS km2
FROM {fx_zones} GROUP BY flood_zone
""")
def approx_box_area(t: Tables):
    area = geo.approx_box_km2(*[F.col(c) for c in S.ENVELOPE])
    return r6(t.fx_zones.groupBy("flood_zone").agg(F.sum(area).alias("km2")), digits=4)


@check("collapse_small_polygons", f"""
SELECT osm_id, CASE WHEN small THEN 'ST_Point' ELSE kind END AS geom_type,
       round(CASE WHEN small THEN (x0 + x1) / 2e0 ELSE x0 END, 6) AS xmin, round(CASE WHEN small THEN (y0 + y1) / 2e0 ELSE y1 END, 6) AS ymax
FROM (SELECT *, kind = 'ST_Polygon' AND {BOX_KM2.format(x0='x0', x1='x1', y0='y0', y1='y1')} < 20e0 AS small FROM {{fx_assets}}) q
""")
def collapse_small_polygons(t: Tables):
    return r6(S.collapse_small(assets(t), 20.0).select("osm_id", "geom_type", "xmin", "ymax"))


@check("line_vertices", """
SELECT osm_id, x0 AS lon, y0 AS lat FROM {fx_assets} WHERE kind = 'ST_LineString'
UNION ALL SELECT osm_id, x1, y0 FROM {fx_assets} WHERE kind = 'ST_LineString'
UNION ALL SELECT osm_id, x1, y1 FROM {fx_assets} WHERE kind = 'ST_LineString'
""")
def line_vertices(t: Tables):
    return S.line_vertices(assets(t).select("osm_id", *S.GEOMETRY_COLUMNS))


@check("line_vertices_simplified", """
SELECT osm_id, x0 AS lon, y0 AS lat FROM {fx_assets} WHERE kind = 'ST_LineString'
UNION ALL SELECT osm_id, x1, y0 FROM {fx_assets} WHERE kind = 'ST_LineString' AND w * h / sqrt(w * w + h * h) > 0.03e0
UNION ALL SELECT osm_id, x1, y1 FROM {fx_assets} WHERE kind = 'ST_LineString'
""")
def line_vertices_simplified(t: Tables):
    return S.line_vertices(assets(t).select("osm_id", *S.GEOMETRY_COLUMNS), tolerance=0.03)


# Grid of the fixture: the edge is data dependent, so clamping is checked in the unit tests.
SPEC = GridSpec(-125.0, 20.0, 0.25, 0.25, 40, 4)
CELL_SQL = ("least(greatest(floor(({lon} + 125e0) / 0.25e0 + 0.5e0), 0), 39) AS ix, "
            "least(greatest(floor(({lat} - 20e0) / 0.25e0 + 0.5e0), 0), {last}) AS iy")


def spec_for(t: Tables) -> GridSpec:
    """Grid extent from the key range of the parts: one row of cells per 640 keys."""
    top = t.part.agg(F.max("p_partkey")).first()[0]
    return GridSpec(-125.0, 20.0, 0.25, 0.25, 40, int(top // 640) + 1)


LAST = "(SELECT max(floor(p_partkey / 640)) FROM {part})"
KEYED = """
keyed AS (SELECT *, round((lon + 125e0) / 0.25e0) AS ix, round((lat - 20e0) / 0.25e0) AS iy FROM {fx_ensemble})
"""


@check("sample_points", f"""
WITH {KEYED}, pts AS (SELECT osm_id, {CELL_SQL.format(lon='x0', lat='y0', last=LAST)} FROM {{fx_assets}})
SELECT p.osm_id, k.decade AS decade, k.month, k.ensemble_mean, k.ensemble_max FROM pts p JOIN keyed k ON k.ix = p.ix AND k.iy = p.iy
""")
def sample_points(t: Tables):
    pts = t.fx_assets.select("osm_id", F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    return G.sample_points(t.fx_ensemble, pts, spec_for(t)).select("osm_id", "decade", "month", "ensemble_mean", "ensemble_max")


ZONAL = f"""
WITH {KEYED}, cells AS (
  SELECT a.osm_id, c.ix, c.iy,
    (least(a.x1, -125e0 + (c.ix + 0.5e0) * 0.25e0) - greatest(a.x0, -125e0 + (c.ix - 0.5e0) * 0.25e0))
    * (least(a.y1, 20e0 + (c.iy + 0.5e0) * 0.25e0) - greatest(a.y0, 20e0 + (c.iy - 0.5e0) * 0.25e0)) AS w
  FROM {{fx_assets}} a JOIN (SELECT DISTINCT ix, iy FROM keyed) c
   ON a.x0 < -125e0 + (c.ix + 0.5e0) * 0.25e0 AND a.x1 > -125e0 + (c.ix - 0.5e0) * 0.25e0
   AND a.y0 < 20e0 + (c.iy + 0.5e0) * 0.25e0 AND a.y1 > 20e0 + (c.iy - 0.5e0) * 0.25e0
  WHERE a.kind = 'ST_Polygon')
"""


@check("zonal_mean_max", ZONAL + """
SELECT c.osm_id, k.decade AS decade, k.month, round(sum(k.ensemble_mean * c.w) / sum(c.w), 9) AS ensemble_mean_mean,
       max(k.ensemble_mean) AS ensemble_mean_max
FROM cells c JOIN keyed k ON k.ix = c.ix AND k.iy = c.iy WHERE c.w > 1e-12 GROUP BY ALL
""")
def zonal_mean_max(t: Tables):
    polygons = assets(t).filter("geom_type = 'ST_Polygon'")
    out = G.zonal_pivot(t.fx_ensemble, polygons, spec_for(t), "ensemble_mean", ["decade", "month"])
    return r6(out, ["ensemble_mean_mean"], 9)


@check("zonal_statistics", ZONAL + """
SELECT c.osm_id, k.decade AS decade, k.month, round(sum(k.ensemble_median * c.w) / sum(c.w), 9) AS ensemble_median
FROM cells c JOIN keyed k ON k.ix = c.ix AND k.iy = c.iy WHERE c.w > 1e-12 GROUP BY ALL
""")
def zonal_statistics(t: Tables):
    polygons = assets(t).filter("geom_type = 'ST_Polygon'")
    out = G.zonal_stats(t.fx_ensemble, polygons, spec_for(t), ["ensemble_median"], ["decade", "month"])
    return r6(out, ["ensemble_median"], 9)


def _ell_parts():
    """A rectangle without its upper right quarter, clockwise."""
    x0, y0, x1, y1 = (F.col(c) for c in S.ENVELOPE)
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    return F.array(F.array(F.array(*[geo.vertex(x, y) for x, y in ((x0, y0), (x0, y1), (xm, y1), (xm, ym), (x1, ym), (x1, y0), (x0, y0))])))


def _shared(x1: str, y0: str, y1: str) -> str:
    return (f"greatest(least({x1}, -125e0 + (c.ix + 0.5e0) * 0.25e0) - greatest(a.x0, -125e0 + (c.ix - 0.5e0) * 0.25e0), 0e0)"
            f" * greatest(least({y1}, 20e0 + (c.iy + 0.5e0) * 0.25e0) - greatest({y0}, 20e0 + (c.iy - 0.5e0) * 0.25e0), 0e0)")


@check("zonal_concave", f"""
WITH {KEYED}, cells AS (
  SELECT a.osm_id, c.ix, c.iy, {_shared('a.x1', 'a.y0', '(a.y0 + a.y1) / 2e0')} + {_shared('(a.x0 + a.x1) / 2e0', '(a.y0 + a.y1) / 2e0', 'a.y1')} AS w
  FROM {{fx_assets}} a JOIN (SELECT DISTINCT ix, iy FROM keyed) c
   ON a.x0 < -125e0 + (c.ix + 0.5e0) * 0.25e0 AND a.x1 > -125e0 + (c.ix - 0.5e0) * 0.25e0
   AND a.y0 < 20e0 + (c.iy + 0.5e0) * 0.25e0 AND a.y1 > 20e0 + (c.iy - 0.5e0) * 0.25e0
  WHERE a.kind = 'ST_Polygon')
SELECT c.osm_id, k.decade AS decade, k.month, round(sum(k.ensemble_mean * c.w) / sum(c.w), 9) AS ensemble_mean_mean,
       max(k.ensemble_mean) AS ensemble_mean_max
FROM cells c JOIN keyed k ON k.ix = c.ix AND k.iy = c.iy WHERE c.w > 1e-10 GROUP BY ALL
""")
def zonal_concave(t: Tables):
    polygons = assets(t).filter("geom_type = 'ST_Polygon'").withColumn("parts", _ell_parts())
    return r6(G.zonal_pivot(t.fx_ensemble, polygons, spec_for(t), "ensemble_mean", ["decade", "month"]), ["ensemble_mean_mean"], 9)


@check("line_exposure", f"""
WITH {KEYED}, v AS (
  SELECT osm_id, x0 AS lon, y0 AS lat FROM {{fx_assets}} WHERE kind = 'ST_LineString'
  UNION ALL SELECT osm_id, x1, y0 FROM {{fx_assets}} WHERE kind = 'ST_LineString'
  UNION ALL SELECT osm_id, x1, y1 FROM {{fx_assets}} WHERE kind = 'ST_LineString'),
p AS (SELECT osm_id, {CELL_SQL.format(lon='lon', lat='lat', last=LAST)} FROM v)
SELECT p.osm_id, k.decade AS decade, k.month, round(avg(ensemble_mean), 6) AS ensemble_mean, round(avg(ensemble_median), 6) AS ensemble_median,
   round(avg(ensemble_stddev), 6) AS ensemble_stddev, min(ensemble_min) AS ensemble_min, max(ensemble_max) AS ensemble_max,
   min(ensemble_q1) AS ensemble_q1, max(ensemble_q3) AS ensemble_q3
FROM p JOIN keyed k ON k.ix = p.ix AND k.iy = p.iy GROUP BY ALL
""")
def line_exposure(t: Tables):
    v = S.line_vertices(assets(t).select("osm_id", *S.GEOMETRY_COLUMNS))
    sampled = G.sample_points(t.fx_ensemble, v, spec_for(t))
    return r6(E.line_aggregate(sampled, ["osm_id", "decade", "month"]),
              ["ensemble_mean", "ensemble_median", "ensemble_stddev"])


@check("within_radius_counts", f"""
SELECT a.osm_id, count(CASE WHEN d <= 5 THEN 1 END) AS count_5mi, count(CASE WHEN d <= 10 THEN 1 END) AS count_10mi,
       count(CASE WHEN d <= 25 THEN 1 END) AS count_25mi
FROM {{fx_assets}} a LEFT JOIN (
  SELECT p.osm_id, {haversine('p.x0', 'p.y0', 's.lon', 's.lat')} AS d FROM {{fx_assets}} p JOIN {{fx_stations}} s
   ON abs(s.lat - p.y0) < 0.5e0 AND abs(s.lon - p.x0) < 1e0) q ON q.osm_id = a.osm_id GROUP BY a.osm_id
""")
def within_radius_counts(t: Tables):
    left = t.fx_assets.select("osm_id", F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    return S.counts_within(left, t.fx_stations, [5, 10, 25], "osm_id")


@check("nearest_station", f"""
SELECT osm_id, station_id AS nearest_station_id, round(d, 6) AS distance_miles FROM (
  SELECT a.osm_id, s.station_id, {haversine('a.x0', 'a.y0', 's.lon', 's.lat')} AS d,
    row_number() OVER (PARTITION BY a.osm_id ORDER BY {haversine('a.x0', 'a.y0', 's.lon', 's.lat')}, s.station_id) AS rn
  FROM {{fx_assets}} a CROSS JOIN {{fx_stations}} s) q WHERE rn = 1
""")
def nearest_station(t: Tables):
    left = t.fx_assets.select("osm_id", F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    return r6(S.nearest(left, t.fx_stations, "osm_id", "station_id"), ["distance_miles"])


SHARE = BOX_KM2.format(x0="greatest(a.xmin, b.xmin)", x1="least(a.xmax, b.xmax)", y0="greatest(a.ymin, b.ymin)",
                       y1="least(a.ymax, b.ymax)") + " / (" + BOX_KM2.format(x0="a.xmin", x1="a.xmax", y0="a.ymin", y1="a.ymax") + ")"
SHARES = f"""
shares AS (SELECT a.fld_ar_id, a.zone_rank, b.admin_id, least(greatest({SHARE}, 0e0), 1e0) AS overlap_share FROM {{fx_zones}} a JOIN {{fx_admin}} b
  ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)
"""


@check("overlap_share", f"""
WITH {SHARES} SELECT fld_ar_id, zone_rank, admin_id, round(overlap_share, 6) AS overlap_share FROM shares WHERE overlap_share > 1e-9
""")
def overlap_share(t: Tables):
    out = S.overlap_shares(zone_geometry(t.fx_zones), admin_geometry(t.fx_admin), 0.5)
    return r6(out.select("fld_ar_id", "zone_rank", "admin_id", "overlap_share"), ["overlap_share"])


def _ell(t: Tables):
    """Zones without their upper right quarter."""
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    outline = F.array(*[geo.vertex(x, y) for x, y in ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0))])
    return zone_geometry(t.fx_zones).withColumn("parts", F.array(F.array(outline)))


def _covered(x1: str, y0: str, y1: str) -> str:
    """Covered area of one of the two rectangles of such a zone."""
    return (f"greatest(least({x1}, b.xmax) - greatest(a.xmin, b.xmin), 0e0) * greatest(sin(radians(least({y1}, b.ymax)))"
            f" - sin(radians(greatest({y0}, b.ymin))), 0e0)")


XM, YM = "(a.xmin + a.xmax) / 2e0", "(a.ymin + a.ymax) / 2e0"


@check("overlap_share_concave", f"""
WITH s AS (SELECT a.zone_rank, b.admin_id, ({_covered('a.xmax', 'a.ymin', YM)} + {_covered(XM, YM, 'a.ymax')})
    / ((a.xmax - a.xmin) * (sin(radians({YM})) - sin(radians(a.ymin))) + ({XM} - a.xmin) * (sin(radians(a.ymax)) - sin(radians({YM})))) AS share
  FROM {{fx_zones}} a JOIN {{fx_admin}} b ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)
SELECT zone_rank, admin_id, round(share, 6) AS overlap_share FROM s WHERE share > 1e-9
""")
def overlap_share_concave(t: Tables):
    out = S.overlap_shares(_ell(t), admin_geometry(t.fx_admin), 0.5)
    return r6(out.select("zone_rank", "admin_id", "overlap_share"), ["overlap_share"])


@check("weighted_income", f"""
WITH {SHARES}
SELECT s.admin_id AS utility_id, i.year, round(sum(i.agi * 1000e0 * s.overlap_share) / sum(i.returns * s.overlap_share), 4) AS income_per_return
FROM (SELECT o_orderkey AS zone_rank, cast(year(o_orderdate) AS int) AS year, o_totalprice AS agi, 1e0 + o_custkey % 7 AS returns FROM {{orders}}) i
JOIN shares s ON s.zone_rank = i.zone_rank WHERE s.overlap_share > 1e-9 GROUP BY 1, 2
""")
def weighted_income(t: Tables):
    zips = zone_geometry(t.fx_zones).withColumnRenamed("zone_rank", "zipcode")
    utilities = admin_geometry(t.fx_admin).withColumnRenamed("admin_id", "utility_id")
    shares = S.overlap_shares(zips.select("zipcode", *S.GEOMETRY_COLUMNS),
                              utilities.select("utility_id", *S.GEOMETRY_COLUMNS), 0.5)
    income = t.orders.select(
        F.col("o_orderkey").alias("zipcode"), F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_totalprice").alias("agi"), (F.lit(1.0) + F.pmod("o_custkey", F.lit(7))).alias("returns"))
    return r6(jobs.weighted_income(income, shares.select("zipcode", "utility_id", "overlap_share")),
              ["income_per_return"], 4)


def _ragged(t: Tables):
    """Newest zones with their outline dense enough to need cutting (20 vertices a side)."""
    from terrahaz.plans.hazards import latest_zones

    newest = latest_zones(t.fx_zones)

    def side(x0, y0, x1, y1):
        return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: geo.vertex(
            F.col(x0) + (F.col(x1) - F.col(x0)) * i / 20.0, F.col(y0) + (F.col(y1) - F.col(y0)) * i / 20.0))

    ring = F.concat(side("xmin", "ymin", "xmax", "ymin"), side("xmax", "ymin", "xmax", "ymax"),
                    side("xmax", "ymax", "xmin", "ymax"), side("xmin", "ymax", "xmin", "ymin"),
                    F.array(geo.vertex(F.col("xmin"), F.col("ymin"))))
    return newest.withColumns({"geom_type": F.lit("ST_Polygon"), "parts": F.array(F.array(ring))})


@check("subdivided_area", """
SELECT fld_ar_id, round((xmax - xmin) * (ymax - ymin), 6) AS area, true AS small FROM (SELECT *, row_number() OVER (PARTITION BY fld_ar_id
  ORDER BY lomr_effective_date DESC NULLS LAST, zone_rank) AS rn FROM {fx_zones}) q WHERE rn = 1
""")
def subdivided_area(t: Tables):
    cut = S.subdivide(_ragged(t), 64)
    return r6(cut.groupBy("fld_ar_id").agg(
        F.sum(geo.area_deg2("parts")).alias("area"),
        F.bool_and(F.size(geo.vertices(F.col("parts"))) <= 64).alias("small")), ["area"])


@check("clip_region_cells", """
SELECT DISTINCT g.lat, g.lon FROM {fx_grid} g JOIN {fx_admin} a
 ON g.lon - 0.125e0 <= a.xmax AND a.xmin <= g.lon + 0.125e0 AND g.lat - 0.125e0 <= a.ymax AND a.ymin <= g.lat + 0.125e0
WHERE a.admin_level = 8
""")
def clip_region_cells(t: Tables):
    areas = admin_geometry(t.fx_admin).filter("admin_level = 8")
    return G.clip_region(t.fx_grid, areas, spec_for(t)).select("lat", "lon").distinct()


CELL_MEANS = "cm AS (SELECT lat, lon, max(pr) AS v FROM {fx_grid} GROUP BY 1, 2)"


@check("resample_linear", f"""
WITH {CELL_MEANS},
target AS (SELECT x.j AS jx, y.j AS jy, -125e0 + x.j * 0.1875e0 AS lon, 20e0 + y.j * 0.1875e0 AS lat
  FROM (SELECT unnest(range(0, 53)) AS j) x CROSS JOIN (SELECT unnest(range(0, cast(floor({LAST} * 4 / 3 + 0.5) + 1 AS bigint))) AS j) y),
corner AS (SELECT t.lon, t.lat, c.v, CASE WHEN c.v IS NOT NULL THEN greatest(1e0 - abs((t.lon - c.lon) / 0.25e0), 0e0) * greatest(1e0 - abs((t.lat - c.lat) / 0.25e0), 0e0) END AS w
  FROM target t LEFT JOIN cm c ON abs(t.lon - c.lon) < 0.25e0 AND abs(t.lat - c.lat) < 0.25e0)
SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, round(CASE WHEN sum(w) > 1 - 1e-9 THEN sum(v * w) / sum(w) END, 6) AS v
FROM corner GROUP BY 1, 2
""")
def resample_linear(t: Tables):
    cells = t.fx_grid.groupBy("lat", "lon").agg(F.max("pr").alias("v"))
    return r6(G.resample(cells, spec_for(t), 0.1875, "v").select("lat", "lon", "v"))


@check("resample_nearest", f"""
WITH {CELL_MEANS},
target AS (SELECT -125e0 + x.j * 0.5e0 AS lon, 20e0 + y.j * 0.5e0 AS lat
  FROM (SELECT unnest(range(0, 20)) AS j) x CROSS JOIN (SELECT unnest(range(0, cast(floor({LAST} / 2) + 1 AS bigint))) AS j) y)
SELECT t.lat, t.lon, c.v FROM target t LEFT JOIN cm c ON c.lat = t.lat AND c.lon = t.lon
""")
def resample_nearest(t: Tables):
    cells = t.fx_grid.groupBy("lat", "lon").agg(F.max("pr").alias("v"))
    spec = spec_for(t)
    target = GridSpec(spec.x0, spec.y0, 0.5, 0.5, 20, (spec.ny - 1) // 2 + 1)
    return G.align(cells, spec, target, "v", "nearest").select("lat", "lon", "v")


@check("box_polygon_rows", """
SELECT fld_ar_id, zone_rank, 5 AS vertices, xmin AS first_x, ymax AS third_y FROM {fx_zones}
""")
def box_polygon_rows(t: Tables):
    v = geo.vertices(F.col("parts"))
    return zone_geometry(t.fx_zones).select(
        "fld_ar_id", "zone_rank", F.size(v).alias("vertices"), v[0]["x"].alias("first_x"), v[2]["y"].alias("third_y"))


@check("geojson_validity", """
SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 4 = 3 AS valid FROM {orders}
""")
def geojson_validity(t: Tables):
    m = F.pmod("o_orderkey", F.lit(4))
    coords = F.when(m == 0, F.concat(F.lit("["), F.col("o_custkey"), F.lit(",1.5]"))).when(
        m == 3, F.lit("[3,4]")).otherwise(F.lit("[1]"))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'), coords,
                    F.lit('},"properties":{"a":1}}'))
    text = F.when(m == 2, F.lit("not json")).otherwise(text)
    return t.orders.withColumn("f", text).select("o_orderkey", geo.geojson_valid(F.col("f")).alias("valid"))


@check("geojson_assets", """
SELECT 'orders' AS asset_name, 'ST_Point' AS geom_type, cast(o_custkey AS double) AS xmin, 1.5e0 AS ymax, o_orderstatus AS status,
  cast(o_orderkey AS varchar) AS key FROM {orders}
""")
def geojson_assets(t: Tables):
    """Every order as a feature of one of four collections, written and read back in splits."""
    text = F.concat(F.lit('{ "geometry": {"type":"Point","coordinates":['), F.col("o_custkey"), F.lit(',1.5]}, "type": "Feature",'
                    '"properties":{"note":"a }, {\\"type\\": [","status":"'), F.col("o_orderstatus"), F.lit('","key":"'), F.col("o_orderkey"), F.lit('"}}'))
    documents = t.orders.select(F.pmod("o_orderkey", F.lit(4)).alias("d"), text.alias("feature")).groupBy("d").agg(
        F.concat(F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"x"}},"features":['),
                 F.array_join(F.collect_list("feature"), ",\n"), F.lit("]}")).alias("value"))
    folder = feeds.shared_folder(t.spark, "collections")
    documents.select("value").repartition(4).write.option("lineSep", " ").text(folder)
    names = {r["file"]: "orders" for r in t.spark.read.text(folder).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    return files.read_geojson_assets(t.spark, names).select(
        "asset_name", "geom_type", "xmin", "ymax", F.col("properties")["status"].alias("status"), F.col("properties")["key"].alias("key"))
