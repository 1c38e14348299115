"""Asset queries, exports, risk metrics, file rules and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.groups import SQL_GROUPS, features, pick, tags
from checks.harness import Tables, check
from checks.rounding import r6
from checks.shapes import admin_geometry, asset_geometry, zone_geometry
from checks.shapes_ops import CELL_SQL, KEYED, LAST, TOUCH, haversine, spec_for
from terrahaz.functions import geometry as geo
from terrahaz.functions.values import ENSEMBLE_COLUMNS
from terrahaz.operators import exposure as E
from terrahaz.operators import grid as G
from terrahaz.operators import spatial as S
from terrahaz.plans import asset_groups, asset_query as Q, hazards, jobs
from terrahaz.sources import files, registry, sinks

GROUP = f"grp AS ({pick(SQL_GROUPS['commercial_real_estate'])})"
TOUCH_GROUP = TOUCH.replace("a.kind", "a.geom_type")
NAMES = f"""
county AS (SELECT a.osm_id, b.name FROM grp a JOIN {{fx_admin}} b ON b.admin_level = 6 AND {TOUCH_GROUP}),
city AS (SELECT a.osm_id, b.name FROM grp a JOIN {{fx_admin}} b ON b.admin_level = 8 AND {TOUCH_GROUP})
"""
HAZARD = """
hb AS (SELECT osm_id, month, avg(ensemble_mean) AS b FROM {fx_fwi} WHERE ssp = -999 GROUP BY 1, 2),
wf AS (SELECT f.osm_id, f.ssp, f.month, f.decade AS decade, f.ensemble_mean, hb.b AS ensemble_mean_historical_baseline, p.burn_probability
       FROM {fx_fwi} f LEFT JOIN {fx_burn} p ON f.osm_id = p.osm_id LEFT JOIN hb ON f.osm_id = hb.osm_id AND f.month = hb.month
       WHERE f.ssp = 585 AND f.decade IN (1990, 2000) AND f.month IN (7, 8))
"""


def group(t: Tables):
    return asset_groups.asset_group("commercial_real_estate", features(t), tags(t)).drop("tags")


def places(t: Tables):
    return admin_geometry(t.fx_admin)


def request(**more) -> Q.AssetQuery:
    base = dict(category="commercial_real_estate", osm_types=["building", "shop", "amenity"], variable="wildfire",
                ssp=585, months=[7, 8], decades=[1990, 2000])
    return Q.AssetQuery(**{**base, **more})


ROWS = f"""
rows AS (SELECT g.osm_id, g.osm_type, g.osm_subtype, g.geom_type, g.x0, g.y0, g.x1, g.y1, county.name AS county, city.name AS city,
              wf.ssp, wf.month, wf.decade AS decade, wf.ensemble_mean, wf.ensemble_mean_historical_baseline, wf.burn_probability
 FROM grp g JOIN {{fx_tags}} tg ON tg.osm_id = g.osm_id JOIN wf ON wf.osm_id = g.osm_id
 LEFT JOIN county ON county.osm_id = g.osm_id LEFT JOIN city ON city.osm_id = g.osm_id
 WHERE g.osm_type IN ('building', 'shop', 'amenity'))
"""
BASE = f"WITH {GROUP}, {NAMES}, {HAZARD}, {ROWS}"


def rows(t: Tables, q: Q.AssetQuery | None = None):
    return Q.asset_query(q or request(), group(t), tags(t), places(t), hazards.wildfire(t.fx_fwi, t.fx_burn))


SHOWN = ["osm_id", "osm_type", "county", "city", "ssp", "month", "decade", "ensemble_mean",
         "ensemble_mean_historical_baseline", "burn_probability"]
SHOWN_SQL = ", ".join("decade AS decade" if c == "decade" else c for c in SHOWN)


@check("asset_query", BASE + f"SELECT {SHOWN_SQL} FROM rows")
def asset_query(t: Tables):
    return rows(t).select(*SHOWN)


@check("asset_query_filtered", BASE + f"""
SELECT osm_id, osm_type, osm_subtype, county, city, month, decade AS decade FROM rows a
WHERE osm_subtype IN ('sub1', 'sub2') AND geom_type = 'ST_Polygon' AND month = 7 AND a.x0 <= -117e0 AND a.x1 >= -123e0 AND a.y0 <= 21e0 AND a.y1 >= 20e0
""")
def asset_query_filtered(t: Tables):
    q = request(osm_subtypes=["sub1", "sub2"], geom_type="Polygon", months=[7], boxes=[(-123.0, 20.0, -117.0, 21.0)])
    return rows(t, q).select("osm_id", "osm_type", "osm_subtype", "county", "city", "month", "decade")


@check("asset_query_no_hazard", f"""
WITH {GROUP}, {NAMES} SELECT g.osm_id, g.osm_type, county.name AS county, city.name AS city FROM grp g
JOIN {{fx_tags}} tg ON tg.osm_id = g.osm_id LEFT JOIN county ON county.osm_id = g.osm_id LEFT JOIN city ON city.osm_id = g.osm_id
WHERE g.osm_type = 'shop'
""")
def asset_query_no_hazard(t: Tables):
    q = Q.AssetQuery("commercial_real_estate", ["shop"])
    return Q.asset_query(q, group(t), tags(t), places(t)).select("osm_id", "osm_type", "county", "city")


@check("asset_query_limit", BASE + f"""
SELECT osm_id, county, city, decade AS decade, month FROM rows ORDER BY osm_id, county NULLS FIRST, city NULLS FIRST, decade, month LIMIT 50
""")
def asset_query_limit(t: Tables):
    return rows(t, request(limit=50)).select("osm_id", "county", "city", "decade", "month")


@check("asset_query_condensed", BASE + """
SELECT osm_id, ssp, month, decade AS decade, max(ensemble_mean) AS ensemble_mean,
  array_to_string(list_sort(list_distinct(list(coalesce(county, '-')))), ',') AS county,
  array_to_string(list_sort(list_distinct(list(coalesce(city, '-')))), ',') AS city FROM rows GROUP BY 1, 2, 3, 4
""")
def asset_query_condensed(t: Tables):
    def text(c: str):
        return F.array_join(F.array_sort(F.transform(c, lambda v: F.coalesce(v, F.lit("-")))), ",")

    return Q.condense(rows(t)).select("osm_id", "ssp", "month", "decade", "ensemble_mean",
                                      text("county").alias("county"), text("city").alias("city"))


@check("asset_query_condensed_compat", BASE + """
SELECT osm_id, min_by(ensemble_mean, month * 10000 + decade) AS ensemble_mean FROM rows GROUP BY 1
""")
def asset_query_condensed_compat(t: Tables):
    return Q.condense(rows(t), compat=True).select("osm_id", "ensemble_mean")


@check("asset_query_centroid_variant", BASE + """
SELECT DISTINCT osm_id, CASE WHEN geom_type = 'ST_Polygon' THEN 'ST_Point' ELSE geom_type END AS geom_type, county FROM rows
""")
def asset_query_centroid_variant(t: Tables):
    return rows(t, request(centroid=True, admin=("county",))).select("osm_id", "geom_type", "county").distinct()


@check("asset_queries_by_category", f"""
WITH {GROUP}, pg AS ({pick(SQL_GROUPS['power_grid'])})
SELECT g.osm_id, 'commercial_real_estate' AS category FROM grp g JOIN {{fx_tags}} tg ON tg.osm_id = g.osm_id WHERE osm_type = 'shop'
UNION ALL SELECT g.osm_id, 'power_grid' AS category FROM pg g JOIN {{fx_tags}} tg ON tg.osm_id = g.osm_id WHERE g.osm_subtype = 'plant'
""")
def asset_queries_by_category(t: Tables):
    groups = {"commercial_real_estate": group(t),
              "power_grid": asset_groups.asset_group("power_grid", features(t), tags(t)).drop("tags")}
    qs = [Q.AssetQuery("commercial_real_estate", ["shop"], admin=()),
          Q.AssetQuery("power_grid", ["power"], ["plant"], admin=())]
    return Q.asset_queries(qs, groups, tags(t), places(t)).select("osm_id", "category")


@check("geojson_features", """
SELECT osm_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || x0 || ',' || y0 || ']}},"properties":{{"osm_id":' || osm_id || ',"w":' || w || '}}}}' AS feature
FROM {fx_assets} WHERE kind = 'ST_Point'
""")
def geojson_features(t: Tables):
    df = asset_geometry(t.fx_assets.withColumn("width", F.col("w"))).filter("geom_type = 'ST_Point'")
    return Q.features(df.select("osm_id", F.col("width").alias("w"), "geom_type", "parts"))


@check("csv_export_columns", """
SELECT cast(osm_id AS varchar) AS osm_id, 'power' AS osm_type, '' AS geometry_wkt, cast(month AS varchar) AS month,
  cast(decade AS varchar) AS decade, cast(ssp AS varchar) AS ssp, cast(ensemble_mean AS varchar) AS ensemble_mean,
  cast(ensemble_median AS varchar) AS ensemble_median, cast(ensemble_min AS varchar) AS ensemble_min, cast(ensemble_max AS varchar) AS ensemble_max,
  cast(NULL AS varchar) AS ensemble_stddev, cast(NULL AS varchar) AS ensemble_q1, cast(NULL AS varchar) AS ensemble_q3, 'x' AS extra
FROM {fx_fwi}
""")
def csv_export_columns(t: Tables):
    df = t.fx_fwi.select("osm_id", F.lit("power").alias("osm_type"), F.lit("").alias("geometry_wkt"), "month", "decade", "ssp",
                         "ensemble_mean", "ensemble_median", "ensemble_min", "ensemble_max", F.lit("x").alias("extra"))
    return sinks.csv_table(df)


@check("hazard_change_metrics", f"""
WITH {HAZARD.replace("WHERE f.ssp = 585 AND f.decade IN (1990, 2000) AND f.month IN (7, 8)", "")}
SELECT osm_id, month, decade AS decade, ssp, round(ensemble_mean - b, 6) AS change, round((ensemble_mean - b) / nullif(b, 0) * 100e0, 6) AS pct_change,
  CASE WHEN ensemble_mean < 5 THEN 'low' WHEN ensemble_mean < 10 THEN 'moderate' WHEN ensemble_mean < 20 THEN 'high'
       WHEN ensemble_mean < 30 THEN 'very high' ELSE 'extreme' END AS band
FROM (SELECT *, ensemble_mean_historical_baseline AS b FROM wf) q
""")
def hazard_change_metrics(t: Tables):
    from terrahaz.functions.values import FIRE_BANDS, band_label

    df = Q.hazard_change(hazards.wildfire(t.fx_fwi, t.fx_burn)).withColumn(
        "band", band_label(F.col("ensemble_mean"), FIRE_BANDS, "none"))
    return r6(df.select("osm_id", "month", "decade", "ssp", "change", "pct_change", "band"), ["change", "pct_change"])


@check("top_combined_risk", f"""
WITH {HAZARD.replace("WHERE f.ssp = 585 AND f.decade IN (1990, 2000) AND f.month IN (7, 8)", "")}
SELECT osm_id, month, decade AS decade, ssp, ensemble_mean * burn_probability AS risk FROM wf WHERE burn_probability IS NOT NULL
ORDER BY risk DESC, osm_id, month, decade, ssp LIMIT 25
""")
def top_combined_risk(t: Tables):
    return Q.combined_fire_risk(hazards.wildfire(t.fx_fwi, t.fx_burn), 25).select("osm_id", "month", "decade", "ssp", "risk")


@check("ranked_emerging_risk", """
SELECT zone_rank, flood_depth - 200e0 AS q3_change FROM {fx_zones} WHERE coalesce(is_sfha <> 'T', true) AND flood_depth > 200
ORDER BY q3_change DESC, zone_rank LIMIT 20
""")
def ranked_emerging_risk(t: Tables):
    df = t.fx_zones.select("zone_rank", "is_sfha", F.col("flood_depth").alias("ensemble_q3"),
                           F.lit(200.0).alias("ensemble_q3_historical_baseline"))
    return Q.ranked_flood_risk(df, "emerging", 20, ("zone_rank",)).select("zone_rank", "q3_change")


@check("flood_risk_classes", """
SELECT fld_ar_id, zone_rank, CASE WHEN is_sfha = 'T' AND d > 0 THEN 'compounding' WHEN is_sfha <> 'T' AND d > 0 THEN 'emerging' ELSE 'stable' END AS risk_class
FROM (SELECT *, flood_depth - 200e0 AS d FROM {fx_zones}) q
""")
def flood_risk_classes(t: Tables):
    df = t.fx_zones.select("fld_ar_id", "zone_rank", "is_sfha", F.col("flood_depth").alias("ensemble_q3"),
                           F.lit(200.0).alias("ensemble_q3_historical_baseline"))
    return Q.flood_risk_class(df).select("fld_ar_id", "zone_rank", "risk_class")


# ------------------------------------------------------------------ file rules

NAME = """
SELECT DISTINCT CASE l_linenumber % 2 WHEN 0 THEN 'pr' ELSE 'prcp' END || '_day_M' || l_suppkey % 12 || '_ssp245_r1i1p1f1_gn_'
   || (2000 + l_partkey % 50) || CASE WHEN l_linenumber = 1 THEN '_v1.1' WHEN l_linenumber = 3 THEN '_v1.0' ELSE '' END
   || CASE WHEN l_linenumber = 7 THEN '.txt' ELSE '.nc' END AS name FROM {lineitem}
"""


@check("best_version_files", f"""
SELECT variable, model, scenario, member, year, name FROM (
 SELECT *, row_number() OVER (PARTITION BY model, scenario, member, year
   ORDER BY CASE variable WHEN 'prcp' THEN 1 ELSE 2 END, CASE WHEN contains(name, '_v1.1') THEN 0 ELSE 1 END, name) AS rn
 FROM (SELECT name, split_part(name, '_', 1) AS variable, split_part(name, '_', 3) AS model, split_part(name, '_', 4) AS scenario,
         split_part(name, '_', 5) AS member, cast(substr(split_part(name, '_', 7), 1, 4) AS int) AS year
       FROM ({NAME}) n WHERE name LIKE '%.nc') p) q WHERE rn = 1
""")
def best_version_files(t: Tables):
    return files.pick_files(t.sql(NAME), ["prcp", "pr"])


STORE = """
SELECT DISTINCT 'b/NEX-GDDP-CMIP6/' || CASE l_suppkey % 12 WHEN 3 THEN 'ENSEMBLE' ELSE 'M' || l_suppkey % 12 END || '/ssp245/r1/pr_'
       || (2015 + l_partkey % (86 + l_suppkey % 12 % 2)) || '-' || (2044 + l_partkey % 7) || '.zarr' AS path,
       'M' || l_suppkey % 12 AS model, CASE WHEN l_suppkey % 12 = 5 THEN 'ssp585' ELSE 'ssp245' END AS scenario,
       cast(2015 + l_partkey % (86 + l_suppkey % 12 % 2) AS int) AS year FROM {lineitem}
"""


@check("valid_ensemble_models", f"""
WITH s AS (SELECT * FROM ({STORE}) a WHERE NOT contains(path, 'ENSEMBLE') AND scenario = 'ssp245'),
ok AS (SELECT model FROM s GROUP BY model HAVING list_sort(list(DISTINCT year)) = range(2015, 2101) OR list_sort(list(DISTINCT year)) = range(1950, 2015))
SELECT path, model, scenario, year FROM s WHERE model IN (SELECT model FROM ok)
""")
def valid_ensemble_models(t: Tables):
    return files.valid_models(t.sql(STORE), "ssp245").select("path", "model", "scenario", "year")


@check("store_path_metadata", f"""
SELECT path, split_part(path, '/', 3) AS model, split_part(path, '/', 4) AS scenario, split_part(path, '/', 5) AS member,
  cast(regexp_extract(path, '_([0-9]{{{{4}}}})-([0-9]{{{{4}}}})', 1) AS int) AS start_year, cast(regexp_extract(path, '_([0-9]{{{{4}}}})-([0-9]{{{{4}}}})', 2) AS int) AS end_year
FROM ({STORE}) a
""")
def store_path_metadata(t: Tables):
    return files.store_metadata(t.sql(STORE).select("path"))


@check("file_name_dates", """
SELECT o_orderkey, cast(o_orderdate AS date) AS grid_date, CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderdate AS date) END AS lomr FROM {orders}
""")
def file_name_dates(t: Tables):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    bad = F.pmod("o_orderkey", F.lit(5)) == 0
    return t.orders.select(
        "o_orderkey", files.name_date(F.concat(F.lit("fwi.v2."), day, F.lit(".nc"))).alias("grid_date"),
        files.effective_date(F.concat(F.lit("53061C_"), F.when(bad, "20221399").otherwise(day), F.lit(".zip"))).alias("lomr"))


@check("download_url_order", """
SELECT url, area_code FROM (SELECT DISTINCT 'http://x/Download?DFIRMID=' || o_custkey % 90 || 'C_' || o_custkey || '&state='
   || CASE o_orderstatus WHEN 'F' THEN 'WASHINGTON' WHEN 'O' THEN 'Washington' ELSE 'OREGON' END AS url,
   cast(o_custkey AS bigint) AS area_code, o_orderstatus AS s FROM {orders}) q WHERE s <> 'P'
""")
def download_url_order(t: Tables):
    urls = t.sql("""SELECT 'http://x/Download?DFIRMID=' || o_custkey % 90 || 'C_' || o_custkey || '&state='
      || CASE o_orderstatus WHEN 'F' THEN 'WASHINGTON' WHEN 'O' THEN 'Washington' ELSE 'OREGON' END AS url FROM {orders}""")
    return files.download_urls(urls, "WASHINGTON")


RAW_ZONES = """
SELECT o_orderpriority AS DFIRM_ID, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS FLD_AR_ID, o_orderstatus AS FLD_ZONE,
       cast(o_orderdate AS date) AS lomr, o_orderkey FROM {orders}
"""


@check("flood_zone_projection", f"""
SELECT DFIRM_ID AS dfirm_id, FLD_AR_ID AS fld_ar_id, cast(NULL AS varchar) AS version_id, FLD_ZONE AS flood_zone,
  cast(NULL AS varchar) AS flood_zone_subtype, cast(NULL AS varchar) AS is_sfha, cast(NULL AS double) AS static_bfe,
  cast(NULL AS double) AS flood_depth, lomr AS lomr_effective_date, 'u' || o_orderkey AS source_url FROM ({RAW_ZONES}) r
""")
def flood_zone_projection(t: Tables):
    raw = t.sql(RAW_ZONES)
    return files.project_zones(raw, F.concat(F.lit("u"), F.col("o_orderkey").cast("string")), F.col("lomr"))


@check("flood_zone_load", f"""
SELECT dfirm_id, fld_ar_id, flood_zone, lomr_effective_date, min(source_url) AS source_url FROM (
 SELECT DFIRM_ID AS dfirm_id, FLD_AR_ID AS fld_ar_id, FLD_ZONE AS flood_zone, lomr AS lomr_effective_date, 'u' || o_orderkey AS source_url
 FROM ({RAW_ZONES}) r WHERE FLD_AR_ID IS NOT NULL) q
WHERE NOT EXISTS (SELECT 1 FROM ({RAW_ZONES}) h WHERE year(h.lomr) = 1996 AND h.FLD_AR_ID = q.fld_ar_id AND h.DFIRM_ID = q.dfirm_id
  AND h.FLD_ZONE = q.flood_zone AND h.lomr = q.lomr_effective_date)
GROUP BY 1, 2, 3, 4
""")
def flood_zone_load(t: Tables):
    raw = files.project_zones(t.sql(RAW_ZONES), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")), F.col("lomr"))
    held = raw.filter(F.year("lomr_effective_date") == 1996)
    return jobs.load_zones(raw, held).select("dfirm_id", "fld_ar_id", "flood_zone", "lomr_effective_date", "source_url")


@check("income_rows", """
SELECT cast(2000 + o_custkey % 30 AS int) AS year, cast(o_custkey AS varchar) AS zipcode, cast(o_orderkey AS double) AS returns, o_totalprice AS agi
FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
""")
def income_rows(t: Tables):
    raw = t.orders.select(
        F.col("o_orderstatus").alias("state"), F.col("o_custkey").cast("string").alias("zipcode"),
        F.col("o_orderkey").cast("double").alias("returns"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("agi"),
        F.concat(F.lpad(F.pmod("o_custkey", F.lit(30)).cast("string"), 2, "0"), F.lit("zpallagi.csv")).alias("file"))
    return files.income_rows(raw, "F")


@check("pending_outputs", """
SELECT DISTINCT model, scenario, cast(year(date) AS int) AS year FROM {fx_grid} g WHERE NOT EXISTS (
  SELECT 1 FROM {fx_grid} w WHERE w.model = g.model AND w.scenario = g.scenario AND year(w.date) = year(g.date) AND w.model < 'M5' AND year(w.date) < 1999)
""")
def pending_outputs(t: Tables):
    expected = t.fx_grid.select("model", "scenario", F.year("date").cast("int").alias("year")).distinct()
    written = expected.filter("model < 'M5' AND year < 1999")
    return files.pending(expected, written, ["model", "scenario", "year"])


@check("region_registry", """
SELECT osm_id, CASE WHEN x0 BETWEEN -126.1 AND -114 AND y0 + 25 BETWEEN 44.4 AND 49.5 THEN 'washington'
   WHEN x0 BETWEEN -124.4 AND -114.1 AND y0 + 25 BETWEEN 32.5 AND 42 THEN 'california'
   WHEN x0 BETWEEN -124.6 AND -116.5 AND y0 + 25 BETWEEN 42 AND 46.3 THEN 'oregon' END AS region FROM {fx_assets}
""")
def region_registry(t: Tables):
    return t.fx_assets.select("osm_id", registry.region_of(F.col("x0"), F.col("y0") + 25.0).alias("region"))


@check("usable_models", """
SELECT DISTINCT model FROM {fx_grid} WHERE scenario = 'ssp245' AND model <> 'M3'
""")
def usable_models(t: Tables):
    models = t.fx_grid.groupBy("model").agg(F.collect_set("scenario").alias("scenarios")).withColumn(
        "use", F.col("model") != "M3")
    return registry.usable_models(models, "ssp245").select("model")


@check("metadata_lookup", """
SELECT DISTINCT 'n' || decade AS metadata FROM {fx_fwi} WHERE ssp = 585
""")
def metadata_lookup(t: Tables):
    table = t.fx_fwi.select(F.lit("fwi").alias("variable"), "ssp", F.concat(F.lit("n"), F.col("decade").cast("string")).alias("metadata"))
    return Q.metadata_lookup(table, "fwi", 585)


# ------------------------------------------------------------------------ jobs

EXPOSURE = f"""
WITH {KEYED},
small AS (SELECT *, kind = 'ST_Polygon' AND radians(x1 - x0) * (sin(radians(y1)) - sin(radians(y0))) * 6371.0072e0 * 6371.0072e0 < 20e0 AS tiny FROM {{fx_assets}}),
pts AS (SELECT osm_id, CASE WHEN tiny THEN (x0 + x1) / 2e0 ELSE x0 END AS lon, CASE WHEN tiny THEN (y0 + y1) / 2e0 ELSE y0 END AS lat FROM small WHERE kind = 'ST_Point' OR tiny
  UNION ALL SELECT osm_id, x0, y0 FROM small WHERE kind = 'ST_LineString' UNION ALL SELECT osm_id, x1, y0 FROM small WHERE kind = 'ST_LineString'
  UNION ALL SELECT osm_id, x1, y1 FROM small WHERE kind = 'ST_LineString'),
loc AS (SELECT osm_id, {CELL_SQL.format(lon='lon', lat='lat', last=LAST)} FROM pts),
cells AS (
  SELECT a.osm_id, c.ix, c.iy, (least(a.x1, -125e0 + (c.ix + 0.5e0) * 0.25e0) - greatest(a.x0, -125e0 + (c.ix - 0.5e0) * 0.25e0))
    * (least(a.y1, 20e0 + (c.iy + 0.5e0) * 0.25e0) - greatest(a.y0, 20e0 + (c.iy - 0.5e0) * 0.25e0)) AS w
  FROM small a JOIN (SELECT DISTINCT ix, iy FROM keyed) c ON a.x0 < -125e0 + (c.ix + 0.5e0) * 0.25e0 AND a.x1 > -125e0 + (c.ix - 0.5e0) * 0.25e0
   AND a.y0 < 20e0 + (c.iy + 0.5e0) * 0.25e0 AND a.y1 > 20e0 + (c.iy - 0.5e0) * 0.25e0 WHERE a.kind = 'ST_Polygon' AND NOT tiny),
e AS (SELECT loc.osm_id, k.decade AS decade, k.month, avg(ensemble_mean) AS ensemble_mean, min(ensemble_min) AS ensemble_min, max(ensemble_max) AS ensemble_max
        FROM loc JOIN keyed k ON k.ix = loc.ix AND k.iy = loc.iy GROUP BY ALL
      UNION ALL SELECT c.osm_id, k.decade AS decade, k.month, max(ensemble_mean), max(ensemble_min), max(ensemble_max)
        FROM cells c JOIN keyed k ON k.ix = c.ix AND k.iy = c.iy WHERE w > 1e-12 GROUP BY ALL)
"""


def _exposure(t: Tables):
    spec = E.ExposureSpec("pr", "ssp245", spec_for(t), method="max", attrs={"title": "ensemble"})
    return E.exposure(t.fx_ensemble, asset_geometry(t.fx_assets), spec)


@check("exposure_job", EXPOSURE + """
SELECT osm_id, month, decade AS decade, cast(245 AS int) AS ssp, round_even(ensemble_min, 2) AS ensemble_min, round_even(ensemble_max, 2) AS ensemble_max,
  '{{"title":"ensemble","zonal_method":"max"}}' AS metadata FROM e
""")
def exposure_job(t: Tables):
    return _exposure(t).select("osm_id", "month", "decade", "ssp", "ensemble_min", "ensemble_max", "metadata")


@check("exposure_rows_per_asset", EXPOSURE + "SELECT osm_id, count(*) AS n FROM e GROUP BY osm_id")
def exposure_rows_per_asset(t: Tables):
    return _exposure(t).groupBy("osm_id").agg(F.count(F.lit(1)).alias("n"))


@check("burn_exposure", f"""
WITH {KEYED}, g AS (SELECT ix, iy, max(ensemble_max) / 64e0 AS p FROM keyed GROUP BY 1, 2),
pts AS (SELECT osm_id, {CELL_SQL.format(lon='x0', lat='y0', last=LAST)} FROM {{fx_assets}})
SELECT osm_id, p AS burn_probability FROM pts JOIN g ON g.ix = pts.ix AND g.iy = pts.iy
""")
def burn_exposure(t: Tables):
    grid = t.fx_ensemble.groupBy("lat", "lon").agg((F.max("ensemble_max") / 64.0).alias("burn_probability"))
    points = geo.with_point(t.fx_assets.select("osm_id", "x0", "y0"), F.col("x0"), F.col("y0"))
    return E.burn_exposure(grid, points, spec_for(t))


@check("burn_grid_job", """
SELECT (((m.lon % 360e0) + 360e0) % 360e0) AS lon, m.lat AS lat, m.burn_probability FROM (
 SELECT (min(lon) + max(lon)) / 2e0 AS lon, (min(lat) + max(lat)) / 2e0 AS lat, max(p) AS burn_probability FROM (
  SELECT lon, lat, max(pr) - 40e0 AS p FROM {fx_grid} GROUP BY 1, 2) r GROUP BY floor(lon), floor(lat)) m WHERE m.burn_probability > 0
""")
def burn_grid_job(t: Tables):
    raster = t.fx_grid.groupBy("lat", "lon").agg((F.max("pr") - 40.0).alias("burn_probability")).withColumns(
        {"x": F.col("lon"), "y": F.col("lat")})
    return jobs.burn_grid(raster, 1.0)


@check("future_burn_grid", """
WITH m AS (SELECT lat, lon, cast(month(date) AS int) AS month, max(tasmax) AS f1, min(tasmin) + 10e0 AS f0 FROM {fx_grid} GROUP BY 1, 2, 3)
SELECT lat, lon, month, round(least(greatest(0.25e0 * (1e0 + (f1 - f0) / nullif(f1, 0)), 0e0), 1e0), 6) AS burn_probability FROM m WHERE month BETWEEN 5 AND 10
""")
def future_burn_grid(t: Tables):
    month = F.month("date").cast("int").alias("month")
    now = t.fx_grid.groupBy("lat", "lon", month).agg((F.min("tasmin") + 10.0).alias("fwi"))
    later = t.fx_grid.groupBy("lat", "lon", month).agg(F.max("tasmax").alias("fwi"))
    burn = t.fx_grid.select("lat", "lon").distinct().withColumn("burn_probability", F.lit(0.25))
    return r6(jobs.future_burn_grid(burn, now, later), ["burn_probability"])


def _fires(t: Tables):
    """Zones as burnt areas: one event per order."""
    z = zone_geometry(t.fx_zones).join(
        t.orders.select(F.col("o_orderkey").alias("zone_rank"), F.col("o_orderdate").cast("date").alias("ignition_date"),
                        F.col("o_orderpriority").alias("prio")), "zone_rank")
    return z.select(
        F.concat(F.lit("WA"), F.col("zone_rank").cast("string")).alias("event_id"),
        F.when(F.col("prio") == "1-URGENT", "Prescribed").otherwise("Wildfire").alias("incident_type"),
        "ignition_date", *S.GEOMETRY_COLUMNS)


FIRE_SQL = """
fire AS (SELECT 'WA' || z.zone_rank AS event_id, cast(o.o_orderdate AS date) AS ignition_date, z.xmin, z.ymin, z.xmax, z.ymax FROM {fx_zones} z
  JOIN {orders} o ON o.o_orderkey = z.zone_rank WHERE o.o_orderpriority <> '1-URGENT' AND year(o.o_orderdate) = 1998),
cellw AS (SELECT f.event_id, f.ignition_date, c.lat, c.lon, (least(f.xmax, c.lon + 0.125e0) - greatest(f.xmin, c.lon - 0.125e0))
     * (least(f.ymax, c.lat + 0.125e0) - greatest(f.ymin, c.lat - 0.125e0)) AS w
   FROM fire f JOIN (SELECT DISTINCT lat, lon FROM {fx_grid}) c ON f.xmin < c.lon + 0.125e0 AND f.xmax > c.lon - 0.125e0
     AND f.ymin < c.lat + 0.125e0 AND f.ymax > c.lat - 0.125e0)
"""


@check("utility_fire_metrics", f"""
WITH {FIRE_SQL},
sev AS (SELECT lat, lon, CASE WHEN s BETWEEN 2 AND 4 THEN s END AS s FROM (SELECT lat, lon, cast(min(sfcwind) / 3e0 + (lon * 4) % 3 + 3 AS double) AS s FROM {{fx_grid}} GROUP BY 1, 2) q),
sm AS (SELECT event_id, sum(s * w) / sum(CASE WHEN s IS NOT NULL THEN w END) AS m, max(s) AS x FROM cellw JOIN sev USING (lat, lon) WHERE w > 1e-12 GROUP BY 1),
day AS (SELECT lat, lon, date, max(pr) AS fwi FROM {{fx_grid}} GROUP BY 1, 2, 3),
fm AS (SELECT c.event_id, sum(d.fwi * w) / sum(w) AS m, max(d.fwi) AS x FROM cellw c JOIN day d ON d.lat = c.lat AND d.lon = c.lon AND d.date = c.ignition_date WHERE w > 1e-12 GROUP BY 1)
SELECT u.admin_id AS utility_id, f.event_id, f.ignition_date, round(fm.m, 6) AS fwi_mean, fm.x AS fwi_max, round(sm.m, 6) AS severity_mean, sm.x AS severity_max
FROM {{fx_admin}} u JOIN fire f ON u.xmin <= f.xmax AND f.xmin <= u.xmax AND u.ymin <= f.ymax AND f.ymin <= u.ymax
LEFT JOIN fm ON fm.event_id = f.event_id LEFT JOIN sm ON sm.event_id = f.event_id WHERE sm.m IS NOT NULL
""")
def utility_fire_metrics(t: Tables):
    spec = spec_for(t)
    severity = t.fx_grid.groupBy("lat", "lon").agg(F.min("sfcwind").alias("s")).select(
        "lat", "lon", (F.col("s") / 3.0 + (F.col("lon") * 4) % 3 + 3).alias("severity"))
    weather = t.fx_grid.groupBy("lat", "lon", "date").agg(F.max("pr").alias("fwi"))
    areas = admin_geometry(t.fx_admin).withColumnRenamed("admin_id", "utility_id")
    out = jobs.utility_fire_metrics(areas, _fires(t), severity, weather, spec, spec, 1998, "wa")
    return r6(out, ["fwi_mean", "severity_mean"])


@check("utility_income", """
WITH z AS (SELECT * FROM {fx_zones} WHERE xmin <= -116e0 AND xmax >= -124e0 AND ymin <= 60e0 AND ymax >= 20e0),
s AS (SELECT a.zone_rank, b.admin_id, greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0e0)
   * (sin(radians(least(a.ymax, b.ymax))) - sin(radians(greatest(a.ymin, b.ymin)))) / ((a.xmax - a.xmin) * (sin(radians(a.ymax)) - sin(radians(a.ymin)))) AS share
  FROM z a JOIN {fx_admin} b ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)
SELECT s.admin_id AS utility_id, i.year, round(sum(i.agi * 1000e0 * s.share) / sum(i.returns * s.share), 3) AS income_per_return
FROM (SELECT o_orderkey AS zone_rank, cast(year(o_orderdate) AS int) AS year, o_totalprice AS agi, 1e0 + o_custkey % 7 AS returns FROM {orders}) i
JOIN s ON s.zone_rank = i.zone_rank WHERE s.share > 0 GROUP BY 1, 2
""")
def utility_income(t: Tables):
    zips = zone_geometry(t.fx_zones).withColumnRenamed("zone_rank", "zipcode")
    utilities = admin_geometry(t.fx_admin).withColumnRenamed("admin_id", "utility_id")
    income = t.orders.select(
        F.col("o_orderkey").alias("zipcode"), F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_totalprice").alias("agi"), (F.lit(1.0) + F.pmod("o_custkey", F.lit(7))).alias("returns"))
    return r6(jobs.utility_income(income, zips, utilities, (-124.0, 20.0, -116.0, 60.0)), ["income_per_return"], 3)


NEAR = haversine('a.x0', 'a.y0', 's.lon', 's.lat')


@check("facility_exposure", f"""
WITH {KEYED}, g AS (SELECT ix, iy, max(ensemble_max) / 64e0 AS p FROM keyed GROUP BY 1, 2),
pts AS (SELECT osm_id, {CELL_SQL.format(lon='x0', lat='y0', last=LAST)} FROM {{fx_assets}}),
near AS (SELECT osm_id, station_id, d FROM (SELECT a.osm_id, s.station_id, {NEAR} AS d, row_number() OVER (PARTITION BY a.osm_id ORDER BY {NEAR}, s.station_id) AS rn
   FROM {{fx_assets}} a CROSS JOIN {{fx_stations}} s) q WHERE rn = 1),
cnt AS (SELECT a.osm_id, count(CASE WHEN {NEAR} <= 5 THEN 1 END) AS c5, count(CASE WHEN {NEAR} <= 25 THEN 1 END) AS c25 FROM {{fx_assets}} a
   JOIN {{fx_stations}} s ON abs(s.lat - a.y0) < 0.5e0 AND abs(s.lon - a.x0) < 1e0 GROUP BY 1),
fut AS (SELECT lat, lon, month, max(ensemble_min) / 64e0 AS p FROM {{fx_ensemble}} GROUP BY 1, 2, 3),
rad AS (SELECT a.osm_id, s.month, coalesce(max(CASE WHEN {NEAR} <= 5 THEN s.p END), 0e0) AS m5, coalesce(max(CASE WHEN {NEAR} <= 25 THEN s.p END), 0e0) AS m25
   FROM {{fx_assets}} a JOIN fut s ON abs(s.lat - a.y0) < 0.5e0 AND abs(s.lon - a.x0) < 1e0 WHERE {NEAR} <= 25 GROUP BY 1, 2)
SELECT a.osm_id, near.station_id AS nearest_station_id, round(near.d, 6) AS station_miles, near.station_id AS nearest_substation_id, round(near.d, 6) AS substation_miles, coalesce(cnt.c5, 0) AS count_5mi,
  coalesce(cnt.c25, 0) AS count_25mi, coalesce(g.p, 0e0) AS burn_probability, rad.month, coalesce(rad.m5, 0e0) AS burn_probability_max_5mi, coalesce(rad.m25, 0e0) AS burn_probability_max_25mi
FROM {{fx_assets}} a LEFT JOIN near ON near.osm_id = a.osm_id LEFT JOIN cnt ON cnt.osm_id = a.osm_id
LEFT JOIN pts ON pts.osm_id = a.osm_id LEFT JOIN g ON g.ix = pts.ix AND g.iy = pts.iy LEFT JOIN rad ON rad.osm_id = a.osm_id
""")
def facility_exposure(t: Tables):
    burn = t.fx_ensemble.groupBy("lat", "lon").agg((F.max("ensemble_max") / 64.0).alias("burn_probability"))
    future = t.fx_ensemble.groupBy("lat", "lon", "month").agg((F.max("ensemble_min") / 64.0).alias("burn_probability"))
    facilities = t.fx_assets.select("osm_id", F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    subs = t.fx_stations.withColumnRenamed("station_id", "substation_id")
    out = jobs.facility_exposure(facilities, burn, spec_for(t), t.fx_stations, subs, future, (5, 25))
    return r6(out.select(
        "osm_id", "nearest_station_id", "station_miles", "nearest_substation_id", "substation_miles", "count_5mi", "count_25mi",
        "burn_probability", "month", "burn_probability_max_5mi", "burn_probability_max_25mi"), ["station_miles", "substation_miles"])


@check("line_asset_report", f"""
WITH {KEYED}, v AS (
  SELECT osm_id, x0 AS lon, y0 AS lat FROM {{fx_assets}} WHERE kind = 'ST_LineString' UNION SELECT osm_id, x1, y0 FROM {{fx_assets}} WHERE kind = 'ST_LineString'
  UNION SELECT osm_id, x1, y1 FROM {{fx_assets}} WHERE kind = 'ST_LineString'),
near AS (SELECT DISTINCT osm_id FROM v WHERE {haversine('v.lon', 'v.lat', '-120e0', '20.5e0')} <= 100),
p AS (SELECT osm_id, {CELL_SQL.format(lon='lon', lat='lat', last=LAST)} FROM v WHERE osm_id IN (SELECT osm_id FROM near)),
b AS (SELECT ix, iy, max(ensemble_max) / 64e0 AS q FROM keyed GROUP BY 1, 2),
pm AS (SELECT osm_id, max(q) AS q FROM p JOIN b ON b.ix = p.ix AND b.iy = p.iy GROUP BY 1),
fw AS (SELECT osm_id, k.decade AS decade, k.month, avg(ensemble_mean) AS m FROM p JOIN keyed k ON k.ix = p.ix AND k.iy = p.iy GROUP BY ALL),
mid AS (SELECT a.osm_id, (w * (x0 + x1) / 2e0 + h * x1) / (w + h) AS mx, (w * y0 + h * (y0 + y1) / 2e0) / (w + h) AS my
        FROM {{fx_assets}} a WHERE osm_id IN (SELECT osm_id FROM near)),
fire AS (SELECT osm_id, station_id, d FROM (
  SELECT osm_id, station_id, d, row_number() OVER (PARTITION BY osm_id ORDER BY d, station_id) AS rn FROM (
    SELECT mid.osm_id, s.station_id, {haversine('mid.mx', 'mid.my', 's.lon', 's.lat')} AS d FROM mid CROSS JOIN {{fx_stations}} s
    WHERE s.station_id % 4 <> 1) q) r WHERE rn = 1)
SELECT n.osm_id, pm.q AS burn_probability, fw.decade AS decade, fw.month, round(fw.m, 6) AS ensemble_mean,
  fire.station_id AS nearest_fire_id, round(fire.d, 6) AS distance_miles
FROM near n LEFT JOIN pm ON pm.osm_id = n.osm_id LEFT JOIN fw ON fw.osm_id = n.osm_id LEFT JOIN fire ON fire.osm_id = n.osm_id
""")
def line_asset_report(t: Tables):
    burn = t.fx_ensemble.groupBy("lat", "lon").agg((F.max("ensemble_max") / 64.0).alias("burn_probability"))
    lines = asset_geometry(t.fx_assets).select("osm_id", *S.GEOMETRY_COLUMNS)
    fires = t.fx_stations.withColumnRenamed("station_id", "fire_id").withColumn(
        "ignition_date", F.when(F.pmod("fire_id", F.lit(4)) == 1, "2004-07-01").otherwise("1999-07-01").cast("date"))
    out = jobs.line_asset_report(
        lines, (-120.0, 20.5), 100, burn, spec_for(t),
        t.fx_ensemble.select("lon", "lat", "decade", "month", "ensemble_mean"), spec_for(t), fires, "2000-01-01")
    return r6(out.select("osm_id", "burn_probability", "decade", "month", "ensemble_mean", "nearest_fire_id", "distance_miles"),
              ["ensemble_mean", "distance_miles"])
