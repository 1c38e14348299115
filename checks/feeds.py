"""Streaming jobs drained over a driver table, and the indicator job."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.groups import SQL_GROUPS, pick
from checks.harness import Tables, check
from checks.recurrence import codes_sql
from checks.rounding import r6
from checks.requests import EXPOSURE, features, tags
from checks.shapes import asset_geometry
from checks.shapes_ops import spec_for
from terrahaz.functions.values import STATISTICS
from terrahaz.operators import climate as C
from terrahaz.operators import exposure as E
from terrahaz.operators import indicators as I
from terrahaz.plans import asset_groups, asset_query as Q
from terrahaz.streaming import feeds


def _lineitem_stream(t: Tables):
    return t.spark.readStream.schema(t.lineitem.schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.sf_dir)


@check("stream_monthly_mean", """
SELECT l_suppkey AS cell, cast(date_trunc('month', l_shipdate) AS date) AS month_start, round(avg(l_quantity), 6) AS pr FROM {lineitem} GROUP BY 1, 2
""")
def stream_monthly_mean(t: Tables):
    """The months the stream closed by its watermark, and those open when the feed ended."""
    def readings(rows):
        return rows.select(F.col("l_suppkey").alias("cell"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("pr"))

    closed = feeds.drain_to_table(feeds.monthly_stream(readings(_lineitem_stream(t)), ["cell"], "pr"), feeds.shared_folder(t.spark, "monthly"))
    out = closed.unionByName(feeds.closing_months(readings(t.lineitem), closed, ["cell"], "pr"))
    return r6(out.withColumn("month_start", F.col("month_start").cast("date")), ["pr"])


FEED = """
SELECT 'm' AS model, lat, lon, date, tasmax, pr, hurs, sfcwind FROM (
 SELECT *, row_number() OVER (PARTITION BY lat, lon, date ORDER BY tasmax, pr, hurs, sfcwind) AS k FROM (
  SELECT floor(l_suppkey / 40) * 0.25e0 + 20e0 AS lat, (l_suppkey % 40) * 0.25e0 - 125e0 AS lon, cast(l_shipdate AS date) AS date,
    cast(cast(floor(l_extendedprice) AS bigint) % 30 + 10 AS double) AS tasmax, l_quantity AS pr,
    l_linenumber * 12e0 AS hurs, l_linenumber * 3e0 AS sfcwind FROM {lineitem}) a) b WHERE k = 1
"""


@check("stream_fire_weather", "WITH RECURSIVE " + codes_sql("model, lat, lon", FEED) + """
SELECT model, lat, lon, date, round(ffmc, 5) AS ffmc, round(dmc, 5) AS dmc, round(dc, 5) AS dc FROM codes WHERE rn > 0
""")
def stream_fire_weather(t: Tables):
    feed = _lineitem_stream(t).select(
        F.lit("m").alias("model"), F.lit("ssp245").alias("scenario"), F.lit("r1").alias("member"),
        (F.floor(F.col("l_suppkey") / 40) * 0.25 + 20.0).alias("lat"),
        (F.pmod("l_suppkey", F.lit(40)) * 0.25 - 125.0).alias("lon"), F.col("l_shipdate").cast("date").alias("date"),
        (F.pmod(F.floor("l_extendedprice"), F.lit(30)) + 10).cast("double").alias("tasmax"),
        F.col("l_quantity").alias("pr"), (F.col("l_linenumber") * 12.0).alias("hurs"),
        (F.col("l_linenumber") * 3.0).alias("sfcwind"))
    out = feeds.drain_to_table(feeds.fwi_stream(feed), feeds.shared_folder(t.spark, "fwi"))
    return r6(out.select("model", "lat", "lon", "date", "ffmc", "dmc", "dc"), ["ffmc", "dmc", "dc"], 5)


@check("stream_asset_exposure", EXPOSURE + """
SELECT osm_id, month, decade AS decade, cast(245 AS int) AS ssp, round_even(ensemble_min, 2) AS ensemble_min, round_even(ensemble_max, 2) AS ensemble_max
FROM e
""")
def stream_asset_exposure(t: Tables):
    """Customers arrive as a stream; each batch of new assets runs the whole exposure plan."""
    stream = t.spark.readStream.schema(t.customer.schema).option("pathGlobFilter", "customer.parquet").parquet(t.sf_dir)
    folder = feeds.shared_folder(t.spark, "exposure")
    spec = E.ExposureSpec("pr", "ssp245", spec_for(t), method="max", attrs={"title": "ensemble"})
    keys = ["osm_id", "month", "decade", "ssp"]

    def expose(batch):
        assets = asset_geometry(t.fx_assets.join(batch.select("osm_id"), "osm_id", "left_semi"))
        return E.exposure(t.fx_ensemble, assets, spec).select(*keys, "ensemble_min", "ensemble_max")

    query = feeds.exposure_stream(stream.select(F.col("c_custkey").alias("osm_id")), f"{folder}/table", expose, keys)
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("osm_id bigint, month int, decade int, ssp int, ensemble_min double, ensemble_max double").parquet(f"{folder}/table")


@check("indicator_job", """
WITH base AS (SELECT model, lat, lon, dayofyear(date) AS doy, avg(pr) AS b FROM {fx_grid} WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY 1, 2, 3, 4)
SELECT 'pr_percent_change' AS indicator, g.model, g.scenario, g.member, g.lat, g.lon, cast(date_trunc('month', g.date) AS date) AS month_start,
       round(avg((g.pr - b) / nullif(b, 0) * 100e0), 6) AS value
FROM {fx_grid} g LEFT JOIN base ON base.model = g.model AND base.lat = g.lat AND base.lon = g.lon AND base.doy = dayofyear(g.date)
WHERE NOT (g.model = 'M7' AND year(g.date) = 1997)
GROUP BY 2, 3, 4, 5, 6, 7
""")
def indicator_job(t: Tables):
    written = t.fx_grid.filter("model = 'M7' AND year(date) = 1997").select(
        F.lit("pr_percent_change").alias("indicator"), "model", "scenario", "member", F.year("date").alias("year")).distinct()
    out = I.monthly_indicators(t.fx_grid, ["pr_percent_change"],
                               {"base_years": (1995, 1998), "historical": t.fx_grid}, written)
    return r6(out, ["value"])


SERIES = "model, scenario, member, lat, lon"


@check("indicator_job_state", "WITH RECURSIVE " + codes_sql(SERIES, f"SELECT {SERIES}, date, tasmax, pr, hurs, sfcwind FROM {{fx_grid}}") + f"""
SELECT indicator, {SERIES}, month_start, round(avg(value), 5) AS value FROM (
  SELECT {SERIES}, cast(date_trunc('month', date) AS date) AS month_start, unnest(['ffmc', 'dmc', 'dc']) AS indicator, unnest([ffmc, dmc, dc]) AS value
  FROM codes WHERE rn > 0 AND year(date) IN (1993, 1996, 1997)) c GROUP BY ALL
""")
def indicator_job_state(t: Tables):
    """Fire weather of years 1993, 1996 and 1997, the others being written: each run starts from the store's year before it."""
    keys = [*C.SERIES, "lat", "lon"]
    store = C.last_state(C.moisture_codes(t.fx_grid), keys).filter("year NOT IN (1993, 1996, 1997)")
    written = t.fx_grid.select(F.lit("fwi").alias("indicator"), *C.SERIES, F.year("date").alias("year")).distinct().filter(
        "year NOT IN (1993, 1996, 1997)")
    out = I.monthly_indicators(t.fx_grid, ["fwi"], {"init": store}, written)
    return r6(out.filter("indicator IN ('ffmc', 'dmc', 'dc')"), ["value"], 5)


@check("ensemble_by_variable", """
WITH long AS (SELECT 'pr' AS variable, lat, lon, scenario, model, pr AS v FROM {fx_grid}
              UNION ALL SELECT 'hurs', lat, lon, scenario, model, hurs FROM {fx_grid}),
m AS (SELECT variable, lat, lon, scenario, model, avg(v) AS v FROM long GROUP BY ALL)
SELECT variable, lat, lon, scenario, round(avg(v), 6) AS ensemble_mean, round(quantile_cont(v, 0.5), 6) AS ensemble_median,
  round(stddev_pop(v), 6) AS ensemble_stddev, round(min(v), 6) AS ensemble_min, round(max(v), 6) AS ensemble_max,
  round(quantile_cont(v, 0.25), 6) AS ensemble_q1, round(quantile_cont(v, 0.75), 6) AS ensemble_q3, cast(count(v) AS int) AS ensemble_count
FROM m GROUP BY ALL
""")
def ensemble_by_variable(t: Tables):
    out = I.ensemble_by_variable(t.fx_grid, ["pr", "hurs"], ["lat", "lon", "scenario"])
    return r6(out, [f"ensemble_{s}" for s in STATISTICS])


@check("download_area_guard", """
SELECT fld_ar_id, round(sum(abs(ymax - ymin) * 110.574e0 * abs(xmax - xmin) * 111.320e0 * cos(radians((ymin + ymax) / 2e0))), 4) AS area_km2,
  sum(abs(ymax - ymin) * 110.574e0 * abs(xmax - xmin) * 111.320e0 * cos(radians((ymin + ymax) / 2e0))) <= 1000 AS allowed
FROM {fx_zones} GROUP BY 1
""")
def download_area_guard(t: Tables):
    return r6(Q.downloadable(t.fx_zones, ["fld_ar_id"]), ["area_km2"], 4)


@check("return_period_select", """
SELECT osm_id, month, start_year, end_year, ssp, ensemble_median FROM {fx_pfe} WHERE return_period = 100
""")
def return_period_select(t: Tables):
    return t.fx_pfe.filter(F.col("return_period") == 100).select(
        "osm_id", "month", "start_year", "end_year", "ssp", "ensemble_median")


@check("asset_scan", f"""
SELECT osm_id, 'POINT (' || x0 || ' ' || y0 || ')' AS geometry FROM ({pick(SQL_GROUPS['commercial_real_estate'])}) g
WHERE geom_type = 'ST_Point' AND NOT EXISTS (SELECT 1 FROM {{fx_burn}} b WHERE b.osm_id = g.osm_id)
""")
def asset_scan(t: Tables):
    group = asset_groups.asset_group("commercial_real_estate", features(t), tags(t)).filter("geom_type = 'ST_Point'")
    pool = asset_groups.all_groups({"commercial_real_estate": group}, False)
    return Q.asset_scan(asset_groups.unexposed(pool, t.fx_burn))


@check("geojson_properties_table", """
SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k FROM {events}
""")
def geojson_properties_table(t: Tables):
    text = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":'), F.col("props"), F.lit("}"))
    return t.events.select("event_id", text.alias("f")).select(
        "event_id", Q.properties_table(F.col("f"), "k int")["k"].alias("k"))


@check("display_group_rows", f"""
SELECT osm_id, osm_subtype FROM ({pick(SQL_GROUPS['power_grid'])}) g WHERE osm_subtype IN ('plant', 'line', 'minor_line', 'substation')
""")
def display_group_rows(t: Tables):
    group = asset_groups.asset_group("power_grid", features(t), tags(t))
    return asset_groups.in_display_group(group, "power-grid").select("osm_id", "osm_subtype")
