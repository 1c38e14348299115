"""Scalar rules and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.harness import Tables, check
from checks.rounding import r6
from terrahaz.functions import values as V
from terrahaz.operators import grid as G
from terrahaz.operators import relational as R

# ------------------------------------------------------------------- scalars


@check("lon_wrap_unwrap", """
SELECT p_partkey, round((((lon + 180e0) % 360e0) + 360e0) % 360e0 - 180e0, 6) AS wrapped,
       round(((lon % 360e0) + 360e0) % 360e0, 6) AS unwrapped
FROM (SELECT p_partkey, p_retailprice - 900e0 AS lon FROM {part}) q
""")
def lon_wrap_unwrap(t: Tables):
    lon = F.col("p_retailprice") - F.lit(900.0)
    return r6(t.part.select("p_partkey", V.wrap_lon(lon).alias("wrapped"), V.unwrap_lon(lon).alias("unwrapped")))


@check("unit_conversion", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
       round(CASE WHEN l_returnflag = 'A' THEN l_quantity - 273.15e0 ELSE l_quantity END, 6) AS celsius,
       round(CASE WHEN l_linestatus = 'O' THEN l_discount * 86400e0 ELSE l_discount END, 6) AS mm_day
FROM {lineitem}
""")
def unit_conversion(t: Tables):
    temp_unit = F.when(F.col("l_returnflag") == "A", "K").otherwise("degC")
    rain_unit = F.when(F.col("l_linestatus") == "O", "kg m-2 s-1").otherwise("mm/day")
    return r6(t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        V.to_celsius(F.col("l_quantity"), temp_unit).alias("celsius"),
        V.to_mm_day(F.col("l_discount"), rain_unit).alias("mm_day")))


@check("decade_month_labels", """
SELECT o_orderkey, decade AS decade, month, label, cast(substr(label, 1, 4) AS int) AS label_decade,
       cast(right(label, 2) AS int) AS label_month, span, cast(substr(span, 1, 4) AS int) AS span_start,
       cast(substr(span, 6) AS int) AS span_end
FROM (SELECT o_orderkey, decade AS decade, month, decade || '-' || lpad(cast(month AS varchar), 2, '0') AS label,
             decade || '-' || (decade + 29) AS span
      FROM (SELECT o_orderkey, cast(year(o_orderdate) - year(o_orderdate) % 10 AS int) AS decade,
                   cast(month(o_orderdate) AS int) AS month FROM {orders}) a) b
""")
def decade_month_labels(t: Tables):
    df = G.decade_month(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")
    label, span = F.col("label"), F.col("span")
    return df.withColumns({
        "label": V.decade_month_label(F.col("decade"), F.col("month")),
        "span": V.span_label(F.col("decade"), F.col("decade") + 29),
    }).select(
        "o_orderkey", "decade", "month", "label", "span", V.label_decade(label).alias("label_decade"),
        V.label_month(label).alias("label_month"), V.span_start(span).alias("span_start"),
        V.span_end(span).alias("span_end"))


@check("ssp_encode", """
SELECT model, scenario, CASE scenario WHEN 'historical' THEN -999 ELSE try_cast(replace(scenario, 'ssp', '') AS int) END AS ssp,
       count(*) AS n FROM {fx_grid} GROUP BY 1, 2, 3
""")
def ssp_encode(t: Tables):
    return t.fx_grid.withColumn("ssp", V.encode_ssp(F.col("scenario"))).groupBy("model", "scenario", "ssp").agg(
        F.count(F.lit(1)).alias("n"))


@check("rename_round_statistics", """
SELECT osm_id, month, decade AS decade, ssp, round_even(ensemble_mean, 2) AS ensemble_mean,
       round_even(ensemble_stddev / 8e0, 2) AS ensemble_stddev FROM {fx_fwi}
""")
def rename_round_statistics(t: Tables):
    df = t.fx_fwi.select("osm_id", "month", "decade", "ssp", F.col("ensemble_mean").alias("value_mean"),
                         (F.col("ensemble_stddev") / F.lit(8.0)).alias("value_stddev"),
                         F.lit(1).alias("value_count"))
    return V.round_ensemble(V.rename_statistics(df))


@check("metadata_column", """
SELECT p_partkey, '{{"brand":"' || p_brand || '","source":"grid","zonal_method":"mean"}}' AS metadata FROM {part}
""")
def metadata_column(t: Tables):
    attrs = F.create_map(F.lit("source"), F.lit("grid"), F.lit("brand"), F.col("p_brand"))
    return t.part.select("p_partkey", V.metadata_json(attrs, {"zonal_method": "mean"}).alias("metadata"))


@check("year_component_names", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, component,
       'ensemble_mean-' || component || '-' || lpad(cast(month AS varchar), 2, '0') || '-100-global-1km.tif' AS name
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, month(l_shipdate) AS month,
        CASE WHEN d >= 2015 AND d < 2044 THEN '2015-2044' WHEN d >= 2045 AND d < 2074 THEN '2045-2074'
             WHEN d >= 2075 AND d < 2100 THEN '2075-2100' WHEN d = 2100 THEN '2075-2100'
             ELSE cast(d AS varchar) END AS component
      FROM (SELECT *, cast(2000 + 10 * (cast(l_quantity AS int) % 12) AS int) AS d FROM {lineitem}) a) b
""")
def year_component_names(t: Tables):
    decade = (F.lit(2000) + F.pmod(F.col("l_quantity").cast("int"), F.lit(12)) * 10).cast("int")
    comp = V.year_component(decade, [(2015, 2044), (2045, 2074), (2075, 2100)])
    return t.lineitem.withColumn("component", comp).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "component",
        V.raster_name(F.lit("ensemble_mean"), F.col("component"), F.month("l_shipdate"), "1km",
                      F.lit(100)).alias("name"))


@check("band_labels", """
SELECT o_orderkey, CASE WHEN kv >= 0 AND kv < 100 THEN '0-100' WHEN kv >= 100 AND kv < 300 THEN '100-300'
         WHEN kv >= 300 AND kv < 500 THEN '300-500' WHEN kv >= 500 THEN '500+' ELSE 'none' END AS kv_class,
       CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status_class
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice / 1e3 AS kv FROM {orders}) q
""")
def band_labels(t: Tables):
    return t.orders.select(
        "o_orderkey", V.band_label(F.col("o_totalprice") / F.lit(1e3), V.VOLTAGE_BANDS, "none").alias("kv_class"),
        V.category_label(F.col("o_orderstatus"), {"F": "final", "O": "open"}, "other").alias("status_class"))


@check("content_hash", """
SELECT p_partkey, sha256(array_to_string(list_sort(['s:' || p_name, 'n:' || p_size, 's:' || p_brand]), '|') || '|')
       AS digest FROM {part}
""")
def content_hash(t: Tables):
    parts = [V.typed_text(F.col("p_brand"), "s"), V.typed_text(F.col("p_size"), "n"), V.typed_text(F.col("p_name"), "s")]
    return t.part.select("p_partkey", V.content_hash(parts).alias("digest"))


@check("download_names", """
SELECT p_partkey, p_type || '_' || p_brand || CASE WHEN p_size > 25 THEN '_subtype-a-b' ELSE '' END
       || CASE WHEN p_size % 2 = 0 THEN '_climate-' || p_name || '_ssp126_' || (2000 + p_size) || 's' ELSE '' END
       || '_' || p_partkey AS name FROM {part}
""")
def download_names(t: Tables):
    variable = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    subtypes = F.when(F.col("p_size") > 25, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", V.download_name(
        F.col("p_type"), F.col("p_brand"), F.col("p_partkey").cast("string"), subtypes, variable,
        F.lit(126), F.lit(2000) + F.col("p_size")).alias("name"))


@check("investor_view", """
SELECT c_custkey, CASE WHEN c_custkey % 100 >= 60 THEN c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 100 >= 60 THEN c_mktsegment END AS c_mktsegment FROM {customer}
""")
def investor_view(t: Tables):
    return V.investor_view(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey",
                           ["c_acctbal", "c_mktsegment"], bucket=F.pmod("c_custkey", F.lit(100)))


# ---------------------------------------------------------------------- grids


@check("grid_load_join", """
SELECT a.model, a.lat, a.lon, a.date, pr, tasmax FROM {fx_grid} a
""")
def grid_load_join(t: Tables):
    keys = ["model", "lat", "lon", "date"]
    frames = {v: t.fx_grid.select(*keys, v) for v in ("pr", "tasmax")}
    return G.load_grid(frames, keys)


@check("grid_missing_keys", """
SELECT m.model, c.lat, c.lon FROM (SELECT 'M' || unnest(range(12)) AS model) m
CROSS JOIN (SELECT DISTINCT lat, lon FROM {fx_grid}) c
WHERE NOT EXISTS (SELECT 1 FROM {fx_grid} g WHERE g.model = m.model AND g.lat = c.lat AND g.lon = c.lon
                  AND g.scenario = 'historical' AND month(g.date) = 1)
""")
def grid_missing_keys(t: Tables):
    # Expected keys: each cell for the twelve registered models.
    expected = t.fx_grid.select("lat", "lon").distinct().withColumn(
        "model", F.explode(F.array(*[F.lit(f"M{i}") for i in range(12)])))
    january = t.fx_grid.filter((F.col("scenario") == "historical") & (F.month("date") == 1))
    return G.missing_keys(expected, january, ["model", "lat", "lon"]).select("model", "lat", "lon")


@check("grid_clip_box", """
SELECT model, lat, lon, date, pr FROM {fx_grid} WHERE lon BETWEEN -123e0 AND -118.5e0 AND lat BETWEEN 20e0 AND 20.5e0
""")
def grid_clip_box(t: Tables):
    return G.clip_box(t.fx_grid, -123, 20, -118.5, 20.5).select("model", "lat", "lon", "date", "pr")


@check("grid_monthly_mean", """
SELECT model, lat, lon, cast(date_trunc('month', date) AS date) AS month_start, round(avg(pr), 6) AS pr,
       round(avg(tasmax), 6) AS tasmax FROM {fx_grid} GROUP BY 1, 2, 3, 4
""")
def grid_monthly_mean(t: Tables):
    return r6(G.monthly_mean(t.fx_grid, ["model", "lat", "lon"], ["pr", "tasmax"]), ["pr", "tasmax"])


@check("grid_monthly_sum_strict", """
SELECT lat, lon, cast(date_trunc('month', date) AS date) AS month_start,
       round(CASE WHEN count(p) = count(*) THEN sum(p) END, 6) AS p
FROM (SELECT lat, lon, date, CASE WHEN hurs < 80 THEN pr END AS p FROM {fx_grid}) q GROUP BY 1, 2, 3
""")
def grid_monthly_sum_strict(t: Tables):
    df = t.fx_grid.withColumn("p", F.when(F.col("hurs") < 80, F.col("pr")))
    return r6(G.monthly_sum_strict(df, ["lat", "lon"], ["p"]), ["p"])


@check("grid_climatology", """
SELECT model, lat, lon, cast(year(date) - year(date) % 10 AS int) AS decade, cast(month(date) AS int) AS month,
       round(avg(pr), 6) AS pr FROM {fx_grid} GROUP BY 1, 2, 3, 4, 5
""")
def grid_climatology(t: Tables):
    return r6(G.climatology(t.fx_grid, ["model", "lat", "lon"], ["pr"]), ["pr"])


ENSEMBLE = """
WITH per_model AS (
  SELECT lat, lon, {keys}, model, avg(pr) AS v FROM {{fx_grid}} GROUP BY ALL)
SELECT lat, lon, {names}, round(avg(v), 6) AS ensemble_mean, round(quantile_cont(v, 0.5), 6) AS ensemble_median,
       round(stddev_pop(v), 6) AS ensemble_stddev, round(min(v), 6) AS ensemble_min, round(max(v), 6) AS ensemble_max,
       round(quantile_cont(v, 0.25), 6) AS ensemble_q1, round(quantile_cont(v, 0.75), 6) AS ensemble_q3,
       cast(count(v) AS int) AS ensemble_count
FROM per_model GROUP BY ALL
"""


@check("ensemble_decade_month", ENSEMBLE.format(
    keys="cast(year(date) - year(date) % 10 AS int) AS decade, cast(month(date) AS int) AS month",
    names="decade AS decade, month"))
def ensemble_decade_month(t: Tables):
    per_model = G.climatology(t.fx_grid, ["model", "lat", "lon"], ["pr"])
    return r6(G.ensemble_stats(per_model, ["lat", "lon", "decade", "month"], "pr"),
              [f"ensemble_{s}" for s in V.STATISTICS])


@check("ensemble_models", """
SELECT lat, lon, string_agg(DISTINCT model, ',' ORDER BY model) AS models, cast(count(DISTINCT model) AS int) AS sample_size
FROM {fx_grid} GROUP BY 1, 2
""")
def ensemble_models(t: Tables):
    return G.ensemble_models(t.fx_grid, ["lat", "lon"]).withColumn("models", F.array_join("models", ","))


@check("month_of_year_mean", """
SELECT lat, lon, cast(right(label, 2) AS int) AS month, round(avg(pr), 6) AS pr
FROM (SELECT *, strftime(date, '%Y-%m') AS label FROM {fx_grid}) q GROUP BY 1, 2, 3
""")
def month_of_year_mean(t: Tables):
    df = t.fx_grid.withColumn("label", F.date_format("date", "yyyy-MM"))
    return r6(G.month_of_year_mean(df, ["lat", "lon"], "pr", V.label_month(F.col("label"))), ["pr"])


@check("fire_season_masks", """
SELECT model, lat, lon, date, CASE WHEN tasmin > 0 THEN tasmin END AS positive,
       CASE WHEN sfcwind BETWEEN 2e0 AND 12e0 THEN sfcwind END AS masked
FROM {fx_grid} WHERE month(date) BETWEEN 5 AND 10
""")
def fire_season_masks(t: Tables):
    df = G.fire_season(t.fx_grid.withColumn("month", F.month("date")))
    return df.select("model", "lat", "lon", "date", G.positive_only(F.col("tasmin")).alias("positive"),
                     G.within(F.col("sfcwind"), 2, 12).alias("masked"))


@check("raster_coarsen_max", """
SELECT (cast(floor(lon / 1e0) AS bigint) + 0.5e0) AS lon, (cast(floor(lat / 1e0) AS bigint) + 0.5e0) AS lat, max(pr) AS pr
FROM {fx_grid} GROUP BY 1, 2
""")
def raster_coarsen_max(t: Tables):
    return G.coarsen_max(t.fx_grid, "lon", "lat", "pr", 1.0)


@check("raster_value_range", """
SELECT model, scenario, min(pr) AS min_value, max(pr) AS max_value FROM {fx_grid} GROUP BY 1, 2
""")
def raster_value_range(t: Tables):
    return G.value_range(t.fx_grid, ["model", "scenario"], "pr")


@check("first_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) q WHERE rn = 1
""")
def first_per_key(t: Tables):
    df = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.keep_first(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@check("insert_new_rows", """
SELECT fld_ar_id, zone_rank, flood_zone, lomr_effective_date FROM {fx_zones} b WHERE NOT EXISTS (
  SELECT 1 FROM {fx_zones} a WHERE a.is_sfha = 'T' AND a.fld_ar_id = b.fld_ar_id
   AND a.flood_zone = b.flood_zone AND a.lomr_effective_date IS NOT DISTINCT FROM b.lomr_effective_date)
""")
def insert_new_rows(t: Tables):
    keys = ["fld_ar_id", "flood_zone", "lomr_effective_date"]
    batch = t.fx_zones.select(*keys, "zone_rank")
    held = t.sql("SELECT fld_ar_id, flood_zone, lomr_effective_date FROM {fx_zones} WHERE is_sfha = 'T'")
    return R.insert_new(held, batch, keys)


@check("drop_incomplete_rows", """
SELECT osm_id, osm_subtype, operator FROM {fx_layers} WHERE osm_subtype IS NOT NULL AND operator IS NOT NULL
""")
def drop_incomplete_rows(t: Tables):
    return R.drop_incomplete(t.fx_layers.select("osm_id", "osm_subtype", "operator"), ["osm_subtype", "operator"])


@check("failed_id_count", """
SELECT count(DISTINCT CASE WHEN lomr_effective_date IS NULL THEN fld_ar_id END) AS failed_ids FROM {fx_zones}
""")
def failed_id_count(t: Tables):
    return R.count_failed(t.fx_zones, "fld_ar_id", "lomr_effective_date")


@check("nan_as_missing", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount > 0.05e0 THEN l_discount END AS v FROM {lineitem}
""")
def nan_as_missing(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(
        F.col("l_discount") > 0.05, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("v"))
    return R.nan_to_null(df)


@check("value_contract", """
SELECT osm_id, month, decade AS decade, ssp, ensemble_mean, ensemble_median, ensemble_stddev, ensemble_min,
       ensemble_max, ensemble_q1, ensemble_q3, 'm' AS metadata FROM {fx_fwi}
""")
def value_contract(t: Tables):
    return V.exposure_contract(t.fx_fwi.withColumn("metadata", F.lit("m")), "decade_month")
