"""Tag rules, facility classes and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.groups import tags as parsed
from checks.harness import Tables, check
from checks.rounding import r6
from terrahaz.functions import tags as T
from terrahaz.operators import relational as R
from terrahaz.plans import jobs


def js(key: str, src: str = "tags_json") -> str:
    return f"""json_extract_string({src}, '$."{key}"')"""


@check("tag_access", f"""
SELECT osm_id, {js('name')} AS name, {js('building:levels')} AS levels, {js('shop')} IS NOT NULL AS has_shop FROM {{fx_tags}}
""")
def tag_access(t: Tables):
    c = F.col("tags")
    return parsed(t).select("osm_id", T.tag(c, "name").alias("name"), T.tag(c, "building:levels").alias("levels"),
                            T.has_tag(c, "shop").alias("has_shop"))


@check("tag_distinct_keys", """
SELECT DISTINCT unnest(json_keys(tags_json)) AS key FROM {fx_tags}
""")
def tag_distinct_keys(t: Tables):
    return R.distinct_keys_of(parsed(t), "tags")


VOLT = js("voltage")


@check("voltage_to_kv", f"""
WITH v AS (SELECT osm_id, lower(trim({VOLT})) AS v FROM {{fx_tags}}),
s AS (SELECT *, CASE WHEN contains(v, ';') THEN ';' WHEN contains(v, '/') THEN '/' WHEN contains(v, ':') THEN ':'
                     WHEN contains(v, ',') THEN ',' END AS sep FROM v)
SELECT osm_id, CASE WHEN v = 'low' THEN 1e0 WHEN v = 'medium' THEN 20e0 WHEN v = 'high' THEN 110e0
   WHEN v IN ('unknown', '?') THEN NULL
   WHEN try_cast(v AS double) IS NOT NULL THEN try_cast(v AS double) / 1000e0
   WHEN sep IS NOT NULL THEN list_max(list_transform(string_split(v, sep), lambda x: try_cast(regexp_extract(x, '[0-9]+') AS double))) / 1000e0
   WHEN contains(v, 'kv') THEN try_cast(regexp_extract(v, '[0-9]+') AS double)
   ELSE try_cast(regexp_extract(v, '[0-9]+') AS double) / 1000e0 END AS kv FROM s
""")
def voltage_to_kv(t: Tables):
    return parsed(t).select("osm_id", T.apply_transforms(T.tag(F.col("tags"), "voltage"), ["osm_line_voltage"]).alias("kv"))


CAP = js("plant:output:electricity")


@check("number_with_unit", f"""
SELECT osm_id, try_cast(regexp_extract({CAP}, '([0-9]+(?:\\.[0-9]+)?)', 1) AS double) AS value,
       nullif(regexp_extract({CAP}, '[0-9]+(?:\\.[0-9]+)?\\s*([a-zA-Z]+)', 1), '') AS unit FROM {{fx_tags}}
""".replace("{{fx_tags}}", "{fx_tags}"))
def number_with_unit(t: Tables):
    n = T.number_unit(T.tag(F.col("tags"), "plant:output:electricity"))
    return parsed(t).select("osm_id", n["value"].alias("value"), n["unit"].alias("unit"))


@check("tag_text_parse", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k')
          WHEN event_id % 3 = 1 THEN event_type END AS k,
       CASE WHEN event_id % 3 = 1 THEN cast(user_id AS varchar) END AS user,
       CASE WHEN event_id % 3 = 2 THEN event_type END AS original FROM {events}
""")
def tag_text_parse(t: Tables):
    m = F.pmod("event_id", F.lit(3))
    text = F.when(m == 0, F.col("props")).when(
        m == 1, F.concat(F.lit("k=old; k = "), F.col("event_type"), F.lit(";user="), F.col("user_id").cast("string"))
    ).otherwise(F.col("event_type"))
    p = T.parse_tag_text(text)
    return t.events.withColumn("_p", p).select(
        "event_id", T.tag(F.col("_p"), "k").alias("k"), T.tag(F.col("_p"), "user").alias("user"),
        T.tag(F.col("_p"), "original_tag").alias("original"))


@check("infrastructure_attributes", f"""
SELECT osm_id, {js('name')} AS name, {js('operator')} AS operator, cast(NULL AS varchar) AS power_type,
       try_cast(regexp_extract({CAP}, '([0-9]+(?:\\.[0-9]+)?)', 1) AS double) AS plant_output_electricity,
       nullif(regexp_extract({CAP}, '[0-9]+(?:\\.[0-9]+)?\\s*([a-zA-Z]+)', 1), '') AS plant_output_electricity_unit,
       {js('building')} AS building FROM {{fx_tags}}
""")
def infrastructure_attributes(t: Tables):
    return T.infrastructure_attributes(parsed(t), "power", extra_keys=["building", "name"]).drop("tags")


WIDE = [("sub1", "name"), ("sub1", "voltage"), ("sub2", "name")]


def _subtyped(t: Tables):
    return parsed(t).join(t.fx_layers.filter("layer LIKE 'building%'").select("osm_id", "osm_subtype"), "osm_id")


@check("widen_tags_prefix", f"""
SELECT g.osm_id, f.osm_subtype, CASE WHEN osm_subtype = 'sub1' THEN {js('name')} END AS "sub1;name",
       CASE WHEN osm_subtype = 'sub1' THEN {js('voltage')} END AS "sub1;voltage",
       CASE WHEN osm_subtype = 'sub2' THEN {js('name')} END AS "sub2;name"
FROM {{fx_tags}} g JOIN {{fx_layers}} f ON f.osm_id = g.osm_id WHERE f.layer LIKE 'building%'
""")
def widen_tags_prefix(t: Tables):
    return T.widen_tags(_subtyped(t), "prefix", WIDE)


@check("widen_tags_flat", f"""
SELECT g.osm_id, f.osm_subtype, {js('name')} AS name, {js('voltage')} AS voltage
FROM {{fx_tags}} g JOIN {{fx_layers}} f ON f.osm_id = g.osm_id WHERE f.layer LIKE 'building%'
""")
def widen_tags_flat(t: Tables):
    return T.widen_tags(_subtyped(t), "flat", WIDE)


@check("widen_tags_separate", f"""
SELECT g.osm_id, f.osm_subtype, {js('name')} AS name, {js('voltage')} AS voltage
FROM {{fx_tags}} g JOIN {{fx_layers}} f ON f.osm_id = g.osm_id WHERE f.layer LIKE 'building%' AND osm_subtype = 'sub1'
""")
def widen_tags_separate(t: Tables):
    return T.widen_tags(_subtyped(t), "separate", WIDE)["sub1"]


@check("merge_tags", f"""
SELECT osm_id, {js('name')} AS name, 'kept' AS source FROM {{fx_tags}}
""")
def merge_tags(t: Tables):
    props = F.create_map(F.lit("name"), F.lit("old"), F.lit("source"), F.lit("kept"))
    m = T.merge_tags(props, F.col("tags"))
    return parsed(t).withColumn("_m", m).select(
        "osm_id", T.tag(F.col("_m"), "name").alias("name"), T.tag(F.col("_m"), "source").alias("source"))


SOURCE = """
CASE p_size % 9 WHEN 0 THEN p_name || ' Solar/photovoltaic' WHEN 1 THEN 'Natural Gas; ' || p_name
  WHEN 2 THEN 'Battery storage' WHEN 3 THEN p_type || ';' || p_name WHEN 4 THEN 'Hydro' WHEN 5 THEN '123/45'
  WHEN 6 THEN 'fuel oil' WHEN 7 THEN 'combustion' END
"""


@check("plant_source_class", f"""
SELECT p_partkey, CASE WHEN s IS NULL THEN 'unknown' WHEN contains(s, 'nuclear') OR contains(s, 'fission') THEN 'nuclear'
   WHEN contains(s, 'hydro') THEN 'hydro' WHEN contains(s, 'solar') OR contains(s, 'photovoltaic') THEN 'solar'
   WHEN contains(s, 'wind') THEN 'wind' WHEN contains(s, 'gas') THEN 'gas'
   WHEN contains(s, 'biomass') OR contains(s, 'wood') THEN 'biomass' WHEN contains(s, 'coal') THEN 'coal'
   WHEN contains(s, 'oil') THEN 'oil' WHEN contains(s, 'combustion') THEN 'combustion_engine'
   WHEN contains(s, 'storage') AND contains(s, 'battery') THEN 'battery_storage'
   ELSE coalesce(nullif(regexp_replace(trim(split_part(split_part(s, ';', 1), '/', 1)), '[^a-z;,/]', '', 'g'), ''), 'unknown') END AS plant_type
FROM (SELECT p_partkey, lower({SOURCE}) AS s FROM {{part}}) q
""")
def plant_source_class(t: Tables):
    df = t.part.withColumn("s", F.expr(SOURCE))
    return df.select("p_partkey", T.plant_source(F.col("s")).alias("plant_type"))


def _sites(t: Tables):
    """Site elements with tags built from the part columns."""
    ref = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("bfi"), F.col("p_size").cast("string"))).when(
        F.col("p_size") % 4 == 1, F.lit("XYZ1"))
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Amazon "), F.col("p_name"))).when(
        F.col("p_size") % 5 == 1, F.lit("Delivery Station")).when(F.col("p_size") % 5 == 2, F.lit("Old Road Warehouse"))
    brand = F.when(F.col("p_brand") == "Brand#7", F.lit("Amazon"))
    entries = F.array(
        F.struct(F.lit("name").alias("k"), name.alias("v")), F.struct(F.lit("ref").alias("k"), ref.alias("v")),
        F.struct(F.lit("brand").alias("k"), brand.alias("v")),
        F.struct(F.lit("addr:city").alias("k"), F.col("p_type").alias("v")))
    return t.part.select(
        F.lit("node").alias("osm_type"), F.col("p_partkey").alias("osm_id"),
        F.when(F.col("p_size") != 10, F.col("p_retailprice") / 100.0).alias("lat"), F.lit(1.0).alias("lon"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("tags"))


SITES = """
site AS (SELECT p_partkey AS osm_id, p_type, p_size, p_brand,
   CASE p_size % 5 WHEN 0 THEN 'Amazon ' || p_name WHEN 1 THEN 'Delivery Station' WHEN 2 THEN 'Old Road Warehouse' END AS name,
   CASE p_size % 4 WHEN 0 THEN 'bfi' || p_size WHEN 1 THEN 'XYZ1' END AS ref FROM {part}),
facility AS (SELECT *, CASE WHEN contains(lower(coalesce(name, '')), 'fulfillment') OR starts_with(upper(coalesce(ref, '')), 'BFI')
     THEN 'fulfillment_centers' WHEN name = 'Delivery Station' THEN 'delivery_stations'
     WHEN contains(lower(coalesce(name, '')), 'warehouse') THEN 'warehouses' ELSE 'other' END AS category
  FROM site WHERE (p_brand = 'Brand#7' OR contains(lower(coalesce(name, '')), 'amazon') OR starts_with(upper(coalesce(ref, '')), 'BFI'))
    AND p_size <> 10 AND NOT contains(coalesce(name, 'Unnamed'), 'Road'))
"""


@check("facility_table", f"""
WITH {SITES} SELECT osm_id, category, coalesce(name, 'Unnamed') AS name, coalesce(ref, '') AS ref, p_type AS full_address FROM facility
""")
def facility_table(t: Tables):
    return T.facility_table(_sites(t)).select("osm_id", "category", "name", "ref", "full_address")


@check("facility_summary", f"""
WITH {SITES} SELECT category, count(*) AS facilities FROM facility GROUP BY ROLLUP (category)
""")
def facility_summary(t: Tables):
    return T.facility_summary(T.facility_table(_sites(t)))


@check("way_centers", """
SELECT o_custkey AS osm_id, round(avg(o_totalprice / 1e4), 9) AS lat, round(avg(o_orderkey / 1e3), 9) AS lon FROM {orders} GROUP BY 1
""")
def way_centers(t: Tables):
    nodes = t.orders.select(F.col("o_custkey").alias("osm_id"), (F.col("o_totalprice") / 1e4).alias("lat"),
                            (F.col("o_orderkey") / 1e3).alias("lon"))
    return r6(T.way_centers(nodes), ["lat", "lon"], 9)


@check("manager_rule_lookup", """
SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 0 AND 4 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INSP'
   WHEN c_nationkey BETWEEN 3 AND 9 AND c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'YVIG' ELSE 'Unaffiliated' END AS manager
FROM {customer}
""")
def manager_rule_lookup(t: Tables):
    rules = t.spark.createDataFrame(
        [(1, "INSP", list(range(0, 5)), ["BUILDING", "MACHINERY"]),
         (2, "YVIG", list(range(3, 10)), ["BUILDING", "FURNITURE"])],
        "priority int, manager string, counties array<int>, types array<string>")
    assets = t.customer.select("c_custkey", F.col("c_nationkey").alias("county"), F.col("c_mktsegment").alias("asset_type"))
    return jobs.assign_manager(assets, rules).select("c_custkey", "manager")


@check("first_attributes", """
SELECT osm_id, county, subtype FROM (
 SELECT o_custkey AS osm_id, o_orderstatus AS county, o_orderpriority AS subtype,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) q WHERE rn = 1
""")
def first_attributes(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("osm_id"), F.col("o_orderstatus").alias("county"),
                           F.col("o_orderpriority").alias("subtype"), "o_orderdate", "o_orderkey")
    return jobs.first_attributes(rows, ["county", "subtype"], ["o_orderdate", "o_orderkey"])
