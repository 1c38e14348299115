"""Domain tables as SQL over the driver tables, in text both engines accept.

Ids map one to one, and extents grow with the tables, so every derived table
grows with its source. ``{{name}}`` in doubled form is a literal brace.
"""

from __future__ import annotations

DOMAIN: dict[str, str] = {}

DOMAIN["fx_fwi"] = """
SELECT l_partkey AS osm_id, cast(month(l_shipdate) AS int) AS month,
       cast(year(l_shipdate) - year(l_shipdate) % 10 AS int) AS decade,
       cast(CASE l_returnflag WHEN 'A' THEN -999 WHEN 'N' THEN 245 ELSE 585 END AS int) AS ssp,
       avg(l_quantity) AS ensemble_mean, (min(l_quantity) + max(l_quantity)) / 2e0 AS ensemble_median,
       (max(l_quantity) - min(l_quantity)) / 4e0 AS ensemble_stddev,
       min(l_quantity) AS ensemble_min, max(l_quantity) AS ensemble_max,
       min(l_quantity) AS ensemble_q1, max(l_quantity) AS ensemble_q3
FROM {lineitem} GROUP BY 1, 2, 3, 4
"""

DOMAIN["fx_burn"] = """
SELECT p_partkey AS osm_id, p_size / 1e2 AS burn_probability FROM {part} WHERE p_type <> 'PROMO'
"""

_PERIODS = """
SELECT l_partkey AS osm_id, cast(month(l_shipdate) AS int) AS month,
       cast(CASE WHEN year(l_shipdate) < 1998 THEN 2015 ELSE 2045 END AS int) AS start_year,
       cast(CASE WHEN year(l_shipdate) < 1998 THEN 2044 ELSE 2074 END AS int) AS end_year,
       cast(CASE WHEN l_returnflag = 'R' THEN 585 ELSE 245 END AS int) AS ssp,
       cast(CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 20 WHEN 4 THEN 100
            ELSE 500 END AS int) AS return_period,
"""
DOMAIN["fx_pfe"] = _PERIODS + """
       avg(l_quantity) AS ensemble_median, max(l_quantity) AS ensemble_q3
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6
"""
DOMAIN["fx_pcf"] = _PERIODS + """
       avg(round(l_discount * 1e2, 0)) AS ensemble_median, max(round(l_discount * 1e2, 0)) AS ensemble_q3
FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY 1, 2, 3, 4, 5, 6
"""

# Sixteen neighbouring part keys share a cell; forty cells make a row of the grid.
DOMAIN["fx_grid"] = """
SELECT concat('M', cast(l_suppkey % 12 AS varchar(9))) AS model,
       CASE WHEN year(l_shipdate) < 1998 THEN 'historical' ELSE 'ssp245' END AS scenario,
       'r1i1p1f1' AS member,
       20e0 + 0.25e0 * cast(floor(l_partkey / 640) AS bigint) AS lat,
       -125e0 + 0.25e0 * (cast(floor(l_partkey / 16) AS bigint) % 40) AS lon,
       cast(l_shipdate AS date) AS date,
       avg(l_quantity) AS pr,
       cast(max(cast(floor(l_extendedprice) AS bigint) % 30) + 10 AS double) AS tasmax,
       cast(min(cast(floor(l_extendedprice) AS bigint) % 30) - 2 AS double) AS tasmin,
       cast(max(l_linenumber) * 12 AS double) AS hurs,
       cast(min(l_linenumber) * 3 AS double) AS sfcwind
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6
"""

# One series per cell, all models together.
DOMAIN["fx_cell_daily"] = """
SELECT lat, lon, date, avg(pr) AS pr, max(tasmax) AS tasmax, min(tasmin) AS tasmin
FROM {fx_grid} GROUP BY lat, lon, date
"""

# A complete (cell, decade, month) ensemble grid for exposure.
DOMAIN["fx_ensemble"] = """
SELECT lat, lon, cast(year(date) - year(date) % 10 AS int) AS decade, cast(month(date) AS int) AS month,
       avg(pr) AS ensemble_mean, (min(pr) + max(pr)) / 2e0 AS ensemble_median,
       (max(pr) - min(pr)) / 4e0 AS ensemble_stddev, min(pr) AS ensemble_min, max(pr) AS ensemble_max,
       (3e0 * min(pr) + max(pr)) / 4e0 AS ensemble_q1, (min(pr) + 3e0 * max(pr)) / 4e0 AS ensemble_q3
FROM (SELECT lat, lon, date, max(pr) AS pr FROM {fx_grid} GROUP BY lat, lon, date) d GROUP BY 1, 2, 3, 4
"""

# A hundred neighbouring customer keys share a strip of latitude.
DOMAIN["fx_assets"] = """
SELECT osm_id, kind, x0, y0, x0 + w AS x1, y0 + h AS y1, w, h FROM (
  SELECT c_custkey AS osm_id,
         CASE c_custkey % 3 WHEN 0 THEN 'ST_Point' WHEN 1 THEN 'ST_Polygon' ELSE 'ST_LineString' END AS kind,
         -125e0 + (c_custkey * 37 % 1000) / 1e2 AS x0,
         20e0 + 0.064e0 * cast(floor(c_custkey / 100) AS bigint) + (c_custkey * 53 % 45) / 1e3 AS y0,
         CASE c_custkey % 3 WHEN 0 THEN 0e0 ELSE 0.03e0 * (1 + c_custkey % 4) END AS w,
         CASE c_custkey % 3 WHEN 0 THEN 0e0 ELSE 0.02e0 * (1 + c_custkey % 5) END AS h
  FROM {customer}) a
"""

DOMAIN["fx_zones"] = """
SELECT concat('53033C_', cast(o_custkey AS string)) AS fld_ar_id, o_orderkey AS zone_rank, o_orderpriority AS flood_zone,
       o_orderstatus AS flood_zone_subtype, CASE WHEN o_orderstatus = 'F' THEN 'T' ELSE 'F' END AS is_sfha,
       cast(floor(o_totalprice / 1e3) AS double) AS flood_depth,
       CASE WHEN o_orderpriority = '5-LOW' OR o_custkey % 11 = 0 THEN NULL
            ELSE cast(o_orderdate AS date) END AS lomr_effective_date,
       -125e0 + (o_custkey * 37 % 1000) / 1e2 - 0.05e0 + (o_orderkey % 7) / 1e2 AS xmin,
       20e0 + 0.064e0 * cast(floor(o_custkey / 100) AS bigint) - 0.02e0 + (o_orderkey % 5) / 1e2 AS ymin,
       -125e0 + (o_custkey * 37 % 1000) / 1e2 - 0.05e0 + (o_orderkey % 7) / 1e2 + 0.1e0 AS xmax,
       20e0 + 0.064e0 * cast(floor(o_custkey / 100) AS bigint) - 0.02e0 + (o_orderkey % 5) / 1e2 + 0.1e0 AS ymax
FROM {orders}
"""

DOMAIN["fx_admin"] = """
SELECT s_suppkey AS admin_id, s_name AS name, cast(CASE s_suppkey % 2 WHEN 0 THEN 6 ELSE 8 END AS int) AS admin_level,
       -125e0 + (s_suppkey * 555 % 1000) / 1e2 AS xmin,
       20e0 + 0.064e0 * cast(floor(s_suppkey * 15 / 100) AS bigint) AS ymin,
       -125e0 + (s_suppkey * 555 % 1000) / 1e2 + CASE s_suppkey % 2 WHEN 0 THEN 0.9e0 ELSE 0.4e0 END AS xmax,
       20e0 + 0.064e0 * cast(floor(s_suppkey * 15 / 100) AS bigint)
            + CASE s_suppkey % 2 WHEN 0 THEN 0.5e0 ELSE 0.2e0 END AS ymax
FROM {supplier}
"""

DOMAIN["fx_stations"] = """
SELECT s_suppkey AS station_id, -125e0 + (s_suppkey * 555 % 1000) / 1e2 + 0.013e0 AS lon,
       20e0 + 0.064e0 * cast(floor(s_suppkey * 15 / 100) AS bigint) + 0.017e0 AS lat FROM {supplier}
"""

DOMAIN["fx_tags"] = """
SELECT p_partkey AS osm_id, concat('{{"building":"',
         CASE p_size % 8 WHEN 0 THEN 'farm' WHEN 1 THEN 'office' WHEN 2 THEN 'retail' WHEN 3 THEN 'house'
              WHEN 4 THEN 'barn' WHEN 5 THEN 'apartments' WHEN 6 THEN 'yes' ELSE 'warehouse' END,
       '","landuse":"', CASE p_size % 5 WHEN 0 THEN 'farmland' WHEN 1 THEN 'retail' WHEN 2 THEN 'orchard'
              WHEN 3 THEN 'forest' ELSE 'industrial' END,
       '","amenity":"', CASE p_size % 6 WHEN 0 THEN 'cafe' WHEN 1 THEN 'bank' WHEN 2 THEN 'school'
              WHEN 3 THEN 'marketplace' WHEN 4 THEN 'fuel' ELSE 'bench' END,
       '","place":"', CASE p_size % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'locality'
              ELSE 'county' END,
       '","tourism":"', CASE p_size % 3 WHEN 0 THEN 'hotel' WHEN 1 THEN 'museum' ELSE 'hostel' END, '"',
       CASE WHEN p_type = 'PROMO' THEN ',"telecom":"data_center"' ELSE '' END,
       CASE WHEN p_type = 'LARGE' THEN ',"office":"company"' ELSE '' END,
       CASE WHEN p_type = 'SMALL' THEN ',"shop":"bakery"' ELSE '' END,
       CASE WHEN p_type = 'MEDIUM' THEN ',"boundary":"administrative"' ELSE '' END,
       ',"name":"', p_name, '"',
       CASE WHEN p_size > 25 THEN concat(',"operator":"', p_brand, '"') ELSE '' END,
       ',"building:levels":"', cast(p_size AS varchar(9)), '"',
       ',"plant:output:electricity":"', cast(p_size * 10 AS varchar(9)), CASE WHEN p_size % 2 = 0 THEN ' MW' ELSE '.5MW' END, '"',
       ',"voltage":"', CASE p_size % 12 WHEN 0 THEN '115000;230000' WHEN 1 THEN 'Medium' WHEN 2 THEN '120kv'
              WHEN 3 THEN 'x' WHEN 4 THEN '69000' WHEN 5 THEN '115.5kv' WHEN 6 THEN '13800/7200'
              WHEN 7 THEN '?' WHEN 8 THEN ' 230000 ' WHEN 9 THEN '400:220' WHEN 10 THEN 'high'
              ELSE 'a,b' END, '"}}') AS tags_json
FROM {part} WHERE p_brand <> 'Brand#13'
"""

# Every customer sits in the layer of its segment and in a second, shared layer.
DOMAIN["fx_layers"] = """
SELECT concat(theme, CASE kind WHEN 'ST_Point' THEN '_point' WHEN 'ST_Polygon' THEN '_polygon' ELSE '_line' END) AS layer,
       osm_id, theme AS osm_theme,
       CASE theme WHEN 'infrastructure' THEN 'power' ELSE theme END AS osm_type,
       CASE WHEN theme = 'infrastructure' THEN
              CASE nation % 5 WHEN 0 THEN 'substation' WHEN 1 THEN 'line' WHEN 2 THEN 'plant'
                   WHEN 3 THEN 'minor_line' ELSE 'pole' END
            WHEN nation % 4 = 0 THEN NULL ELSE concat('sub', cast(nation % 4 AS varchar(9))) END AS osm_subtype,
       c_name AS name, CASE WHEN nation > 12 THEN segment END AS operator,
       cast(CASE WHEN theme = 'place' AND nation % 3 <> 0 THEN 4 + 2 * (nation % 3) END AS int) AS admin_level,
       kind AS geom_type, x0, y0, x1, y1
FROM (
  SELECT a.*, c.c_name, c.c_nationkey AS nation, c.c_mktsegment AS segment,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'infrastructure' WHEN 'BUILDING' THEN 'building'
              WHEN 'FURNITURE' THEN 'landuse' WHEN 'MACHINERY' THEN 'amenity' ELSE 'shop' END AS theme
  FROM {fx_assets} a JOIN {customer} c ON c.c_custkey = a.osm_id
  UNION ALL
  SELECT a.*, c.c_name, c.c_nationkey AS nation, c.c_mktsegment AS segment,
         CASE c.c_nationkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'place' ELSE 'poi' END AS theme
  FROM {fx_assets} a JOIN {customer} c ON c.c_custkey = a.osm_id
  WHERE c.c_mktsegment <> 'BUILDING' OR c.c_nationkey % 3 <> 0) u
"""
