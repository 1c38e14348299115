"""Asset groups and un-exposed ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.harness import Tables, check
from checks.shapes import asset_geometry
from terrahaz.functions.tags import parse_tags
from terrahaz.plans import asset_groups as G


def features(t: Tables):
    return asset_geometry(t.fx_layers, "geom_type")


def tags(t: Tables):
    return t.fx_tags.select("osm_id", parse_tags(F.col("tags_json")).alias("tags"))


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def layer_names(theme: str, *kinds: str) -> str:
    return sql_list([f"{theme}_{k}" for k in kinds])


def branch(rank: int, layers: str, where: str, osm_type: str, subtype: str, extra: str = "", join: str = "JOIN") -> str:
    return (f"SELECT {rank} AS rnk, f.osm_id, {osm_type} AS osm_type, {subtype} AS osm_subtype, {extra} "
            f"f.geom_type, f.x0, f.y0, f.x1, f.y1, g.tags_json FROM {{fx_layers}} f {join} {{fx_tags}} g "
            f"ON f.osm_id = g.osm_id WHERE f.layer IN {layers} AND ({where})")


def pick(branches: list[str]) -> str:
    return ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY rnk, osm_type NULLS FIRST, "
            "osm_subtype NULLS FIRST, geom_type, x0, y0, x1, y1) AS rn FROM ("
            + " UNION ALL ".join(branches) + ") u) q WHERE rn = 1")


def j(key: str) -> str:
    return f"json_extract_string(g.tags_json, '$.{key}')"


ONE, TWO, THREE = ("polygon",), ("point", "polygon"), ("point", "line", "polygon")
SQL_GROUPS = {
    "power_grid": [branch(
        0, layer_names("infrastructure", *THREE),
        f"f.osm_type = 'power' AND f.osm_subtype IN {sql_list(G.POWER_SUBTYPES)}", "f.osm_type", "f.osm_subtype")],
    "data_center": [branch(
        0, layer_names("building", *TWO), f"{j('telecom')} = 'data_center'", "f.osm_type", "f.osm_subtype",
        "f.name, f.operator,")],
    "agriculture": [
        branch(0, layer_names("landuse", *ONE), f"{j('landuse')} IN {sql_list(G.FARM_LANDUSE)}", "'landuse'", j("landuse")),
        branch(1, layer_names("building", *TWO), f"{j('building')} IN {sql_list(G.FARM_BUILDINGS)}", "'building'",
               "f.osm_subtype")],
    "commercial_real_estate": [
        branch(0, layer_names("shop", *TWO), f"{j('shop')} IS NOT NULL", "'shop'", "f.osm_subtype"),
        branch(1, layer_names("building", *TWO), f"{j('office')} IS NOT NULL OR {j('building')} = 'office'",
               "'building'", "'office'"),
        branch(2, layer_names("amenity", *TWO), f"{j('amenity')} IN {sql_list(G.TRADE_AMENITIES)}", "'amenity'",
               "f.osm_subtype"),
        branch(3, layer_names("poi", *TWO), f"{j('tourism')} IN {sql_list(G.LODGING)}", "'tourism'", "f.osm_subtype"),
        branch(4, layer_names("building", *ONE),
               f"{j('building')} IN {sql_list(G.TRADE_BUILDINGS)} OR {j('amenity')} = 'marketplace'", "'building'",
               "f.osm_subtype"),
        branch(5, layer_names("landuse", *ONE), f"{j('landuse')} IN {sql_list(G.TRADE_LANDUSE)}", "'landuse'",
               j("landuse"))],
    "administrative": [
        branch(0, layer_names("place", *ONE), "f.admin_level IS NOT NULL", "'place'", "'boundary'",
               "f.admin_level, f.name,", "LEFT JOIN"),
        branch(1, layer_names("place", *TWO),
               f"{j('place')} IN {sql_list(G.PLACES)} AND {j('boundary')} IS DISTINCT FROM 'administrative'",
               "'place'", j("place"), "f.admin_level, f.name,")],
    "residential_real_estate": [branch(
        0, layer_names("building", *TWO), f"{j('building')} IN {sql_list(G.HOMES)}", "'building'", "f.osm_subtype")],
}
for _name, _branches in SQL_GROUPS.items():
    _extra = "".join(f"{c}, " for c in G.GROUPS[_name].extra)

    def _build(t: Tables, name=_name):
        out = G.asset_group(name, features(t), tags(t))
        return out.select("osm_id", "osm_type", "osm_subtype", *G.GROUPS[name].extra, "geom_type",
                          F.col("xmin").alias("x0"), F.col("ymax").alias("y1"),
                          F.try_element_at("tags", F.lit("building")).alias("building_tag"))

    check(f"group_{_name}",
          f"SELECT osm_id, osm_type, osm_subtype, {_extra}geom_type, x0, y1, "
          f"json_extract_string(tags_json, '$.building') AS building_tag FROM ({pick(_branches)}) g")(_build)


def sql_pool(groups, named_only: bool) -> str:
    parts = []
    for g in groups:
        where = " WHERE osm_subtype IS NOT NULL" if named_only and g == "commercial_real_estate" else ""
        parts.append(f"SELECT osm_id, geom_type, x0, y0, x1, y1 FROM ({pick(SQL_GROUPS[g])}) p{where}")
    return " UNION ALL ".join(parts)


def pool(t: Tables, groups=G.ACTIVE_GROUPS, named_only: bool = True):
    return G.asset_pool(G.asset_groups(groups, features(t), tags(t)), named_only)


# Exposure tables cover the parts sold in some month or of some type; the rest is un-exposed.
_ARCHIVED = (*G.ACTIVE_GROUPS, "residential_real_estate")
for _name, _table, _groups, _named, _where in (
    ("fwi", "fx_fwi", G.ACTIVE_GROUPS, True, "month = 6 AND ssp = 585"),
    ("pfe_mm_day", "fx_pfe", G.ACTIVE_GROUPS, True, "return_period = 100 AND month = 3"),
    ("pluvial_change_factor", "fx_pcf", G.ACTIVE_GROUPS, True, "return_period = 2 AND month = 9"),
    ("burn_probability", "fx_burn", G.ACTIVE_GROUPS, True, "burn_probability > 0.1"),
    ("pr_percent_change", "fx_fwi", _ARCHIVED, False, "month = 1 AND ssp = 245"),
):
    def _build(t: Tables, table=_table, groups=_groups, named=_named, where=_where):
        out = G.unexposed(pool(t, groups, named), getattr(t, table).filter(where))
        return out.select("osm_id", "geom_type", F.col("xmin").alias("x0"), F.col("ymax").alias("y1"))

    check(f"unexposed_{_name}",
          f"SELECT DISTINCT a.osm_id, a.geom_type, a.x0, a.y1 FROM ({sql_pool(_groups, _named)}) a "
          f"LEFT JOIN (SELECT osm_id FROM {{{_table}}} WHERE {_where}) e ON e.osm_id = a.osm_id "
          f"WHERE e.osm_id IS NULL")(_build)
