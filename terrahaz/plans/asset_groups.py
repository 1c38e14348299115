"""Asset groups: rule tables over one long feature layer table.

``features`` holds every map layer in one table (column ``layer``, such as
``building_polygon``; write it partitioned by ``layer``), so a group is one
pruned scan and one tags join, however many branches its rules have. Branches
become an array per row, then one ``min_by`` per id settles overlaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.functions.tags import has_tag, tag
from terrahaz.operators.relational import first_per, union_all
from terrahaz.operators.spatial import GEOMETRY_COLUMNS


def _in(key: str, values: Sequence[str]):
    return lambda t: tag(t, key).isin(*values)


@dataclass(frozen=True)
class Branch:
    """One rule: layers, a tag or column predicate, and the labels it assigns (None keeps the column)."""

    layers: tuple[str, ...]
    where: object  # Callable[[Column], Column] over the tags
    osm_type: str | None = None
    osm_subtype: str | None = None
    subtype_tag: str | None = None
    needs_tags: bool = True


@dataclass(frozen=True)
class AssetGroup:
    branches: tuple[Branch, ...]
    extra: tuple[str, ...] = field(default=())


# Tag vocabularies of the groups.
POWER_SUBTYPES = ("substation", "line", "plant", "minor_line")
FARM_LANDUSE = ("farmland", "farmyard", "orchard", "vineyard", "meadow", "grassland", "plant_nursery")
FARM_BUILDINGS = ("farm", "barn", "cowshed", "farm_auxiliary", "greenhouse", "silo", "stable", "sty")
TRADE_AMENITIES = (
    "restaurant", "fast_food", "cafe", "pub", "bar", "bank", "clinic", "pharmacy", "cinema", "theatre",
    "nightclub", "fuel", "car_wash", "car_rental")
LODGING = ("hotel", "motel", "guest_house", "hostel", "chalet")
TRADE_BUILDINGS = ("commercial", "industrial", "retail", "warehouse", "office")
TRADE_LANDUSE = ("commercial", "retail", "industrial", "logistics")
PLACES = (
    "country", "state", "region", "province", "district", "county", "municipality", "city", "borough",
    "suburb", "quarter", "neighbourhood", "town", "village", "hamlet")
HOMES = (
    "house", "detached", "semidetached_house", "terrace", "residential", "apartments", "bungalow",
    "cabin", "dormitory", "static_caravan", "hut")


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _place_rule(t: Column) -> Column:
    return tag(t, "place").isin(*PLACES) & ~tag(t, "boundary").eqNullSafe("administrative")


GROUPS: dict[str, AssetGroup] = {
    "power_grid": AssetGroup((
        Branch(("infrastructure_point", "infrastructure_line", "infrastructure_polygon"),
               lambda t: (F.col("osm_type") == "power") & F.col("osm_subtype").isin(*POWER_SUBTYPES)),
    )),
    "data_center": AssetGroup((
        Branch(("building_point", "building_polygon"), lambda t: tag(t, "telecom") == "data_center"),
    ), ("name", "operator")),
    "agriculture": AssetGroup((
        Branch(("landuse_polygon",), _in("landuse", FARM_LANDUSE), "landuse", subtype_tag="landuse"),
        Branch(("building_point", "building_polygon"), _in("building", FARM_BUILDINGS), "building"),
    )),
    "commercial_real_estate": AssetGroup((
        Branch(("shop_point", "shop_polygon"), lambda t: has_tag(t, "shop"), "shop"),
        Branch(("building_point", "building_polygon"),
               lambda t: tag(t, "office").isNotNull() | _false_if_null(tag(t, "building") == "office"),
               "building", "office"),
        Branch(("amenity_point", "amenity_polygon"), _in("amenity", TRADE_AMENITIES), "amenity"),
        Branch(("poi_point", "poi_polygon"), _in("tourism", LODGING), "tourism"),
        Branch(("building_polygon",),
               lambda t: _false_if_null(tag(t, "building").isin(*TRADE_BUILDINGS))
               | _false_if_null(tag(t, "amenity") == "marketplace"), "building"),
        Branch(("landuse_polygon",), _in("landuse", TRADE_LANDUSE), "landuse", subtype_tag="landuse"),
    )),
    "administrative": AssetGroup((
        Branch(("place_polygon",), lambda t: F.col("admin_level").isNotNull(), "place", "boundary",
               needs_tags=False),
        Branch(("place_point", "place_polygon"), _place_rule, "place", subtype_tag="place"),
    ), ("admin_level", "name")),
    "residential_real_estate": AssetGroup((
        Branch(("building_point", "building_polygon"), _in("building", HOMES), "building"),
    )),
}
ACTIVE_GROUPS = ("power_grid", "data_center", "administrative", "agriculture", "commercial_real_estate")


def tag_maps(tags: DataFrame) -> DataFrame:
    """Ids and tags for a join that sorts both sides. Tags come from a text of some bytes a row and are maps of
    hundreds, which no estimate by file size knows: left to the planner they pass whole through the driver as a broadcast."""
    return tags.select("osm_id", "tags").hint("merge")


def asset_groups(names: Sequence[str], features: DataFrame, tags: DataFrame) -> DataFrame:
    """Several asset groups in one pass over the layers and tags (column ``asset_group``).

    Among branches of a group that hold the same id the earliest wins, then type,
    subtype and geometry order, so the result does not depend on partitioning.
    """
    branches = [(g, rank, b) for g in names for rank, b in enumerate(GROUPS[g].branches)]
    layers = sorted({layer for _, _, b in branches for layer in b.layers})
    how = "inner" if all(b.needs_tags for _, _, b in branches) else "left"
    joined = features.filter(F.col("layer").isin(*layers)).join(tag_maps(tags), "osm_id", how)
    t = F.col("tags")
    choices = []
    for g, rank, b in branches:
        subtype = F.lit(b.osm_subtype) if b.osm_subtype else (
            tag(t, b.subtype_tag) if b.subtype_tag else F.col("osm_subtype"))
        hit = F.col("layer").isin(*b.layers) & b.where(t)
        if b.needs_tags:
            hit = hit & t.isNotNull()
        choices.append(F.when(hit, F.struct(
            F.lit(g).alias("asset_group"), F.lit(rank).alias("rank"),
            (F.lit(b.osm_type) if b.osm_type else F.col("osm_type")).alias("osm_type"),
            subtype.alias("osm_subtype"))))
    extra = list(dict.fromkeys(c for g in names for c in GROUPS[g].extra))
    matched = joined.withColumn("_b", F.explode(F.array_compact(F.array(*choices)))).select(
        "_b.asset_group", F.col("_b.rank").alias("_rank"), "osm_id", "_b.osm_type", "_b.osm_subtype",
        *extra, *GEOMETRY_COLUMNS, "tags")
    order = ["_rank", "osm_type", "osm_subtype", "geom_type", "xmin", "ymin", "xmax", "ymax", "parts"]
    return first_per(matched, ["asset_group", "osm_id"], order).drop("_rank")


def asset_group(name: str, features: DataFrame, tags: DataFrame) -> DataFrame:
    """One asset group."""
    return asset_groups([name], features, tags).drop("asset_group")


def asset_pool(groups: DataFrame, named_commercial_only: bool = True) -> DataFrame:
    """Geometries of the long group table; unnamed commercial rows stay out if asked."""
    if named_commercial_only:
        groups = groups.filter((F.col("asset_group") != "commercial_real_estate") | F.col("osm_subtype").isNotNull())
    return groups.select("osm_id", *GEOMETRY_COLUMNS)


def all_groups(groups: dict[str, DataFrame], named_commercial_only: bool = True) -> DataFrame:
    """UNION ALL of group geometries; commercial rows without a subtype stay out if asked."""
    frames = []
    for name, df in groups.items():
        if named_commercial_only and name == "commercial_real_estate":
            df = df.filter(F.col("osm_subtype").isNotNull())
        frames.append(df.select("osm_id", *GEOMETRY_COLUMNS))
    return union_all(frames)


def unexposed(assets: DataFrame, exposure: DataFrame) -> DataFrame:
    """Distinct (id, geometry) of assets without any exposure row."""
    return assets.join(exposure.select("osm_id").hint("merge"), "osm_id", "left_anti").distinct()


# Mapped assets as (category, type, subtype); None takes every subtype.
ASSETS: dict[str, tuple[str, str, str | None]] = {
    "osm-power-plant": ("power_grid", "power", "plant"),
    "osm-power-transmission-line": ("power_grid", "power", "line"),
    "osm-power-distribution-line": ("power_grid", "power", "minor_line"),
    "osm-power-substation": ("power_grid", "power", "substation"),
    "osm-data-center": ("data_center", "building", None),
    "osm-storage-rental": ("commercial_real_estate", "shop", "storage_rental"),
    "osm-commercial-building": ("commercial_real_estate", "building", "commercial"),
    "osm-office-building": ("commercial_real_estate", "building", "office"),
    "osm-hotel": ("commercial_real_estate", "tourism", "hotel"),
    "osm-farmland": ("agriculture", "landuse", "farmland"),
    "osm-vineyard": ("agriculture", "landuse", "vineyard"),
}
# Read from files, outside the map categories.
FILE_ASSETS = ("hifld-power-transmission-line",)

# Display groups and their members.
DISPLAY_GROUPS: dict[str, tuple[str, ...]] = {
    "power-grid": ("osm-power-plant", "osm-power-transmission-line", "osm-power-distribution-line",
                   "osm-power-substation"),
    "data-infrastructure": ("osm-data-center", "osm-power-substation", "osm-power-transmission-line"),
    "commercial-real-estate": ("osm-commercial-building", "osm-office-building", "osm-hotel"),
    "agriculture": ("osm-farmland", "osm-vineyard"),
    "hifld-high-voltage-power-grid": ("hifld-power-transmission-line",),
}


def asset_catalogue(spark) -> DataFrame:
    """asset, category, osm_type, osm_subtype."""
    rows = [(a, *v) for a, v in ASSETS.items()] + [(a, None, None, None) for a in FILE_ASSETS]
    return spark.createDataFrame(
        rows, "asset string, category string, osm_type string, osm_subtype string")


def group_catalogue(spark) -> DataFrame:
    """One row per (display group, asset) with the asset's category columns."""
    groups = spark.createDataFrame(
        [(g, list(members)) for g, members in DISPLAY_GROUPS.items()], "asset_group string, assets array<string>")
    return groups.select("asset_group", F.explode("assets").alias("asset")).join(
        asset_catalogue(spark), "asset", "left")


def in_display_group(df: DataFrame, group: str) -> DataFrame:
    """Rows of an asset-group table (osm_type, osm_subtype) shown under a display group."""
    test = F.lit(False)
    for asset in DISPLAY_GROUPS[group]:
        if asset in ASSETS:
            _, osm_type, subtype = ASSETS[asset]
            rule = F.col("osm_type") == osm_type
            test = test | (rule & (F.col("osm_subtype") == subtype) if subtype else rule)
    return df.filter(test)
