"""Asset query: filtered assets with administrative names and hazard rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.functions.values import ENSEMBLE_COLUMNS, check_lon_lat
from terrahaz.operators import spatial
from terrahaz.operators.relational import union_all
from terrahaz.plans.asset_groups import tag_maps

# Queryable categories and whether they carry subtypes.
CATEGORIES = {
    "power_grid": True, "amenity": True, "place": False, "landuse": False, "data_center": True,
    "commercial_real_estate": True, "agriculture": True, "administrative": True,
}
# Administrative levels behind the two name columns.
ADMIN_LEVELS = {"county": 6, "city": 8}
# Value columns a hazard contributes.
HAZARD_COLUMNS = {
    "wildfire": ("ensemble_mean", "ensemble_mean_historical_baseline", "burn_probability"),
    "flood": ("return_period", "ensemble_median", "ensemble_q3", "ensemble_median_historical_baseline",
              "ensemble_q3_historical_baseline", "flood_zone", "flood_zone_subtype", "is_sfha",
              "flood_depth"),
}
DEFAULT_HAZARD_COLUMNS = ("ensemble_mean", "ensemble_mean_historical_baseline")


@dataclass(frozen=True)
class AssetQuery:
    """Validated request."""

    category: str
    osm_types: Sequence[str]
    osm_subtypes: Sequence[str] | None = None
    boxes: Sequence[tuple[float, float, float, float]] | None = None
    geom_type: str | None = None
    variable: str | None = None
    ssp: int | None = None
    months: Sequence[int] | None = None
    decades: Sequence[int] | None = None
    limit: int | None = None
    centroid: bool = False
    admin: Sequence[str] = ("county", "city")
    city_type_only: bool = False
    include_metadata: bool = False
    full_statistics: bool = False

    def __post_init__(self):
        if self.category not in CATEGORIES:
            raise ValueError(f"{self.category} is not available")
        hazard = {"variable": self.variable, "ssp": self.ssp, "months": self.months, "decades": self.decades}
        if any(v is not None for v in hazard.values()):
            for name, value in hazard.items():
                if value is None:
                    raise ValueError(f"{name} is required when requesting hazard data")
        for box in self.boxes or ():
            check_lon_lat(*box)
        if not CATEGORIES[self.category]:
            object.__setattr__(self, "osm_subtypes", None)

    @property
    def wants_hazard(self) -> bool:
        return bool(self.variable and self.ssp and self.months and self.decades)


def filter_assets(assets: DataFrame, q: AssetQuery) -> DataFrame:
    out = assets.filter(F.col("osm_type").isin(*q.osm_types))
    if q.osm_subtypes:
        out = out.filter(F.col("osm_subtype").isin(*q.osm_subtypes))
    if q.geom_type:
        out = out.filter(F.col("geom_type") == "ST_" + q.geom_type)
    if q.boxes:
        out = spatial.in_boxes(out, q.boxes)
    return out


def filter_hazard(hazard: DataFrame, q: AssetQuery) -> DataFrame:
    return hazard.filter(
        (F.col("ssp") == q.ssp) & F.col("decade").isin(*set(q.decades)) & F.col("month").isin(*set(q.months)))


def admin_names(assets: DataFrame, places: DataFrame, tile_deg: float = 0.5,
                wanted: Sequence[str] = tuple(ADMIN_LEVELS), city_type_only: bool = False) -> DataFrame:
    """Assets with county and city names: one row per overlapping combination, NULL when none.

    Both levels ride on one tile join. The names of an asset are gathered into
    two arrays, at most one entry per administrative area, and fan out again.
    """
    levels = [ADMIN_LEVELS[w] for w in wanted]
    areas = places.filter(F.col("admin_level").isin(*levels))
    if city_type_only:
        areas = areas.filter((F.col("admin_level") != ADMIN_LEVELS["city"]) | (F.col("osm_type") == "city"))
    hits = spatial.intersecting(
        assets.select("osm_id", *spatial.GEOMETRY_COLUMNS),
        areas.select("name", "admin_level", *spatial.GEOMETRY_COLUMNS), tile_deg)
    per_asset = hits.groupBy("osm_id").agg(*[
        F.collect_list(F.when(F.col("admin_level") == ADMIN_LEVELS[w], F.struct("name"))).alias(w)
        for w in wanted])
    out = assets.join(per_asset, "osm_id", "left")
    for w in wanted:
        out = out.withColumn(w, F.explode_outer(w)).withColumn(w, F.col(f"{w}.name"))
    return out


def hazard_columns(q: AssetQuery, hazard: DataFrame) -> list[str]:
    if q.full_statistics:
        cols = [c for c in ENSEMBLE_COLUMNS if c in hazard.columns]
    else:
        cols = list(HAZARD_COLUMNS.get(q.variable, DEFAULT_HAZARD_COLUMNS))
    return cols + (["metadata"] if q.include_metadata else [])


def asset_query(q: AssetQuery, assets: DataFrame, tags: DataFrame, places: DataFrame,
                hazard: DataFrame | None = None) -> DataFrame:
    """Rows of (asset x county x city x hazard time).

    Assets without hazard rows cannot appear, so they leave before the spatial
    join (left semi), which is the expensive step.
    """
    keep = ["osm_id", "osm_type", *(["osm_subtype"] if q.osm_subtypes else [])]
    rows = filter_assets(assets, q).select(*keep, *spatial.GEOMETRY_COLUMNS).join(
        tag_maps(tags), "osm_id")
    chosen = None
    if q.wants_hazard:
        chosen = filter_hazard(hazard, q).select(
            "osm_id", "ssp", "month", "decade", *hazard_columns(q, hazard))
        rows = rows.join(chosen.select("osm_id"), "osm_id", "left_semi")
    if q.admin:
        rows = admin_names(rows, places, wanted=q.admin, city_type_only=q.city_type_only)
    c = geo.centroid()
    rows = rows.withColumn("_c", c).withColumns({
        "geometry_wkt": geo.to_wkt(digits=3),
        "longitude": F.col("_c.x"), "latitude": F.col("_c.y"),
    }).drop("_c", *spatial.ENVELOPE)
    if q.centroid:
        kind, parts = geo.display_geometry()
        rows = rows.withColumns({"geom_type": kind, "parts": parts})
    if chosen is not None:
        rows = rows.join(chosen, "osm_id")
    if q.limit:
        order = [x for x in ("osm_id", *q.admin, "decade", "month", "return_period") if x in rows.columns]
        rows = rows.orderBy(*order).limit(q.limit)
    return rows


def asset_queries(queries: Sequence[AssetQuery], groups: dict[str, DataFrame], tags: DataFrame,
                  places: DataFrame, hazard: DataFrame | None = None) -> DataFrame:
    """Several categories in one plan."""
    return union_all([
        asset_query(q, groups[q.category], tags, places, hazard).withColumn("category", F.lit(q.category))
        for q in queries])


TIME_COLUMNS = ("ssp", "month", "decade", "return_period")
DROPPED = ("geometry_wkt", "latitude", "longitude")


def condense(rows: DataFrame, compat: bool = False) -> DataFrame:
    """One row per asset (and hazard time) with its distinct counties and cities, NULLs kept.

    ``compat`` keeps one row per asset, the values of its first hazard time.
    Name sets are combined on the map side.
    """
    times = [c for c in TIME_COLUMNS if c in rows.columns]
    names = [c for c in ("city", "county") if c in rows.columns]
    keys = ["osm_id"] if compat else ["osm_id", *times]
    rest = [c for c in rows.columns if c not in (*keys, *names, *DROPPED)]
    order = F.struct(*(times or [F.lit(0).alias("o")]))
    def unwrapped(n: str) -> Column:
        return F.transform(F.array_sort(F.collect_set(F.struct(n))), lambda s: s[n]).alias(n)

    out = rows.filter(F.col("osm_id").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), order).alias("_p"), *[unwrapped(n) for n in names])
    return out.select(*keys, "_p.*", *names)


def features(rows: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per row; everything but the geometry becomes a property."""
    props = [c for c in rows.columns if c not in ("geom_type", "parts")]
    return rows.select(
        "osm_id",
        F.concat(
            F.lit('{"type":"Feature","geometry":'),
            geo.to_geojson_geometry(),
            F.lit(',"properties":'), F.to_json(F.struct(*props), {"ignoreNullFields": "false"}), F.lit("}"),
        ).alias("feature"),
    )


def properties_table(feature_text: Column, schema: str) -> Column:
    """Typed properties of GeoJSON feature texts (select ``.*`` of it)."""
    return F.from_json(F.get_json_object(feature_text, "$.properties"), schema)


def hazard_change(rows: DataFrame, mean: str = "ensemble_mean",
                  baseline: str = "ensemble_mean_historical_baseline") -> DataFrame:
    """Absolute and percent change against the baseline."""
    return rows.withColumns({
        "change": F.col(mean) - F.col(baseline),
        "pct_change": F.try_divide(F.col(mean) - F.col(baseline), F.col(baseline)) * 100.0,
    })


def flood_risk_class(rows: DataFrame) -> DataFrame:
    """Emerging risk: outside the mapped hazard area yet rising; compounding: inside and rising."""
    rise = F.col("ensemble_q3") - F.col("ensemble_q3_historical_baseline")
    return rows.withColumn("q3_change", rise).withColumn(
        "risk_class",
        F.when((F.col("is_sfha") == "T") & (rise > 0), "compounding")
        .when(F.coalesce(F.col("is_sfha") != "T", F.lit(True)) & (rise > 0), "emerging")
        .otherwise("stable"))


def largest(rows: DataFrame, measure: str, k: int, ties: Sequence[str] = ("osm_id",)) -> DataFrame:
    """The ``k`` rows of greatest ``measure`` (rows without one are left out), ties in the order of ``ties``."""
    return rows.filter(F.col(measure).isNotNull()).orderBy(F.desc(measure), *ties).limit(k)


def ranked_flood_risk(rows: DataFrame, kind: str, k: int, ties: Sequence[str] = ("osm_id",)) -> DataFrame:
    """Rows of the greatest rise in extreme rain: ``emerging`` ones outside, ``compounding`` ones inside the mapped hazard area."""
    if kind not in ("emerging", "compounding"):
        raise ValueError(f"unknown kind of risk {kind!r}")
    return largest(flood_risk_class(rows).filter(F.col("risk_class") == kind), "q3_change", k, ties)


def combined_fire_risk(rows: DataFrame, k: int, ties: Sequence[str] = ("osm_id", "month", "decade", "ssp")) -> DataFrame:
    """Rows of the greatest product of fire weather and burn probability."""
    return largest(rows.withColumn("risk", F.col("ensemble_mean") * F.col("burn_probability")), "risk", k, ties)


def metadata_lookup(table: DataFrame, variable: str, ssp: int) -> DataFrame:
    return table.filter((F.col("variable") == variable) & (F.col("ssp") == ssp)).select("metadata").distinct()


# Fixed value: largest area a download may cover.
MAX_DOWNLOAD_KM2 = 1000.0


def downloadable(boxes: DataFrame, keys: list[str], limit: float = MAX_DOWNLOAD_KM2) -> DataFrame:
    """Total approximate area of the boxes of each request and whether it may be downloaded."""
    area = geo.approx_box_km2(*[F.col(c) for c in spatial.ENVELOPE])
    return boxes.groupBy(*keys).agg(F.sum(area).alias("area_km2")).withColumn(
        "allowed", (F.col("area_km2") > 0) & (F.col("area_km2") <= limit))


def asset_scan(unexposed: DataFrame) -> DataFrame:
    """Un-exposed ids with their geometry as text."""
    return unexposed.select("osm_id", geo.to_wkt().alias("geometry"))
