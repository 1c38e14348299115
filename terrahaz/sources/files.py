"""File listings, names and file formats as DataFrame inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.sources import geojson
from terrahaz.operators.relational import first_per

DAY_FILE = r"^([^_]+)_day_([^_]+)_([^_]+)_([^_]+)_g[^_]+_(\d{4})(?:_v\d+\.\d+)?\.nc$"
FILE_KEYS = ("variable", "model", "scenario", "member", "year")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Listing of a folder without reading contents."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path).select("path", "length", "modificationTime")
        .withColumn("name", F.element_at(F.split("path", "/"), -1))
    )


def parse_day_files(listing: DataFrame) -> DataFrame:
    """Variable, model, scenario, member and year of daily grid files; other names drop out."""
    def part(i: int) -> Column:
        return F.regexp_extract("name", DAY_FILE, i)

    return (
        listing.filter(F.col("name").rlike(DAY_FILE))
        .withColumns({k: part(i) for i, k in enumerate(FILE_KEYS[:4], start=1)})
        .withColumn("year", part(5).cast("int"))
    )


def pick_files(listing: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Best file per key: version 1.1 before others, then the first name.

    ``variables`` are candidates in order of preference for one slot; the first
    that has a file for a (model, scenario, member, year) wins.
    """
    files = parse_day_files(listing).filter(F.col("variable").isin(*variables))
    rank = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable"))
    ranked = files.withColumns({"_v": rank, "_old": (~F.col("name").contains("_v1.1")).cast("int")})
    return first_per(ranked, FILE_KEYS[1:], ["_v", "_old", "name"]).select(*FILE_KEYS, "name")


def missing_files(expected: DataFrame, picked: DataFrame) -> DataFrame:
    return expected.join(picked, list(FILE_KEYS[1:]), "left_anti")


# Complete year ranges of the two kinds of scenario.
HISTORICAL_YEARS = (1950, 2014)
FUTURE_YEARS = (2015, 2100)


def valid_models(stores: DataFrame, scenario: str, ranges: Sequence[tuple[int, int]] = (HISTORICAL_YEARS, FUTURE_YEARS),
                 ) -> DataFrame:
    """Stores of models whose years are exactly one of the complete ranges.

    ``stores``: path, model, scenario, year. Ensemble outputs are not inputs. A
    year set has at most one entry per calendar year, so counting distinct years
    with their bounds decides equality without collecting them.
    """
    usable = stores.filter(~F.col("path").contains("ENSEMBLE") & (F.col("scenario") == scenario))
    years = usable.groupBy("model").agg(
        F.count_distinct("year").alias("_n"), F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    test = F.lit(False)
    for lo, hi in ranges:
        test = test | ((F.col("_lo") == lo) & (F.col("_hi") == hi) & (F.col("_n") == hi - lo + 1))
    return usable.join(years.filter(test).select("model"), "model", "left_semi")


def store_metadata(df: DataFrame, path: str = "path", anchor: str = "NEX-GDDP-CMIP6") -> DataFrame:
    """Model, scenario, member after the anchor segment and the year range of the name."""
    segments = F.split(F.col(path), "/")
    at = F.array_position(segments, anchor)

    def after(i: int) -> Column:
        return F.when(at > 0, F.try_element_at(segments, (at + i).cast("int")))

    span = r"_(\d{4})-(\d{4})\.zarr$"
    return df.withColumns({
        "model": after(1), "scenario": after(2), "member": after(3),
        "start_year": F.regexp_extract(path, span, 1).try_cast("int"),
        "end_year": F.regexp_extract(path, span, 2).try_cast("int"),
    })


def require_metadata(df: DataFrame) -> DataFrame:
    """Fail the job on a path without complete metadata."""
    checks = [F.col(c).isNull() for c in ("model", "scenario", "member", "start_year", "end_year")]
    broken = checks[0]
    for c in checks[1:]:
        broken = broken | c
    return df.withColumn("model", F.when(
        broken, F.raise_error(F.concat(F.lit("no metadata in "), F.col("path"))).cast("string")
    ).otherwise(F.col("model")))


def name_date(name: Column) -> Column:
    """Date of ``*.YYYYMMDD.nc`` names."""
    return F.try_to_date(F.regexp_extract(name, r"\.(\d{8})\.nc$", 1), "yyyyMMdd")


def effective_date(name: Column) -> Column:
    """Date after an underscore in archive names; invalid gives NULL."""
    return F.try_to_date(F.regexp_extract(name, r"_(\d{8})", 1), "yyyyMMdd")


def download_urls(urls: DataFrame, state: str | None = None, url: str = "url") -> DataFrame:
    """Distinct urls of a state, newest area code first."""
    out = urls.select(url).distinct()
    if state:
        out = out.filter(F.upper(F.trim(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("state"))))) == state.upper())
    code = F.regexp_extract(url, r"DFIRMID=[^&_]*_(\d+)(?:[_&]|$)", 1).try_cast("bigint")
    return out.withColumn("area_code", F.coalesce(code, F.lit(0).cast("bigint"))).orderBy(
        F.desc("area_code"), url)


# Flood shapefile attributes and their table names.
ZONE_ATTRIBUTES = {
    "DFIRM_ID": "dfirm_id", "FLD_AR_ID": "fld_ar_id", "VERSION_ID": "version_id",
    "FLD_ZONE": "flood_zone", "ZONE_SUBTY": "flood_zone_subtype", "SFHA_TF": "is_sfha",
    "STATIC_BFE": "static_bfe", "DEPTH": "flood_depth",
}
NUMERIC_ATTRIBUTES = ("STATIC_BFE", "DEPTH")


def project_zones(raw: DataFrame, source_url: Column, lomr: Column) -> DataFrame:
    """Table columns of a flood layer; attributes a file lacks become NULL, and elevation and depth are numbers in any case."""
    cols = [
        (F.col(a) if a in raw.columns else F.lit(None).cast("string")).alias(b) if a not in NUMERIC_ATTRIBUTES
        else (F.col(a).cast("string").try_cast("double") if a in raw.columns else F.lit(None).cast("double")).alias(b)
        for a, b in ZONE_ATTRIBUTES.items()
    ]
    geometry = [F.col(c) for c in ("geom_type", "parts", "xmin", "ymin", "xmax", "ymax") if c in raw.columns]
    return raw.select(*cols, lomr.alias("lomr_effective_date"), source_url.alias("source_url"), *geometry)


def read_geojson_assets(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Features of several GeoJSON collections tagged with their asset name; an unreadable one is skipped.

    A document is read in splits (see ``sources.geojson``), so one of any size spreads over tasks.
    """
    names = F.create_map(*[F.lit(x) for path, asset in files.items() for x in (path.split("/")[-1], asset)])
    rows = geojson.read_features(spark, list(files)).select(
        F.try_element_at(names, F.element_at(F.split("file", "/"), -1)).alias("asset_name"), "feature")
    return geojson_features(rows)


def geojson_features(rows: DataFrame, feature: str = "feature") -> DataFrame:
    """Geometry columns and a property map from feature texts."""
    geometry = F.get_json_object(F.col(feature), "$.geometry")
    kind = F.get_json_object(F.col(feature), "$.geometry.type")
    props = F.coalesce(
        F.from_json(F.get_json_object(F.col(feature), "$.properties"), "map<string,string>"),
        F.create_map().cast("map<string,string>"))
    out = rows.withColumns({
        "properties": props, "geom_type": F.concat(F.lit("ST_"), kind),
        "parts": geo.geojson_parts(geometry),
    }).drop(feature)
    return geo.with_envelope(out)


def quarantine(rows: DataFrame, feature: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Valid feature rows and the rejected rest."""
    flagged = rows.withColumn("_ok", geo.geojson_valid(F.col(feature)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter(~F.col("_ok")).drop("_ok")


INCOME_SCHEMA = "STATE string, zipcode string, N1 double, A00100 double"


def read_income(spark: SparkSession, path: str, state: str) -> DataFrame:
    """Yearly income tables; the year stands in the first two characters of the file name."""
    raw = spark.read.option("header", "true").csv(path)
    lower = {c.lower(): c for c in raw.columns}
    picked = raw.select(
        F.col(lower["state"]).alias("state"), F.col(lower["zipcode"]).alias("zipcode"),
        F.col(lower["n1"]).try_cast("double").alias("returns"),
        F.col(lower["a00100"]).try_cast("double").alias("agi"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return income_rows(picked, state)


def income_rows(raw: DataFrame, state: str) -> DataFrame:
    year = F.concat(F.lit("20"), F.substring("file", 1, 2)).try_cast("int")
    return raw.filter(F.col("state") == state).select(
        year.alias("year"), "zipcode", "returns", "agi").na.drop()


def pending(expected: DataFrame, written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outputs not yet in the catalogue of written ones."""
    return expected.join(written.select(*keys), list(keys), "left_anti")


def event_rows(events: DataFrame, kind: str, year: int, state: str) -> DataFrame:
    """Events of one kind that began in a year, by id prefix of the state."""
    return events.filter(
        (F.col("incident_type") == kind) & (F.year("ignition_date") == year)
        & F.col("event_id").startswith(state.upper()))
