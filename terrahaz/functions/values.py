"""Scalar column rules: longitudes, units, labels, scenarios, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seven statistics carried by every ensemble table.
STATISTICS = ("mean", "median", "stddev", "min", "max", "q1", "q3")
ENSEMBLE_COLUMNS = tuple(f"ensemble_{s}" for s in STATISTICS)

# Time keys of the two kinds of exposure table.
TIME_KEYS = {
    "decade_month": ("month", "decade", "ssp"),
    "year_span_month": ("month", "start_year", "end_year", "ssp"),
}

SECONDS_PER_DAY = 86400e0
KELVIN_OFFSET = 273.15e0


def lit(value: float) -> Column:
    return F.lit(float(value))


def wrap_lon(lon: Column) -> Column:
    """0..360 -> -180..180."""
    return F.pmod(lon + lit(180), lit(360)) - lit(180)


def unwrap_lon(lon: Column) -> Column:
    """-180..180 -> 0..360."""
    return F.pmod(lon, lit(360))


def to_celsius(value: Column, unit: Column) -> Column:
    return F.when(unit.isin("K", "Kelvin", "kelvin"), value - lit(KELVIN_OFFSET)).otherwise(value)


def to_mm_day(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit) == "kg m-2 s-1", value * lit(SECONDS_PER_DAY)).otherwise(value)


def decade_of(year: Column) -> Column:
    return (year - F.pmod(year, F.lit(10))).cast("int")


def decade_month_label(decade: Column, month: Column) -> Column:
    return F.concat_ws("-", decade.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def label_decade(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int")


def label_month(label: Column) -> Column:
    return F.substring(label, -2, 2).cast("int")


def span_label(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def span_start(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int")


def span_end(label: Column) -> Column:
    return F.substring(label, 6, 4).cast("int")


def encode_ssp(scenario: Column) -> Column:
    """'historical' -> -999, 'ssp245' or '245' -> 245, anything else NULL."""
    return F.when(scenario == "historical", F.lit(-999)).otherwise(
        F.regexp_replace(scenario, "^ssp", "").try_cast("int")
    )


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def round_ensemble(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumns({
        c: half_even(F.col(c), digits) for c in df.columns if c.startswith("ensemble_")
    })


def rename_statistics(df: DataFrame) -> DataFrame:
    """value_* -> ensemble_*, without the count."""
    names = {c: "ensemble_" + c[len("value_"):] for c in df.columns if c.startswith("value_")}
    return df.withColumnsRenamed(names).drop("ensemble_count")


def exposure_contract(df: DataFrame, time_type: str, return_period: bool = False) -> DataFrame:
    """Project onto the declared columns of an exposure table; a gap is an error."""
    if time_type not in TIME_KEYS:
        raise ValueError(f"unknown time type {time_type!r}")
    wanted = ["osm_id", *TIME_KEYS[time_type]]
    if return_period:
        wanted.append("return_period")
    wanted += [*ENSEMBLE_COLUMNS, "metadata"]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*wanted)


def metadata_json(attrs: Column, extra: dict[str, str | Column]) -> Column:
    """JSON text of the source attributes plus derived entries (which win), keys in order."""
    pairs = [x for k, v in extra.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]
    own = F.map_filter(attrs, lambda k, _: ~k.isin(*extra)) if extra else attrs
    merged = F.map_concat(own, F.create_map(*pairs)) if pairs else own
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))


def check_lon_lat(xmin: float, ymin: float, xmax: float, ymax: float) -> None:
    if not all(-180 <= x <= 180 for x in (xmin, xmax)):
        raise ValueError("longitude must lie in [-180, 180]")
    if not all(-90 <= y <= 90 for y in (ymin, ymax)):
        raise ValueError("latitude must lie in [-90, 90]")


def band_label(value: Column, bands: Sequence[tuple[str, float | None, float | None]], default: str) -> Column:
    """First band with min <= value < max; an open end is None."""
    expr = F.lit(default)
    for label, low, high in reversed(list(bands)):
        test = F.lit(True)
        if low is not None:
            test = test & (value >= lit(low))
        if high is not None:
            test = test & (value < lit(high))
        expr = F.when(value.isNotNull() & test, F.lit(label)).otherwise(expr)
    return expr


def category_label(value: Column, categories: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


# kV classes of power lines.
VOLTAGE_BANDS = [
    ("0-100", 0, 100), ("100-300", 100, 300), ("300-500", 300, 500), ("500+", 500, None),
]

# Fire-weather classes used by analysts.
FIRE_BANDS = [
    ("low", 0, 5), ("moderate", 5, 10), ("high", 10, 20), ("very high", 20, 30), ("extreme", 30, None),
]


def year_component(decade: Column, periods: Sequence[tuple[int, int]]) -> Column:
    """Period label holding a decade; 2100 falls in the last one, no match gives the decade."""
    expr = decade.cast("string")
    if not periods:
        return expr
    labels = [f"{a}-{b}" for a, b in periods]
    expr = F.when(decade == 2100, F.lit(labels[-1])).otherwise(expr)
    for (start, end), label in reversed(list(zip(periods, labels))):
        expr = F.when((decade >= start) & (decade < end), F.lit(label)).otherwise(expr)
    return expr


def raster_name(measure: Column, component: Column, month: Column, resolution: str,
                return_period: Column | None = None) -> Column:
    parts = [measure, component, F.lpad(month.cast("string"), 2, "0")]
    if return_period is not None:
        parts.append(return_period.cast("string"))
    return F.concat(F.concat_ws("-", *parts, F.lit("global"), F.lit(resolution)), F.lit(".tif"))


def content_hash(representations: Sequence[Column]) -> Column:
    """SHA-256 over the sorted, type-prefixed texts, each followed by a pipe sign."""
    ordered = F.array_sort(F.array(*representations))
    return F.sha2(F.concat(F.array_join(ordered, "|"), F.lit("|")), 256)


def typed_text(value: Column, kind: str) -> Column:
    """Type prefix: s text, d object, l list (both given as JSON), n number or boolean, x null.

    Objects and lists are written compactly with sorted keys at every depth, booleans as true and false.
    """
    if kind == "x":
        return F.lit("x:null")
    if kind in ("d", "l"):
        value = F.to_json(F.parse_json(value))
    return F.concat(F.lit(kind + ":"), value.cast("string"))


def download_name(category: Column, osm_type: Column, ident: Column, subtypes: Column | None = None,
                  variable: Column | None = None, ssp: Column | None = None,
                  decade: Column | None = None) -> Column:
    """category_type[_subtype-a-b][_climate-v_sspN[_Ds]]_id; absent parts are skipped."""
    parts = [category, osm_type]
    if subtypes is not None:
        parts.append(F.when(F.size(subtypes) > 0, F.concat(F.lit("subtype-"), F.array_join(subtypes, "-"))))
    if variable is not None:
        parts.append(F.concat(F.lit("climate-"), variable))
        parts.append(F.when(variable.isNotNull(), F.concat(F.lit("ssp"), ssp.cast("string"))))
        if decade is not None:
            parts.append(F.when(variable.isNotNull(), F.concat(decade.cast("string"), F.lit("s"))))
    return F.concat_ws("_", *parts, ident)


def investor_view(df: DataFrame, id_col: str, columns: Sequence[str], percent: int = 60,
                  bucket: Column | None = None) -> DataFrame:
    """NULL the listed columns for a fixed share of ids, chosen by a hash of the id."""
    key = bucket if bucket is not None else F.pmod(F.xxhash64(id_col), F.lit(100))
    return df.withColumns({c: F.when(key >= percent, F.col(c)) for c in columns})


# Lanczos series for the gamma function (g = 7, n = 9); fixed values.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0 as a column expression."""
    z = x - lit(1)
    series = lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + lit(c) / (z + lit(i))
    t = z + lit(7.5)
    return lit(0.9189385332046727) + (z + lit(0.5)) * F.ln(t) - t + F.ln(series)


def gamma(x: Column) -> Column:
    return F.exp(log_gamma(x))
