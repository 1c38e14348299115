"""Indicator registry and the climate job built on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.operators import climate, grid
from terrahaz.operators.relational import union_all
from terrahaz.sources.files import pending

SERIES_CELL = (*climate.SERIES, "lat", "lon")


@dataclass(frozen=True)
class Indicator:
    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    compute: Callable[..., DataFrame]
    enabled: bool = True


INDICATORS: dict[str, Indicator] = {}


def indicator(name: str, inputs: Sequence[str], outputs: Sequence[str], enabled: bool = True):
    """Register a DataFrame transform (daily, context) -> daily rows with the output columns."""
    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        INDICATORS[name] = Indicator(name, tuple(inputs), tuple(outputs), fn, enabled)
        return fn

    return register


@indicator("fwi", ("tasmax", "pr", "hurs", "sfcwind"), ("ffmc", "dmc", "dc", "isi", "bui", "fwi"))
def _fwi(daily: DataFrame, context: dict) -> DataFrame:
    return climate.fwi(daily, context.get("init"), context.get("block_deg", 2.0))


@indicator("pr_percent_change", ("pr",), ("pr_percent_change",))
def _pr_percent_change(daily: DataFrame, context: dict) -> DataFrame:
    keys = ["model", "member", "lat", "lon"]
    base = context.get("baseline")
    if base is None:
        base = climate.baseline_doy(context.get("historical", daily), keys, "pr",
                                    *context.get("base_years", climate.BASE_YEARS))
    return climate.precip_pct_change(daily, base, keys)


@indicator("spei", ("pr", "tasmin", "tasmax"), ("spei",), enabled=False)
def _spei(daily: DataFrame, context: dict) -> DataFrame:
    """Monthly index laid back onto the days of the input."""
    keys = ["model", "member", "lat", "lon"]
    record = daily.select(*keys, "date", "pr", "tasmin", "tasmax")
    if "historical" in context:
        record = climate.concat_time(context["historical"].select(*record.columns), record, keys)
    first, last = context.get("base_years", climate.BASE_YEARS)
    monthly = climate.spei(climate.pet_hargreaves(record), keys, context.get("scale", 3), first, last)
    return climate.monthly_onto_days(monthly, daily.select(*SERIES_CELL, "date"), keys, "spei")


def ready_indicators(daily: DataFrame, names: Sequence[str] | None = None) -> tuple[list[str], dict[str, list[str]]]:
    """Indicators whose inputs exist, and the missing inputs of the others."""
    wanted = list(names) if names is not None else [n for n, i in INDICATORS.items() if i.enabled]
    gaps = {n: [c for c in INDICATORS[n].inputs if c not in daily.columns] for n in wanted}
    return [n for n in wanted if not gaps[n]], {n: g for n, g in gaps.items() if g}


def monthly_indicators(daily: DataFrame, names: Sequence[str] | None = None, context: dict | None = None,
                       written: DataFrame | None = None) -> DataFrame:
    """Monthly means of indicators, long form: one row per (indicator, series, cell, month).

    Months that the catalogue ``written`` (indicator, model, scenario, member,
    year) already holds are not recomputed: they leave before the indicator runs.
    An input that is missing fails the job after naming every gap.
    """
    ready, gaps = ready_indicators(daily, names)
    if gaps:
        raise ValueError(f"missing inputs {gaps}")
    frames = []
    for name in ready:
        spec = INDICATORS[name]
        todo = daily
        if written is not None:
            years = daily.withColumn("year", F.year("date"))
            todo = pending(years, written.filter(F.col("indicator") == name),
                           [*climate.SERIES, "year"]).select(*daily.columns)
        monthly = grid.monthly_mean(spec.compute(todo, context or {}), SERIES_CELL, spec.outputs)
        frames.append(long_form(monthly, [*SERIES_CELL, "month_start"], spec.outputs))
    return union_all(frames)


def long_form(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "indicator") -> DataFrame:
    """One row per value column."""
    return df.unpivot(list(keys), list(values), name, "value")


def ensemble_by_variable(df: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Ensemble statistics of several variables in one pass, each on its own non-NULL rows."""
    long = long_form(df.select(*keys, "model", *variables), [*keys, "model"], variables, "variable")
    return grid.ensemble_stats(long, ["variable", *keys], "value")
