"""View dependencies and refresh: every view is a function DataFrames -> DataFrame.

A refresh writes each view as a Parquet table once its inputs exist and reads
the written table back for its dependents, so lineage is cut at every view and a
lost executor only recomputes within one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from terrahaz.operators import spatial
from terrahaz.plans import asset_groups, hazards


@dataclass(frozen=True)
class View:
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    partition_by: tuple[str, ...] = ()


def _group(name: str) -> View:
    return View(("features", "tags"), lambda features, tags: asset_groups.asset_group(name, features, tags))


def _unexposed(exposure: str, named_only: bool = True, groups: tuple[str, ...] = asset_groups.ACTIVE_GROUPS) -> View:
    def build(*frames: DataFrame) -> DataFrame:
        pool = asset_groups.all_groups(dict(zip(groups, frames)), named_only)
        return asset_groups.unexposed(pool, frames[-1])

    return View((*groups, exposure), build)


def _flood(*frames: DataFrame) -> DataFrame:
    *groups, precip, zones = frames
    pool = asset_groups.all_groups(dict(zip(asset_groups.ACTIVE_GROUPS, groups)), False)
    return hazards.flood(precip, pool, zones)


VIEWS: dict[str, View] = {
    **{g: _group(g) for g in asset_groups.GROUPS},
    "extreme_precip": View(("pfe_mm_day", "pluvial_change_factor"), hazards.extreme_precip, ("ssp",)),
    "wildfire": View(("fwi", "burn_probability"), hazards.wildfire, ("ssp",)),
    "latest_flood_zones": View(("flood_zones",), hazards.latest_zones),
    "flood_zone_pieces": View(("latest_flood_zones",), lambda zones: spatial.subdivide(zones, 64)),
    "flood": View((*asset_groups.ACTIVE_GROUPS, "extreme_precip", "flood_zone_pieces"), _flood, ("ssp",)),
    "unexposed_fwi": _unexposed("fwi"),
    "unexposed_pfe_mm_day": _unexposed("pfe_mm_day"),
    "unexposed_pluvial_change_factor": _unexposed("pluvial_change_factor"),
    "unexposed_burn_probability": _unexposed("burn_probability"),
    "unexposed_pr_percent_change": _unexposed(
        "pr_percent_change", False, (*asset_groups.ACTIVE_GROUPS, "residential_real_estate")),
}


def refresh_order(wanted: Iterable[str]) -> list[str]:
    """Views to rebuild, dependencies first."""
    graph: dict[str, set[str]] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in graph:
            graph[name] = {i for i in VIEWS[name].inputs if i in VIEWS}
            for i in graph[name]:
                add(i)

    for name in wanted:
        if name not in VIEWS:
            raise KeyError(name)
        add(name)
    return list(TopologicalSorter(graph).static_order())


def refresh(spark: SparkSession, sources: dict[str, DataFrame], folder: str, wanted: Iterable[str]) -> dict[str, DataFrame]:
    """Rebuild views into ``folder`` and return them as read back."""
    ready = dict(sources)
    for name in refresh_order(wanted):
        view = VIEWS[name]
        path = f"{folder}/{name}"
        writer = view.build(*[ready[i] for i in view.inputs]).write.mode("overwrite").option(
            "partitionOverwriteMode", "static")
        (writer.partitionBy(*view.partition_by) if view.partition_by else writer).parquet(path)
        ready[name] = spark.read.parquet(path)
    return {n: ready[n] for n in wanted}


def layer_of(name: str) -> str:
    """'group', 'hazard' or 'unexposed' for a view name."""
    return "group" if name in asset_groups.GROUPS else "unexposed" if name.startswith("unexposed") else "hazard"
