"""Physical plans of every registered batch query."""

import re

import pytest

import __spark_entry__ as entry
from checks import harness

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in harness.QUERIES if not n.startswith("stream_"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_or_row_udfs(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct|BatchEvalPython\b", text), text[:2000]


@pytest.mark.parametrize("name", ["latest_flood_zones", "asset_latest_zone", "exposure_job"])
def test_rows_are_picked_without_sort_aggregates(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "SortAggregate" not in text and "WindowGroupLimit" in text


def test_drought_index_needs_two_exchanges_after_the_scan(spark):
    text = plan(entry.queries()["drought_l_moments"](spark, SF))
    by_cell = re.findall(r"Exchange hashpartitioning\([^)]*\)[^\n]*", text)
    assert not any("REPARTITION" in line for line in by_cell)


def test_columns_are_pruned_at_the_scan(spark):
    text = plan(entry.queries()["hazard_extreme_precip"](spark, SF))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert "l_extendedprice" not in schema


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["hazard_extreme_precip"](spark, SF))
    assert "EqualTo(l_linestatus,O)" in text


def test_tags_are_joined_without_a_broadcast(spark):
    from pyspark.sql import functions as F

    from terrahaz.functions import geometry as geo
    from terrahaz.plans import asset_groups, asset_query as Q

    layers = geo.with_point(spark.range(4).select(
        F.col("id").alias("osm_id"), F.lit("building_point").alias("layer"), F.lit("building").alias("osm_type"),
        F.lit("sub").alias("osm_subtype"), F.lit("ST_Point").alias("geom_type")), F.lit(1.0), F.lit(2.0))
    tags = spark.range(3).select(F.col("id").alias("osm_id"), F.create_map(
        F.lit("building"), F.when(F.col("id") < 2, "office").otherwise("house")).alias("tags"))
    group = asset_groups.asset_group("commercial_real_estate", layers, tags).drop("tags")
    found = Q.asset_query(Q.AssetQuery("commercial_real_estate", ["building"], admin=()), group, tags, layers)
    for df, joins in ((group, 1), (found, 2)):
        assert "BroadcastHashJoin" not in plan(df) and plan(df).count("SortMergeJoin") == joins
        assert sorted(r["osm_id"] for r in df.select("osm_id").collect()) == [0, 1]


def test_keyed_tables_are_joined_without_a_broadcast(spark):
    from checks.harness import Tables
    from terrahaz.plans import asset_groups, hazards

    fwi = spark.createDataFrame([(1, 1, 2020, 585, 2.0), (1, 1, 2020, -999, 4.0), (2, 1, 2020, 585, 3.0), (None, 1, 2020, 585, 1.0)],
                                "osm_id long, month int, decade int, ssp int, ensemble_mean double")
    burn = spark.createDataFrame([(1, 0.5), (3, 0.25)], "osm_id long, burn_probability double")
    fire = hazards.wildfire(fwi, burn)
    assert sorted((r["osm_id"] or 0, r["ssp"], r["burn_probability"]) for r in fire.collect()) == [
        (0, 585, None), (1, -999, 0.5), (1, 585, 0.5), (2, 585, None)]
    bare = asset_groups.unexposed(spark.range(4).withColumnRenamed("id", "osm_id"), burn)
    assert sorted(r["osm_id"] for r in bare.collect()) == [0, 2]
    for df in (bare, fire.drop("ensemble_mean_historical_baseline"), Tables(spark, SF).fx_layers):
        assert "SortMergeJoin" in plan(df)
    assert "BroadcastHashJoin" not in plan(bare) + plan(Tables(spark, SF).fx_layers)


def test_outlines_are_made_for_the_newest_zones_only(spark):
    from pyspark.sql import functions as F

    from terrahaz.functions import geometry as geo
    from terrahaz.plans import hazards

    zones = spark.createDataFrame(
        [("a", "2001-01-01", 1, 0.0), ("a", "2002-01-01", 2, 5.0), ("b", None, 1, 1.0), ("b", None, 2, 2.0), (None, None, 1, 7.0)],
        "fld_ar_id string, lomr string, zone_rank long, x double").withColumn("lomr_effective_date", F.to_date("lomr"))
    met = []

    def outline(df):
        met.append(df.count())
        return geo.with_box(df, F.col("x"), F.lit(0.0), F.col("x") + 1, F.lit(1.0))

    late = hazards.latest_zones_subdivided(zones, 64, outline)
    early = hazards.latest_zones_subdivided(outline(zones), 64)
    assert met == [3, 5]
    assert sorted(map(str, late.collect())) == sorted(map(str, early.select(*late.columns).collect()))
    assert sorted(r["x"] for r in late.collect()) == [1.0, 5.0, 7.0]
