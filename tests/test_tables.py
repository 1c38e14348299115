"""Views, requests, files, sinks and streaming."""

import datetime
import json
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks.groups import features, tags
from checks.harness import Tables
from checks.shapes import admin_geometry, zone_geometry
from terrahaz.functions import tags as T
from terrahaz.functions import values as V
from terrahaz.operators import climate as C
from terrahaz.operators import relational as R
from terrahaz.plans import asset_groups, asset_query as Q, dag, hazards
from terrahaz.sources import files, registry, sinks
from terrahaz.sources import geojson, versions
from terrahaz.streaming import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_descending_decades_drop_the_row(spark):
    df = spark.createDataFrame([(2092, 2099), (2015, 2044)], "a int, b int")
    out = df.withColumn("d", F.explode(hazards.decades_starting_in(F.col("a"), F.col("b"))))
    assert sorted(r["d"] for r in out.collect()) == [2020, 2030, 2040]


def test_latest_keeps_all_null_groups(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 6), (2, "2001-01-01", 7), (2, None, 8)], "k int, d string, v int")
    got = {r["k"]: r["v"] for r in R.latest_per(df, ["k"], ["d", "v"]).collect()}
    assert got == {1: 6, 2: 7}


def test_results_do_not_depend_on_partitioning(spark, t):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = asset_groups.asset_group("commercial_real_estate", features(t), tags(t))
        return sorted(map(str, out.select("osm_id", "osm_type", "osm_subtype", "geom_type").collect()))

    one, many = run(1), run(200)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == many


def test_unique_key_check(spark):
    R.assert_unique(spark.range(5), ["id"])
    with pytest.raises(ValueError):
        R.assert_unique(spark.range(5).withColumn("k", F.lit(1)), ["k"])


@pytest.mark.parametrize("text,kv", [
    ("115000;230000", 230.0), ("Medium", 20.0), ("120kv", 120.0), ("x", None), (" 230000 ", 230.0), ("?", None),
    ("115.5kv", 115.0), ("13800/7200", 13.8), ("110kv;220kv", 0.22), ("a,b", None), ("1.1e5", 110.0), (None, None)])
def test_voltage(spark, text, kv):
    r = spark.createDataFrame([(text,)], "v string").select(T.line_kv(F.col("v")).alias("kv")).first()
    assert r["kv"] == (kv if kv is None else pytest.approx(kv))


@pytest.mark.parametrize("text,want", [
    ('{"a":"1","b":"x"}', {"a": "1", "b": "x"}), ("a=1; b = 2;a=3", {"a": "3", "b": "2"}), ("plain", {"original_tag": "plain"}),
    ("", {}), (None, {})])
def test_tag_text(spark, text, want):
    r = spark.createDataFrame([(text,)], "v string").select(T.parse_tag_text(F.col("v")).alias("m")).first()
    assert r["m"] == want


def test_tag_columns_are_listed(t):
    df = tags(t).withColumn("osm_subtype", F.lit("plant"))
    pairs = T.tag_columns(df)
    assert ("plant", "voltage") in pairs and T.widen_tags(df).columns[-1].startswith("plant;")


def test_hash_ignores_argument_order(spark):
    parts = [V.typed_text(F.lit("a"), "s"), V.typed_text(F.lit(3), "n"), V.typed_text(F.lit(None), "x")]
    r = spark.range(1).select(V.content_hash(parts).alias("a"), V.content_hash(parts[::-1]).alias("b")).first()
    import hashlib

    assert r["a"] == r["b"] == hashlib.sha256(b"n:3|s:a|x:null|").hexdigest()


def test_contract_rejects_missing_columns(spark):
    with pytest.raises(ValueError):
        V.exposure_contract(spark.range(1).withColumnRenamed("id", "osm_id"), "decade_month")


def test_derived_metadata_wins(spark):
    attrs = F.create_map(F.lit("zonal_method"), F.lit("old"), F.lit("a"), F.lit("b"))
    r = spark.range(1).select(V.metadata_json(attrs, {"zonal_method": "mean"}).alias("m")).first()
    assert json.loads(r["m"]) == {"a": "b", "zonal_method": "mean"}


def test_coordinate_range():
    with pytest.raises(ValueError):
        V.check_lon_lat(-190, 0, 10, 10)
    with pytest.raises(ValueError):
        V.check_lon_lat(-10, -91, 10, 10)


def test_request_validation():
    with pytest.raises(ValueError):
        Q.AssetQuery("nowhere", ["power"])
    with pytest.raises(ValueError):
        Q.AssetQuery("power_grid", ["power"], variable="wildfire")
    q = Q.AssetQuery("place", ["city"], osm_subtypes=["a"])
    assert q.osm_subtypes is None and not q.wants_hazard
    assert not Q.AssetQuery("power_grid", ["p"], variable="w", ssp=0, months=[1], decades=[2000]).wants_hazard


def test_year_sets(spark):
    def stores(model, years):
        return [(f"p/{model}/{y}", model, "ssp245", y) for y in years]

    rows = (stores("full", range(2015, 2101)) + stores("gap", [y for y in range(2015, 2101) if y != 2050])
            + stores("past", range(1950, 2015)) + stores("both", range(1950, 2101))
            + [("p/ENSEMBLE/x", "ens", "ssp245", 2015)])
    df = spark.createDataFrame(rows, "path string, model string, scenario string, year int")
    assert {r["model"] for r in files.valid_models(df, "ssp245").select("model").distinct().collect()} == {"full", "past"}


def test_catalogues(spark):
    assert len(asset_groups.DISPLAY_GROUPS) == 5
    assert asset_groups.asset_catalogue(spark).count() == 12
    rows = asset_groups.group_catalogue(spark)
    assert rows.filter("asset_group = 'power-grid'").count() == 4
    assert registry.regions(spark).count() == 8
    jobs = registry.exposure_jobs(spark)
    assert jobs.count() == 15 and jobs.filter("return_period IS NULL").count() == 3


def test_table_lookup(spark):
    spark.range(1).createOrReplaceTempView("infrastructure_line")
    got = registry.layer_tables(spark, "infrastructure").collect()
    assert [r["table_name"] for r in got] == ["infrastructure_line"] and got[0]["columns"] == ["id"]


def test_geojson_files(spark):
    root = folder()
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {"V": 345}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}}]}
    with open(f"{root}/a.geojson", "w") as f:
        json.dump(doc, f)
    with open(f"{root}/b.geojson", "w") as f:
        f.write("broken")
    got = files.read_geojson_assets(spark, {f"{root}/a.geojson": "line", f"{root}/b.geojson": "bad"}).collect()
    assert {(r["asset_name"], r["geom_type"], r["xmax"]) for r in got} == {("line", "ST_LineString", 2.0), ("line", "ST_Point", 5.0)}
    assert got[0]["properties"] in ({"V": "345"}, {})


def test_listing(spark):
    root = folder()
    for name in ("pr_day_M_ssp245_r1_gn_2015.nc", "pr_day_M_ssp245_r1_gn_2015_v1.1.nc", "other.txt"):
        with open(f"{root}/{name}", "w") as f:
            f.write("x")
    picked = files.pick_files(files.list_files(spark, root), ["pr"]).collect()
    assert [r["name"] for r in picked] == ["pr_day_M_ssp245_r1_gn_2015_v1.1.nc"]


def test_metadata_error(spark):
    bad = files.require_metadata(files.store_metadata(spark.createDataFrame([("x/y.zarr",)], "path string")))
    with pytest.raises(Exception, match="no metadata"):
        bad.collect()


def test_csv_income(spark):
    root = folder()
    with open(f"{root}/15zp.csv", "w") as f:
        f.write("STATE,zipcode,N1,A00100,X\nWA,98101,10,500,1\nOR,97001,1,2,3\nWA,98102,,7,1\n")
    got = files.read_income(spark, root, "WA").collect()
    assert [(r["year"], r["zipcode"], r["returns"], r["agi"]) for r in got] == [(2015, "98101", 10.0, 500.0)]


def test_quarantine(spark):
    df = spark.createDataFrame([('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}',), ("x",)], "feature string")
    good, bad = files.quarantine(df)
    assert good.count() == 1 and bad.count() == 1


def test_csv_sink(spark, t):
    root = folder()
    df = t.fx_fwi.limit(20).withColumns({"osm_type": F.lit("power"), "zeta": F.lit(1), "alpha": F.lit(None).cast("string"),
                                         "geometry_wkt": F.lit("POINT (1 2)")})
    sinks.write_csv(df, f"{root}/out")
    back = spark.read.option("header", "true").csv(f"{root}/out")
    assert back.columns == ["osm_id", "osm_type", "geometry_wkt", "month", "decade", "ssp", *sinks.CSV_VALUE_ORDER, "alpha", "zeta"]
    assert back.count() == 20


def test_keyed_sink_replaces_only_its_partitions(spark, t):
    root = folder() + "/t"
    keys = ["osm_id", "month", "decade", "ssp"]
    sinks.write_keyed(t.fx_fwi, root, keys)
    total = sinks.read_keyed(spark, root).count()
    sinks.write_keyed(t.fx_fwi.filter("ssp = 245").limit(5), root, keys)
    kept = t.fx_fwi.filter("ssp <> 245").count()
    assert sinks.read_keyed(spark, root).count() == kept + 5 and total == t.fx_fwi.count() == sinks.read_keyed(spark, root, 1).count()
    with pytest.raises(ValueError):
        sinks.write_keyed(t.fx_fwi, root, ["osm_id"])


def test_keyed_sink_leaves_the_table_when_a_key_repeats(spark):
    root = folder() + "/t"
    good = spark.createDataFrame([(1, 245, 0.5)], "osm_id long, ssp int, v double")
    sinks.write_keyed(good, root, ["osm_id", "ssp"])
    with pytest.raises(ValueError):
        sinks.write_keyed(good.union(good), root, ["osm_id", "ssp"])
    assert sinks.read_keyed(spark, root).count() == 1


def test_a_commit_that_dies_leaves_the_table_whole(spark):
    """Tasks that fail while writing, odd partition values, a commit on top of another, old versions."""
    root = folder() + "/t"
    rows = [(1, "a b/ü=1", 1.0), (2, None, 2.0), (3, "c", 3.0)]
    schema = "osm_id long, kind string, v double"
    sinks.write_keyed(spark.createDataFrame(rows, schema), root, ["osm_id"], ["kind"])
    dying = spark.range(0, 1000, 1, 4).select(F.col("id").alias("osm_id"), F.lit("c").alias("kind"),
                                              F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.lit(9.0)).cast("double").alias("v"))
    with pytest.raises(Exception):
        sinks.write_keyed(dying, root, ["osm_id"], ["kind"])
    assert sorted(map(tuple, sinks.read_keyed(spark, root).collect()), key=str) == sorted(rows, key=str)
    assert versions.versions(spark, root) == [1]
    sinks.write_keyed(spark.createDataFrame([(7, None, 7.0)], schema), root, ["osm_id"], ["kind"])
    assert sorted(r["osm_id"] for r in sinks.read_keyed(spark, root).collect()) == [1, 3, 7]
    assert sorted(r["osm_id"] for r in sinks.read_keyed(spark, root, 1).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        sinks.read_keyed(spark, root, 9)
    with pytest.raises(ValueError):
        sinks.read_keyed(spark, folder() + "/none")


def test_grid_sink_replaces_only_its_slices(spark):
    root = folder() + "/g"
    schema = "indicator string, model string, scenario string, member string, lat double, lon double, month_start date, value double"

    def frame(model, year, value):
        return spark.createDataFrame([("fwi", model, "ssp245", "r1", 1.0, 2.0, datetime.date(year, 1, 1), value)], schema)

    for model, year, value in (("A", 2020, 1.0), ("B", 2020, 2.0), ("A", 2021, 3.0), ("A", 2020, 4.0)):
        sinks.write_grid(frame(model, year, value), root)
    got = {(r["model"], r["year"]): r["value"] for r in spark.read.parquet(root).collect()}
    assert got == {("A", 2020): 4.0, ("B", 2020): 2.0, ("A", 2021): 3.0}


def test_every_tag_key_gets_a_column(spark):
    df = spark.createDataFrame([(1, "x", {"id": "i", "type": "t", "power": "plant", "a:b": "c", "a_b": "d"})],
                               "osm_id long, osm_type string, tags map<string,string>")
    row = T.infrastructure_attributes(df, "power", extra_keys=["id", "type", "osm_type", "power", "a:b", "a_b", "id"]).first()
    assert (row["id"], row["type"], row["tag_osm_type"], row["power_type"], row["a_b"], row["tag_a_b"]) == ("i", "t", None, "plant", "c", "d")


def test_wide_and_long_tags_have_no_limit(spark):
    df = spark.range(2500).select(F.col("id").alias("osm_id"), F.lit("s").alias("osm_subtype"),
                                  F.create_map(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("v")).alias("tags"))
    assert len(T.tag_columns(df)) == 2500 and T.long_tags(df).count() == 2500


def test_text_ids_of_flood_zones(spark):
    from terrahaz.functions import geometry as geo

    point = geo.with_point(spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0)], "osm_id long, x double, y double"), F.col("x"), F.col("y"))
    zones = spark.createDataFrame([("53033C_12", None, "A"), ("53033C_2", "2001-01-01", "B"), ("53033C_10", "2001-01-01", "C")],
                                  "fld_ar_id string, lomr_effective_date string, flood_zone string").withColumns(
        {"flood_zone_subtype": F.lit("s"), "is_sfha": F.lit("T"), "flood_depth": F.lit(1.0)})
    zones = geo.with_box(zones, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    got = {r["osm_id"]: r["flood_zone"] for r in hazards.asset_latest_zone(point, zones).collect()}
    assert got == {1: "C", 2: None}


def test_feature_sink(spark, t):
    root = folder() + "/f"
    sinks.write_features(admin_geometry(t.fx_admin).withColumn("osm_id", F.col("admin_id")), root)
    lines = [json.loads(r["value"]) for r in spark.read.text(root).collect()]
    assert lines and all(x["type"] == "Feature" and x["geometry"]["type"] == "Polygon" for x in lines)


def test_refresh_order_and_tables(spark, t):
    order = dag.refresh_order(["flood"])
    assert order.index("extreme_precip") < order.index("flood") and order.index("power_grid") < order.index("flood")
    sources = {"features": features(t), "tags": tags(t), "pfe_mm_day": t.fx_pfe, "pluvial_change_factor": t.fx_pcf,
               "flood_zones": zone_geometry(t.fx_zones), "fwi": t.fx_fwi, "burn_probability": t.fx_burn}
    out = dag.refresh(spark, sources, folder(), ["flood", "unexposed_fwi", "wildfire"])
    assert out["wildfire"].count() == t.fx_fwi.count()
    assert out["flood"].count() == 3 * t.fx_pfe.count()
    assert dag.layer_of("flood") == "hazard" and dag.layer_of("power_grid") == "group"


def grid_feed(t):
    return t.fx_grid.select("model", "scenario", "member", "lat", "lon", "date", "tasmax", "pr", "hurs", "sfcwind")


def stream_of(spark, df, order, parts):
    root = folder() + "/feed"
    rows = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(*order)))
    for p in range(1, parts + 1):
        rows.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", folder()).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_fire_weather_stream_equals_batch(spark, t):
    feed = grid_feed(t).filter("model IN ('M1', 'M2')")
    drain(feeds.fwi_stream(stream_of(spark, feed, ["date", "lat", "lon", "model"], 2)), "fw")
    got = {(r["model"], r["lat"], r["lon"], str(r["date"])): r["fwi"] for r in spark.table("fw").collect()}
    want = {(r["model"], r["lat"], r["lon"], str(r["date"])): r["fwi"] for r in C.fwi(feed, block_deg=100.0).collect()}
    assert got == {k: (v if v is None else pytest.approx(v)) for k, v in want.items()}


def test_fire_weather_stream_goes_on_after_a_restart(spark, t):
    """Two runs over one checkpoint give what one batch gives; late rows are dropped."""
    feed = grid_feed(t).filter("model = 'M1'")
    root, place = folder(), folder()
    cut = feed.agg(F.expr("percentile_approx(date, 0.5)")).first()[0]
    late = feed.filter(F.col("date") <= cut).limit(5)

    def once(df, name):
        df.coalesce(1).write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/feed")
        q = feeds.fwi_stream(stream, block_deg=100.0).writeStream.format("parquet").option("path", f"{place}/out").option(
            "checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    once(feed.filter(F.col("date") <= cut), "a")
    once(feed.filter(F.col("date") > cut).unionByName(late), "b")
    found = spark.read.parquet(f"{place}/out")
    got = {(r["scenario"], r["lat"], r["lon"], str(r["date"])): r["dc"] for r in found.collect()}
    want = {(r["scenario"], r["lat"], r["lon"], str(r["date"])): r["dc"] for r in C.fwi(feed).collect()}
    assert found.count() == len(got) and got == {k: (v if v is None else pytest.approx(v)) for k, v in want.items()}


def test_monthly_stream_equals_batch(spark, t):
    feed = t.fx_grid.groupBy("lat", "lon", "date").agg(F.avg("pr").alias("pr"))
    drain(feeds.monthly_stream(stream_of(spark, feed, ["date", "lat", "lon"], 3), ["lat", "lon"], "pr"), "mm")
    want = {(r["lat"], r["lon"], r["m"]): r["pr"] for r in feed.groupBy(
        "lat", "lon", F.date_trunc("month", F.col("date").cast("timestamp")).alias("m")).agg(F.avg("pr").alias("pr")).collect()}
    got = {(r["lat"], r["lon"], r["month_start"]): r["pr"] for r in spark.table("mm").collect()}
    # months whose watermark has passed are out; each carries the batch value
    assert len(got) > len(want) * 0.8
    assert got == {k: pytest.approx(want[k]) for k in got}


def test_exposure_stream_is_idempotent(spark, t):
    root, table = folder(), folder() + "/exposure"
    assets = t.fx_assets.select("osm_id", "x0", "y0")

    def expose(df):
        return df.select("osm_id", (F.col("x0") + F.col("y0")).alias("v"))

    for n in range(2):
        src = stream_of(spark, assets, ["osm_id"], 2)
        q = feeds.exposure_stream(src, table, expose, ["osm_id"]).option(
            "checkpointLocation", f"{root}/{n}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        assert spark.read.parquet(table).count() == assets.count()


def test_content_hash_of_objects_lists_and_booleans(spark):
    import hashlib

    df = spark.createDataFrame([('{"b": [1, 2], "a": {"d": "x", "c": null}}', '["u", {"z": 1, "y": false}]', True)], "o string, l string, f boolean")
    parts = [V.typed_text(F.col("o"), "d"), V.typed_text(F.col("l"), "l"), V.typed_text(F.col("f"), "n"), V.typed_text(F.col("f"), "x")]
    want = sorted(['d:{"a":{"c":null,"d":"x"},"b":[1,2]}', 'l:["u",{"y":false,"z":1}]', "n:true", "x:null"])
    assert df.select(V.content_hash(parts).alias("h")).first()["h"] == hashlib.sha256(("|".join(want) + "|").encode()).hexdigest()


@pytest.mark.parametrize("split", [64, 300, 5000])
def test_one_document_is_read_in_splits(spark, split):
    """Strings with brackets and escapes, nested features, border in every place, a broken and an empty file."""
    import random

    rng = random.Random(split)
    notes = ['}', '{"a', '\\', '\\"', ']}, {"type": "Feature"', "é}ß{", "", '"features":[{"type":"Feature"}]']
    feats = []
    for i in range(120):
        props = {"note": "".join(rng.choice(notes) for _ in range(rng.randint(0, 4))), "n": i, "deep": {"l": [{"q": [1, {"type": "Feature"}]}] * rng.randint(0, 3)}}
        feats.append({"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 1.5]}, "properties": props})
    feats[60]["properties"]["note"] = "x}" * 400
    root = folder()
    docs = {"a": json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "}"}}, "features": feats}, ensure_ascii=False),
            "b": json.dumps({"features": feats[:7], "bbox": [[1], [2]]}, indent=2) + "\n", "bad": json.dumps({"features": feats})[:-40], "none": '{"features":[]}'}
    for name, text in docs.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", " ").text(f"{root}/{name}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [(r["file"].split("/")[-2], json.loads(r["feature"])) for r in geojson.read_features(spark, [f"{root}/{n}" for n in docs]).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    for name, want in (("a", feats), ("b", feats[:7]), ("bad", []), ("none", [])):
        assert sorted(json.dumps(f, sort_keys=True) for n, f in got if n == name) == sorted(json.dumps(f, sort_keys=True) for f in want)
