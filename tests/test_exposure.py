"""Point, polygon and line exposure on the 5 x 5 fixture grid, with literal results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.functions.values import ENSEMBLE_COLUMNS, STATISTICS
from terrahaz.operators import exposure as E
from terrahaz.operators import grid as G
from terrahaz.operators import spatial as S

ROWS = [[10, 20, 30, 40, 50], [100, 200, 300, 400, 500], [1000, 2000, 3000, 4000, 5000],
        [8, 9, 10, 11, 12], [13, 14, 15, 16, 17]]
SPEC = G.GridSpec(0.0, 0.0, 1.0, 1.0, 5, 5)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(float(x), float(y), 2020, 1, float(v)) for y, row in enumerate(ROWS) for x, v in enumerate(row)]
    df = spark.createDataFrame(rows, "lon double, lat double, decade int, month int, v double")
    return df.select("lon", "lat", "decade", "month", *[F.col("v").alias(c) for c in ENSEMBLE_COLUMNS])


@pytest.fixture(scope="module")
def assets(spark):
    def ring(*pts):
        return [[[{"x": float(x), "y": float(y)} for x, y in pts]]]

    rows = [
        (1, "ST_Point", ring((1, 1))), (2, "ST_Point", ring((4, 4))),
        (3, "ST_Polygon", ring((2, 2), (2, 3), (3, 3), (3, 2), (2, 2))),
        (4, "ST_LineString", ring((0, 0), (1, 1), (2, 2), (2, 3))),
    ]
    df = spark.createDataFrame(rows, f"osm_id bigint, geom_type string, parts {geo.PARTS_TYPE}")
    return geo.with_envelope(df)


@pytest.mark.parametrize("method,polygon", [("max", 4000.0), ("mean", 1755.25)])
def test_zonal_by_kind(grid, assets, method, polygon):
    out = {r["osm_id"]: r for r in E.zonal_by_kind(grid, assets, SPEC, ["decade", "month"], method=method).collect()}
    assert {k: r["ensemble_mean"] for k, r in out.items()} == {1: 200.0, 2: 17.0, 3: polygon, 4: 805.0}
    assert out[4]["ensemble_min"] == out[4]["ensemble_q1"] == 10.0
    assert out[4]["ensemble_max"] == out[4]["ensemble_q3"] == 3000.0
    assert (out[1]["decade"], out[1]["month"]) == (2020, 1)


def test_exposure_job(grid, assets):
    spec = E.ExposureSpec("fwi", "historical", SPEC, area_threshold_km2=0.0, attrs={"title": "t"})
    rows = {r["osm_id"]: r for r in E.exposure(grid, assets, spec).collect()}
    assert rows[3]["ensemble_mean"] == 1755.25 and rows[3]["ssp"] == -999
    assert rows[3]["metadata"] == '{"title":"t","zonal_method":"mean"}'
    assert len(rows) == 4


def test_small_polygon_becomes_its_centroid(grid, assets):
    far = S.collapse_small(assets, 1e6).filter("osm_id = 3").first()
    assert far["geom_type"] == "ST_Point" and (far["xmin"], far["ymin"]) == (2.5, 2.5)
    # midpoint ties go to the larger coordinate: cell (3, 3)
    rows = E.zonal_by_kind(grid, S.collapse_small(assets, 1e6), SPEC, ["decade", "month"]).filter("osm_id = 3")
    assert rows.first()["ensemble_mean"] == 11.0


def test_points_outside_take_the_edge(spark, grid):
    pts = spark.createDataFrame([(9, -50.0, 99.0)], "osm_id bigint, lon double, lat double")
    assert G.sample_points(grid, pts, SPEC).first()["ensemble_mean"] == 13.0


def test_line_dedup_of_samples(spark, assets):
    twice = assets.filter("osm_id = 4").withColumn(
        "parts", F.expr("array(array(concat(parts[0][0], parts[0][0])))"))
    narrow = twice.select("osm_id", *S.GEOMETRY_COLUMNS)
    assert S.line_vertices(narrow).count() == 8
    assert S.line_vertices(narrow, dedup=True).count() == 4


def test_model_cube_statistics(spark):
    cube = {"A": [[1, 2], [3, 4]], "B": [[2, 4], [2, 2]], "C": [[5, 5], [5, 5]]}
    rows = [(m, float(y), float(x), float(v)) for m, g in cube.items() for y, r in enumerate(g) for x, v in enumerate(r)]
    df = spark.createDataFrame(rows, "model string, lat double, lon double, v double")
    out = {(r["lat"], r["lon"]): r for r in G.ensemble_stats(df, ["lat", "lon"], "v").collect()}
    means = [[out[(y, x)]["ensemble_mean"] for x in (0.0, 1.0)] for y in (0.0, 1.0)]
    assert means == [[pytest.approx(8 / 3), pytest.approx(11 / 3)], [pytest.approx(10 / 3), pytest.approx(11 / 3)]]
    assert all(r["ensemble_count"] == 3 for r in out.values())
    assert set(f"ensemble_{s}" for s in STATISTICS) <= set(out[(0.0, 0.0)].asDict())


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame([(str(i), 1, float(v)) for i, v in enumerate((1, 2, 5, 9))], "model string, k int, v double")
    r = G.ensemble_stats(df, ["k"], "v").first()
    assert (r["ensemble_q1"], r["ensemble_median"], r["ensemble_q3"]) == (1.75, 3.5, 6.0)


def test_twelve_groups_per_decade(spark):
    df = spark.sql("SELECT 'm' AS model, explode(sequence(date'1950-01-01', date'1959-12-01', interval 1 month)) AS date, 1D AS v")
    assert df.count() == 120
    assert G.climatology(df, ["model"], ["v"]).count() == 12


@pytest.mark.parametrize("res,n", [(0.5, 81), (1.0, 25)])
def test_resample_sizes(grid, res, n):
    out = G.resample(grid, SPEC, res, "ensemble_mean")
    assert out.count() == n
    if res == 0.5:
        mid = out.filter("lat = 0.5 AND lon = 0.5").first()["ensemble_mean"]
        assert mid == (10 + 20 + 100 + 200) / 4


def test_zonal_general_polygon_matches_hand_share(spark, grid):
    tri = spark.createDataFrame(
        [(7, "ST_Polygon", [[[{"x": 0.5, "y": 0.5}, {"x": 2.5, "y": 0.5}, {"x": 0.5, "y": 2.5}, {"x": 0.5, "y": 0.5}]]])],
        f"osm_id bigint, geom_type string, parts {geo.PARTS_TYPE}")
    cells = {(r["ix"], r["iy"]): r["weight"] for r in G.polygon_cells(geo.with_envelope(tri), SPEC).collect()}
    assert cells == {(1, 1): pytest.approx(1.0), (2, 1): pytest.approx(0.5), (1, 2): pytest.approx(0.5)}


def star(rng, cx, cy, n, reach, back):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in ((t, reach * rng.uniform(0.4, 1)) for t in angles)]
    pts = pts[::-1] if back else pts
    return [{"x": x, "y": y} for x, y in [*pts, pts[0]]]


def clipped_shares(df, spec):
    """Shares by cutting the whole polygon to every cell."""
    cells = spec.cells(df).withColumns({"_cx": F.lit(spec.x0) + (F.col("jx") - 0.5) * spec.dx, "_cy": F.lit(spec.y0) + (F.col("jy") - 0.5) * spec.dy})
    share = geo.area_deg2(geo.clip_sql("parts", "_cx", "_cy", f"_cx + {spec.dx!r}D", f"_cy + {spec.dy!r}D")) / (spec.dx * spec.dy)
    return {(r["osm_id"], r["jx"], r["jy"]): r["w"] for r in cells.select("osm_id", "jx", "jy", share.alias("w")).filter("w > 1e-9").collect()}


def test_edge_shares_equal_clipping(spark):
    """Stars, holes, several parts, either turn, over the edges of the grid and outside it."""
    rng, spec, rows = random.Random(1), G.GridSpec(0.0, 0.0, 0.5, 0.25, 20, 30), []
    for i in range(14):
        parts = [[star(rng, rng.uniform(-1, 11), rng.uniform(-1, 8), rng.choice([3, 5, 40]), rng.choice([0.1, 1, 4]), i % 2)]]
        if i % 3 == 0:
            parts = [[star(rng, 4, 4, 30, 3.0, i % 2), star(rng, 4, 4, 9, 0.8, i % 4)], [star(rng, 9.5, 1, 5, 1.0, 0)]]
        rows.append((i, "ST_MultiPolygon", parts))
    rows.append((20, "ST_Polygon", [[[{"x": float(x), "y": float(y)} for x, y in ((2.25, 1.125), (2.25, 3.125), (6.75, 3.125), (4, 2), (6.75, 1.125), (2.25, 1.125))]]]))
    df = geo.with_envelope(spark.createDataFrame(rows, f"osm_id bigint, geom_type string, parts {geo.PARTS_TYPE}"))
    got = {(r["osm_id"], r["ix"], r["iy"]): r["weight"] for r in G.polygon_cells(df, spec).collect()}
    want = clipped_shares(df, spec)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_edge_shares_of_a_polygon_of_many_vertices(spark):
    n, spec = 100_000, G.GridSpec(0.0, 0.0, 1.0, 1.0, 60, 60)
    wave = [(30 + (20 + math.sin(t * 50)) * math.cos(t), 30 + (20 + math.sin(t * 50)) * math.sin(t)) for t in (2 * math.pi * k / n for k in range(n))]
    row = [(1, "ST_Polygon", [[[{"x": x, "y": y} for x, y in [*wave, wave[0]]]]])]
    df = geo.with_envelope(spark.createDataFrame(row, f"osm_id bigint, geom_type string, parts {geo.PARTS_TYPE}"))
    cells = {(r["ix"], r["iy"]): r["weight"] for r in G.polygon_cells(df, spec).collect()}
    area = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(wave, [*wave[1:], wave[0]])) / 2
    assert sum(cells.values()) == pytest.approx(area, rel=1e-9)
    assert cells[30, 30] == pytest.approx(1.0) and max(cells.values()) < 1 + 1e-9 and (55, 55) not in cells
