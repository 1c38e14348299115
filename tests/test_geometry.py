"""Geometry functions and spatial joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrahaz.functions import geometry as geo
from terrahaz.functions import kernels
from terrahaz.operators import spatial as S

SCHEMA = f"osm_id bigint, geom_type string, parts {geo.PARTS_TYPE}"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def frame(spark, rows):
    return geo.with_envelope(spark.createDataFrame(rows, SCHEMA))


WKT = [
    ({"type": "Point", "coordinates": [-122.25, 47.5]}, "POINT (-122.25 47.5)"),
    ({"type": "LineString", "coordinates": [[0.5, 1.5], [2.5, 1.0], [7.0, -3.25]]}, "LINESTRING (0.5 1.5, 2.5 1.0, 7.0 -3.25)"),
    ({"type": "MultiLineString", "coordinates": [[[1.5, 2.0], [1.5, 8.0]], [[6.0, 6.5], [7.5, 6.5], [7.5, 9.0]]]},
     "MULTILINESTRING ((1.5 2.0, 1.5 8.0), (6.0 6.5, 7.5 6.5, 7.5 9.0))"),
    ({"type": "Polygon", "coordinates": [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 0.0]], [[2.0, 1.0], [3.0, 1.0], [3.0, 2.0], [2.0, 1.0]]]},
     "POLYGON ((0.0 0.0, 9.0 0.0, 9.0 9.0, 0.0 0.0), (2.0 1.0, 3.0 1.0, 3.0 2.0, 2.0 1.0))"),
    ({"type": "MultiPolygon", "coordinates": [[[[5.0, 5.0], [8.0, 5.0], [8.0, 7.0], [5.0, 5.0]]], [[[-4.0, 0.5], [-2.0, 0.5], [-2.0, 3.0], [-4.0, 0.5]]]]},
     "MULTIPOLYGON (((5.0 5.0, 8.0 5.0, 8.0 7.0, 5.0 5.0)), ((-4.0 0.5, -2.0 0.5, -2.0 3.0, -4.0 0.5)))"),
    ({"type": "MultiPoint", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}, "MULTIPOINT (1.0 2.0, 3.0 4.0)"),
    ({"type": "Circle", "coordinates": []}, ""),
]


@pytest.mark.parametrize("geojson,wkt", WKT)
def test_geojson_to_wkt(spark, geojson, wkt):
    import json

    df = spark.createDataFrame([(json.dumps(geojson),)], "g string").select(
        F.concat(F.lit("ST_"), F.get_json_object("g", "$.type")).alias("geom_type"),
        geo.geojson_parts(F.col("g")).alias("parts"))
    assert df.select(geo.to_wkt().alias("w")).first()["w"] == wkt


def test_box_area_is_about_a_degree_square(spark):
    r = spark.range(1).select(geo.approx_box_km2(*[geo.d(v) for v in (0, 0, 1, 1)]).alias("a")).first()
    assert r["a"] == pytest.approx(111**2, rel=0.1)


def test_area_centroid_with_hole(spark):
    shell, hole = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((2, 1), (3, 1), (3, 3), (2, 3), (2, 1))
    df = frame(spark, [(1, "ST_Polygon", [[shell, hole]]), (2, "ST_Polygon", [[shell[::-1], hole]])])
    for r in df.select(geo.area_deg2("parts").alias("a"), geo.centroid().alias("c")).collect():
        assert r["a"] == pytest.approx(14)
        assert r["c"]["x"] == pytest.approx((16 * 2 - 2 * 2.5) / 14)
        assert r["c"]["y"] == pytest.approx(2)


def polygon(rng, n):
    cx, cy = rng.uniform(0, 6), rng.uniform(0, 4)
    pts = []
    for i in range(n):
        a, r = 2 * math.pi * i / n, rng.uniform(0.2, 1.2)
        pts.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return ring(*pts, pts[0])


def segments_of(parts):
    out = []
    for part in parts:
        for rg in part:
            p = [(v["x"], v["y"]) for v in rg]
            out += list(zip(p, p[1:])) or [(p[0], p[0])]
    return out


def cross(s, t):
    def side(u, p):
        return (u[1][0] - u[0][0]) * (p[1] - u[0][1]) - (u[1][1] - u[0][1]) * (p[0] - u[0][0])

    for k in (0, 1):
        if max(s[0][k], s[1][k]) < min(t[0][k], t[1][k]) or max(t[0][k], t[1][k]) < min(s[0][k], s[1][k]):
            return False
    return side(s, t[0]) * side(s, t[1]) <= 0 and side(t, s[0]) * side(t, s[1]) <= 0


def inside(pt, parts):
    hit = False
    for part in parts:
        odd = False
        for a, b in segments_of([part]):
            if (a[1] > pt[1]) != (b[1] > pt[1]) and pt[0] < (b[0] - a[0]) * (pt[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        hit = hit or odd
    return hit


def touches(a, b):
    if any(cross(s, t) for s in segments_of(a[2]) for t in segments_of(b[2])):
        return True
    for x, y in ((a, b), (b, a)):
        if x[1] == "ST_Polygon":
            for part in y[2]:
                v = part[0][0]
                if inside((v["x"], v["y"]), x[2]):
                    return True
    return False


def shapes(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = ("ST_Point", "ST_LineString", "ST_Polygon")[i % 3]
        if kind == "ST_Point":
            parts = [[ring((rng.uniform(0, 6), rng.uniform(0, 4)))]]
        elif kind == "ST_LineString":
            parts = [[ring(*[(rng.uniform(0, 6), rng.uniform(0, 4)) for _ in range(3)])]]
        else:
            parts = [[polygon(rng, 7)]]
        rows.append((i, kind, parts))
    return rows


@pytest.mark.parametrize("lot", [S.LOT, 3])
def test_general_intersections(spark, lot):
    left, right = shapes(1, 45), shapes(2, 45)
    want = {(a[0], b[0]) for a in left for b in right if touches(a, b)}
    pairs = S.tile_candidates(frame(spark, left), frame(spark, right), 1.0, lot=lot).filter(
        geo.intersects(geo.named(), geo.named("r_")))
    got = [(r["osm_id"], r["r_osm_id"]) for r in pairs.select("osm_id", "r_osm_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_hot_tile_is_split(spark):
    pts = spark.range(400).select(F.col("id").alias("osm_id"), ((F.col("id") % 20) / 100).alias("x"),
                                  F.floor(F.col("id") / 20).cast("double").alias("y0"))
    pts = geo.with_point(pts, F.col("x"), F.col("y0") / 100)
    tiles = S.crowded_tiles(S._tiled(pts, S.ENVELOPE, 1.0), S._tiled(pts, S.ENVELOPE, 1.0), 100)
    assert tiles.first()["_kl"] == tiles.first()["_kr"] == 4
    plain = S.tile_candidates(pts, pts, 1.0, split_hot=False).count()
    assert plain == S.tile_candidates(pts, pts, 1.0, lot=50).count() == 400


def test_contact_counts_as_intersection(spark):
    a = frame(spark, [(1, "ST_Polygon", [[ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]])])
    b = frame(spark, [(2, "ST_Polygon", [[ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))]]), (3, "ST_Point", [[ring((1, 0.5))]])])
    assert {r["r_osm_id"] for r in S.intersecting(a, b, 0.5).collect()} == {2, 3}


def haversine(a, b):
    la1, la2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h)) * 0.000621371


@pytest.mark.parametrize("lat", [0.0, 62.0])
def test_nearest_and_radius_match_brute_force(spark, lat):
    rng = random.Random(5)
    left = [(i, rng.uniform(-60, 60), lat + rng.uniform(-15, 15)) for i in range(60)] + [(60, 1.0, lat), (61, 1.0, lat)]
    right = [(i, rng.gauss(20, 8), lat + rng.gauss(0, 4)) for i in range(50)] + [(90, 20.0, lat), (91, 20.0, lat)]
    ldf = spark.createDataFrame(left, "osm_id bigint, lon double, lat double")
    rdf = spark.createDataFrame(right, "sid bigint, lon double, lat double")
    got = {r["osm_id"]: (r["nearest_sid"], r["distance_miles"]) for r in S.nearest(ldf, rdf, "osm_id", "sid").collect()}
    for i, x, y in left:
        d, s = min((haversine((x, y), (rx, ry)), rid) for rid, rx, ry in right)
        assert got[i][0] == s and got[i][1] == pytest.approx(d)
    counts = {r["osm_id"]: (r["count_200mi"], r["count_500mi"]) for r in
              S.counts_within(ldf, rdf, [200, 500], "osm_id").collect()}
    for i, x, y in left:
        ds = [haversine((x, y), (rx, ry)) for _, rx, ry in right]
        assert counts[i] == (sum(d <= 200 for d in ds), sum(d <= 500 for d in ds))


def test_subdivide_conserves_area_and_limits_vertices(spark):
    rng = random.Random(3)
    rows = [(i, "ST_Polygon", [[polygon(rng, 300)]]) for i in range(5)]
    df = frame(spark, rows)
    cut = S.subdivide(df, 64)
    assert cut.agg(F.max(F.size(geo.vertices(F.col("parts")))).alias("m")).first()["m"] <= 64
    whole = {r["osm_id"]: r["a"] for r in df.select("osm_id", geo.area_deg2("parts").alias("a")).collect()}
    for r in cut.groupBy("osm_id").agg(F.sum(geo.area_deg2("parts")).alias("a")).collect():
        assert r["a"] == pytest.approx(whole[r["osm_id"]])


def test_simplify_keeps_ends_and_corners(spark):
    line = ring((0, 0), (1, 0.00001), (2, 0), (2, 1))
    df = frame(spark, [(1, "ST_LineString", [[line]])]).select("osm_id", *S.GEOMETRY_COLUMNS)
    got = [(r["lon"], r["lat"]) for r in S.line_vertices(df, tolerance=0.0001).collect()]
    assert got == [(0, 0), (2, 0), (2, 1)]


def peucker(xy, tolerance):
    """Douglas-Peucker as it is usually written."""
    if len(xy) < 3:
        return list(xy)
    (ax, ay), (bx, by) = xy[0], xy[-1]
    dx, dy = bx - ax, by - ay

    def off(p):
        t = min(max(((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
        return math.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy)

    far = max(range(1, len(xy) - 1), key=lambda i: off(xy[i]))
    if off(xy[far]) <= tolerance:
        return [xy[0], xy[-1]]
    return peucker(xy[:far + 1], tolerance)[:-1] + peucker(xy[far:], tolerance)


def test_simplification_of_many_lists_at_once():
    import numpy as np

    rng = random.Random(8)
    lists = [[(float(i), rng.gauss(0, 1)) for i in range(rng.choice([1, 2, 3, 50, 400]))] for _ in range(60)] + [[], [(1.0, 1.0)] * 5]
    lists.append([(0.0, 0.0), (1.0, 2.0), (2.0, 0.0), (0.0, 0.0)])
    xy = np.array([p for one in lists for p in one], float)
    offsets = np.append(0, np.cumsum([len(one) for one in lists]))
    for tolerance in (0.5, 3.0):
        keep = kernels.kept_vertices(xy, offsets, tolerance)
        got = [[tuple(p) for p in xy[a:b][keep[a:b]].tolist()] for a, b in zip(offsets, offsets[1:])]
        assert got == [one if len(one) < 2 else peucker(one, tolerance) for one in lists]


def test_simplified_rows_keep_their_nesting(spark):
    bent = [ring((0, 0), (1, 0.5), (2, 0)), ring((5, 5), (6, 5.00001), (7, 5))]
    rows = [(1, "ST_MultiLineString", [[r] for r in bent]), (2, "ST_LineString", [[ring((0, 0), (1, 1))]]), (3, "ST_MultiLineString", [])]
    df = frame(spark, rows).select("osm_id", *S.GEOMETRY_COLUMNS)
    got = sorted((r["osm_id"], r["lon"], r["lat"]) for r in S.line_vertices(df, tolerance=0.0001).collect())
    assert got == [(1, 0, 0), (1, 1, 0.5), (1, 2, 0), (1, 5, 5), (1, 7, 5), (2, 0, 0), (2, 1, 1)]


def test_overlap_share_of_general_polygons(spark):
    """Shares against a fine count of points in the equal-area plane."""
    import math

    ell = [ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3), (0, 0))]
    comb = [ring((0, 0), (0, 3), (1, 3), (1, 1), (2, 1), (2, 3), (3, 3), (3, 0), (0, 0))]
    holed = [ring((0, 0), (3, 0), (3, 3), (0, 3), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))]
    tri = [ring((0.5, 0.2), (3.5, 0.7), (1.2, 2.9), (0.5, 0.2))]
    shapes_ = {1: [ell], 2: [comb], 3: [holed], 4: [tri], 5: [tri, [ring((5, 5), (6, 5), (6, 6), (5, 5))]]}

    def inside(p, parts):
        def odd(edges):
            hits = 0
            for (ax, ay), (bx, by) in edges:
                if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                    hits += 1
            return hits % 2
        return any(odd([e for r in part for e in zip(r, r[1:])]) for part in parts)

    flat = {k: [[[(q[0] if isinstance(q, tuple) else q["x"], math.sin(math.radians(q[1] if isinstance(q, tuple) else q["y"]))) for q in r]
                 for r in part] for part in v] for k, v in shapes_.items()}
    top = math.sin(math.radians(6.01))
    grid = [(6.01 * (i + 0.5) / 240, top * (j + 0.5) / 240) for i in range(240) for j in range(240)]
    held = {k: {n for n, p in enumerate(grid) if inside(p, v)} for k, v in flat.items()}
    df = frame(spark, [(k, "ST_MultiPolygon" if len(v) > 1 else "ST_Polygon", v) for k, v in shapes_.items()])
    got = {(r["osm_id"], r["r_osm_id"]): r["overlap_share"] for r in S.overlap_shares(df, df, 1.0).select("osm_id", "r_osm_id", "overlap_share").collect()}
    for a in shapes_:
        for b in shapes_:
            assert got.get((a, b), 0.0) == pytest.approx(len(held[a] & held[b]) / len(held[a]), abs=0.02)
        assert got[a, a] == pytest.approx(1.0, abs=1e-9)


def test_neighbours_across_the_antimeridian(spark):
    left = spark.createDataFrame([(1, 179.99, 10.0), (2, -179.99, -5.0), (3, 0.0, 0.0)], "osm_id long, lon double, lat double")
    right = spark.createDataFrame([(7, -179.99, 10.0), (8, 179.98, -5.0), (9, 170.0, 10.0), (10, 1.0, 0.0)], "station_id long, lon double, lat double")
    near = {r["osm_id"]: (r["nearest_station_id"], r["distance_miles"]) for r in S.nearest(left, right, "osm_id", "station_id").collect()}
    assert {k: v[0] for k, v in near.items()} == {1: 7, 2: 8, 3: 10} and near[1][1] < 2
    counts = {r["osm_id"]: r["count_5mi"] for r in S.counts_within(left, right, [5], "osm_id").collect()}
    assert counts == {1: 1, 2: 1, 3: 0}


def edges_of(pts):
    import numpy as np

    a, b = np.array(pts), np.array(pts[1:] + pts[:1])
    turn = np.sign(((b[:, 0] - a[:, 0]) * (a[:, 1] + b[:, 1])).sum())
    right = b[:, 0] > a[:, 0]
    first, last = np.where(right[:, None], a, b), np.where(right[:, None], b, a)
    out = np.column_stack([first, last, np.where(right, 1, -1) * turn])
    return out[first[:, 0] != last[:, 0]]


def test_shared_areas_of_large_polygons_follow_their_edges():
    """Two circles of 40,000 edges and a comb of 20,000, against closed forms."""
    import time

    import numpy as np

    from terrahaz.functions import overlay

    def circle(cx, n):
        return [(cx + math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]

    n = 5_000
    comb = [(0.0, -1.0)] + [p for k in range(n) for p in ((k / n, 1.0), ((k + 0.5) / n, 1.0), ((k + 0.5) / n, 0.0), ((k + 1) / n, 0.0))] + [(1.0, -1.0)]
    box = [(0.25, -0.5), (0.25, 0.5), (0.75, 0.5), (0.75, -0.5)]
    pairs = [(circle(0, 40_000), circle(1, 40_000)), (comb, box), (box, comb), (box, circle(5, 8))]
    sides = []
    for k in (0, 1):
        parts = [edges_of(p[k]) for p in pairs]
        sides.append((np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])))
    began = time.time()
    shared, whole = overlay.shared_areas(*sides, len(pairs))
    assert time.time() - began < 20
    assert shared == pytest.approx([2 * math.pi / 3 - math.sqrt(3) / 2, 0.375, 0.375, 0], abs=1e-6)
    assert whole == pytest.approx([math.pi, 1.5, 0.5, 0.5], abs=1e-6)


def random_polygon(rng, n, reach=4.0):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(r * math.cos(t), r * math.sin(t)) for t, r in ((t, reach * rng.uniform(0.3, 1)) for t in angles)]


def in_rings(p, rings):
    hits = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
            hits += (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax
    return hits % 2 == 1


def test_pieces_hold_the_same_points_as_the_whole():
    """Combs both ways, stars and shapes with holes: no point gained or lost, no piece over the limit, area kept."""
    import numpy as np

    from terrahaz.functions import cutting

    rng = random.Random(9)
    comb = [(-4, -4)] + [p for k in range(40) for p in ((-4 + k * 0.2, 4.0), (-4 + k * 0.2 + 0.1, 4.0), (-4 + k * 0.2 + 0.1, -3.0), (-4 + (k + 1) * 0.2, -3.0))] + [(4, -4)]
    shapes_ = [[comb], [[(y, x) for x, y in comb]], [random_polygon(rng, 200)], [random_polygon(rng, 60)[::-1]],
               [[(-4, -4), (4, -4), (4, 4), (-4, 4)], [(x * 0.7, y * 0.7) for x, y in random_polygon(rng, 90)]],
               [[(-4, -4), (4, -4), (4, 4), (-4, 4)], [(-3, -3), (-2, -3), (-2, -2), (-3, -2)], [(x * 0.3 + 1, y * 0.3) for x, y in random_polygon(rng, 40)]]]
    for rings in shapes_:
        shape = cutting.turned([np.array(r, float) for r in rings])
        made = cutting.pieces(shape, 16)
        assert len(made) > 1 and max(map(cutting.size, made)) <= 16
        area = sum(cutting.turn_area(r) for r in shape)
        assert sum(cutting.turn_area(r) for one in made for r in one) == pytest.approx(area, rel=1e-9)
        plain = [[[tuple(v) for v in r.tolist()] for r in one] for one in made]
        for _ in range(600):
            p = (rng.uniform(-4.2, 4.2), rng.uniform(-4.2, 4.2))
            assert any(in_rings(p, one) for one in plain) == in_rings(p, [list(r) for r in rings])


def test_many_vertices_in_one_place_end_the_cutting():
    import numpy as np

    from terrahaz.functions import cutting

    near = [(1 + 1e-16 * (k % 3), 1.0) for k in range(100)]
    (shape,) = [cutting.turned([np.array([(0, 0), (1, 0), *near, (0, 1)], float)])]
    assert sum(cutting.turn_area(r) for one in cutting.pieces(shape, 16) for r in one) == pytest.approx(1.0)


def test_joins_through_pieces_find_the_same_pairs(spark):
    """A comb against points and small boxes between and in its teeth."""
    rng = random.Random(4)
    comb = ring((0, 0), *[p for k in range(60) for p in ((k / 10, 5), (k / 10 + 0.05, 5), (k / 10 + 0.05, 0.5), ((k + 1) / 10, 0.5))], (6, 0), (0, 0))
    zones = frame(spark, [(1, "ST_Polygon", [[comb]]), (2, "ST_MultiPolygon", [[polygon(rng, 300)], [polygon(rng, 20)]])])
    things = [(i, "ST_Point", [[ring((rng.uniform(0, 6), rng.uniform(0, 6)))]]) for i in range(300)]
    for i in range(300, 500):
        x, y = rng.uniform(0, 6), rng.uniform(0, 6)
        things.append((i, "ST_Polygon", [[ring((x, y), (x + 0.03, y), (x + 0.03, y + 0.2), (x, y + 0.2), (x, y))]]))
    assets = frame(spark, things)
    cut = S.subdivide(zones, 16)
    assert cut.agg(F.max(F.size(geo.vertices(F.col("parts"))))).first()[0] <= 16
    found = [{(r["osm_id"], r["r_osm_id"]) for r in S.intersecting(assets, z, 1.0).select("osm_id", "r_osm_id").collect()} for z in (zones, cut)]
    assert found[0] == found[1] and 0 < len({a for a, z in found[0] if z == 1}) < 400


def test_nearest_in_a_crowded_spot(spark):
    """20,000 places in one tile of 1/64 degree, left points in it, beside it and far from it, small leaves."""
    import numpy as np

    rng = np.random.default_rng(6)
    spot = np.column_stack([10 + rng.beta(0.3, 3, 20_000) / 64, 50 + rng.beta(0.3, 3, 20_000) / 64])
    other = np.column_stack([rng.uniform(9, 11, 60), rng.uniform(49, 51, 60)])
    right = np.concatenate([spot, other])
    left = np.concatenate([np.column_stack([10 + rng.beta(0.4, 2, 400) / 64, 50 + rng.beta(0.4, 2, 400) / 64]),
                           np.column_stack([rng.uniform(9.9, 10.1, 150), rng.uniform(49.9, 50.1, 150)]),
                           np.column_stack([rng.uniform(-20, 30, 50), rng.uniform(30, 60, 50)])])
    ldf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(left)], "osm_id bigint, lon double, lat double")
    rdf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(right)], "sid bigint, lon double, lat double")
    got = {r["osm_id"]: (r["nearest_sid"], r["distance_miles"]) for r in S.nearest(ldf, rdf, "osm_id", "sid", crowd=64).collect()}
    la, lo = np.radians(right[:, 1]), np.radians(right[:, 0])
    for i, (x, y) in enumerate(left):
        h = np.sin((la - math.radians(y)) / 2) ** 2 + np.cos(la) * math.cos(math.radians(y)) * np.sin((lo - math.radians(x)) / 2) ** 2
        d = 2 * 6371008.8 * np.arcsin(np.sqrt(h)) * 0.000621371
        assert got[i][1] == pytest.approx(d.min(), abs=1e-9) and d[got[i][0]] == pytest.approx(d.min(), abs=1e-9)
    leaves = S._quadtree(ldf, rdf, 1 / 64, 64)[1].groupBy("_lv", "_tx", "_ty").count()
    assert leaves.agg(F.max("count")).first()[0] <= 64


@pytest.mark.parametrize("lat", [0.2, 64.0])
def test_counts_by_tiles_equal_counting_all(spark, lat):
    """Clusters of thousands of places, copies, small tiles and points across the antimeridian, three radii."""
    import numpy as np

    rng = np.random.default_rng(12)
    cluster = np.column_stack([179.9 + rng.normal(0, 0.04, 3000), lat + rng.normal(0, 0.04, 3000)])
    loose = np.column_stack([179.9 + rng.uniform(-1, 1, 400), lat + rng.uniform(-1, 1, 400)])
    right = np.concatenate([cluster, loose, np.repeat(loose[:3], 50, axis=0)])
    right[:, 0] = (right[:, 0] + 180) % 360 - 180
    left = np.column_stack([179.9 + rng.uniform(-0.8, 0.8, 150), lat + rng.uniform(-0.8, 0.8, 150)])
    left[:, 0] = (left[:, 0] + 180) % 360 - 180
    ldf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(left)], "osm_id bigint, lon double, lat double")
    rdf = spark.createDataFrame([(float(x), float(y)) for x, y in right], "lon double, lat double")
    got = {r["osm_id"]: (r["count_2mi"], r["count_10mi"], r["count_25mi"]) for r in S.counts_within(ldf, rdf, [2, 10, 25], "osm_id").collect()}
    la, lo = np.radians(right[:, 1]), np.radians(right[:, 0])
    for i, (x, y) in enumerate(left):
        h = np.sin((la - math.radians(y)) / 2) ** 2 + np.cos(la) * math.cos(math.radians(y)) * np.sin((lo - math.radians(x)) / 2) ** 2
        d = 2 * 6371008.8 * np.arcsin(np.sqrt(h)) * 0.000621371
        assert got[i] == tuple(int((d <= m).sum()) for m in (2, 10, 25))


def _polar(seed, n):
    """Points around both poles, and some whose latitude runs on beyond one."""
    rng = random.Random(seed)
    return [(i, rng.uniform(-180, 180), rng.choice([90 - abs(rng.gauss(0, 0.4)), -90 + abs(rng.gauss(0, 0.4)), 90 + abs(rng.gauss(0, 0.5)), rng.uniform(200, 204)]))
            for i in range(n)]


def test_neighbours_at_and_beyond_the_poles(spark):
    left, right = _polar(1, 120), _polar(2, 300)
    ldf = spark.createDataFrame(left, "osm_id bigint, lon double, lat double")
    rdf = spark.createDataFrame(right, "sid bigint, lon double, lat double")
    apart = {(i, j): haversine((x, y), (u, v)) for i, x, y in left for j, u, v in right}
    got = {r["osm_id"]: (r["nearest_sid"], r["distance_miles"]) for r in S.nearest(ldf, rdf, "osm_id", "sid", crowd=16).collect()}
    for i, _, _ in left:
        assert got[i][1] == pytest.approx(min(apart[i, j] for j, _, _ in right), abs=1e-6)
        assert apart[i, got[i][0]] == pytest.approx(got[i][1], abs=1e-6)
    # Pairs over a pole that the latitudes tell apart by more than the radius never were pairs.
    reach = S._miles_to_lat(25)
    want = {(i, j) for i, _, y in left for j, _, v in right if apart[i, j] <= 25 and abs(y - v) <= reach}
    pairs = [(r["osm_id"], r["sid"]) for r in S.within_radius(ldf, rdf, 25).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 100
    counts = {r["osm_id"]: r["count_25mi"] for r in S.counts_within(ldf, rdf, [5, 25], "osm_id").collect()}
    assert counts == {i: sum((i, j) in want for j, _, _ in right) for i, _, _ in left}


def test_tiles_per_circle_do_not_grow_towards_the_poles(spark):
    reach = S._miles_to_lat(25)
    for lat in (0.0, 60.0, 89.0, 89.99, 120.0, 400.0):
        one = spark.createDataFrame([(1, 5.0, lat)], "osm_id bigint, lon double, lat double")
        tiles = S._circled(one, reach, reach)
        assert tiles.count() == tiles.select("_tx", "_ty").distinct().count() <= 40
