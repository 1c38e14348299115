"""Planar geometry as column expressions over nested vertex arrays.

A geometry is two columns: ``geom_type`` ('ST_Point', 'ST_LineString',
'ST_MultiLineString', 'ST_Polygon', 'ST_MultiPolygon') and ``parts``, an array of
parts, each an array of rings (ring 0 the shell or the line itself, the rest
holes), each an array of (x, y) vertices. Envelopes are stored beside them.

The long expressions are SQL text over column names (``a: str`` arguments are
SQL), which Spark parses in one call; the short ones take and return Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS_TYPE = "array<array<array<struct<x:double,y:double>>>>"
POLYGONS = ("ST_Polygon", "ST_MultiPolygon")
LINES = ("ST_LineString", "ST_MultiLineString")

EARTH_KM = 6371.0072  # authalic radius
HAVERSINE_KM = 6371.0088  # mean radius
MILES_PER_METRE = 0.000621371
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON = 111.320


def d(value: float) -> Column:
    return F.lit(float(value))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_parts(x: Column, y: Column) -> Column:
    return F.array(F.array(F.array(vertex(x, y))))


def line_parts(*vertices: tuple[Column, Column]) -> Column:
    return F.array(F.array(F.array(*[vertex(x, y) for x, y in vertices])))


def box_parts(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed counter-clockwise rectangle."""
    return line_parts((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))


def rings(parts: Column) -> Column:
    return F.flatten(parts)


def vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def with_envelope(df: DataFrame, parts: str = "parts") -> DataFrame:
    v = vertices(F.col(parts))
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return df.withColumns({
        "xmin": F.array_min(xs), "ymin": F.array_min(ys),
        "xmax": F.array_max(xs), "ymax": F.array_max(ys),
    })


def with_box(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """Attach rectangle geometry columns."""
    return df.withColumns({
        "geom_type": F.lit("ST_Polygon"), "parts": box_parts(xmin, ymin, xmax, ymax),
        "xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax,
    })


def with_point(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.withColumns({
        "geom_type": F.lit("ST_Point"), "parts": point_parts(x, y),
        "xmin": x, "ymin": y, "xmax": x, "ymax": y,
    })


def ring_segments(ring: str) -> str:
    """Consecutive vertex pairs; a single vertex gives one degenerate segment."""
    return (
        f"if(size({ring}) > 1, zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), "
        f"(va, vb) -> named_struct('a', va, 'b', vb)), transform({ring}, vp -> named_struct('a', vp, 'b', vp)))"
    )


def segments(parts: str) -> str:
    return f"flatten(transform(flatten({parts}), sr -> {ring_segments('sr')}))"


def _overlaps(axis: str) -> str:
    return (f"least(s.a.{axis}, s.b.{axis}) <= greatest(t.a.{axis}, t.b.{axis}) "
            f"AND least(t.a.{axis}, t.b.{axis}) <= greatest(s.a.{axis}, s.b.{axis})")


def _straddles(u: str, v: str) -> str:
    def side(end: str) -> str:
        return (f"(({u}.b.x - {u}.a.x) * ({v}.{end}.y - {u}.a.y) - ({u}.b.y - {u}.a.y) * ({v}.{end}.x - {u}.a.x))")

    return f"{side('a')} * {side('b')} <= 0D"


# Closed segments share a point: their boxes overlap and each straddles the other.
_CROSS = f"({_overlaps('x')} AND {_overlaps('y')} AND {_straddles('s', 't')} AND {_straddles('t', 's')})"


def in_polygon(x: str, y: str, parts: str) -> str:
    """Even-odd test over shell and holes of each part (interior only)."""
    edges = f"flatten(transform(ip, ir -> {ring_segments('ir')}))"
    hit = (f"(e.a.y > {y}) <> (e.b.y > {y}) AND {x} < (e.b.x - e.a.x) * ({y} - e.a.y) "
           f"/ nullif(e.b.y - e.a.y, 0D) + e.a.x")
    return f"exists({parts}, ip -> size(filter({edges}, e -> coalesce({hit}, false))) % 2 = 1)"


def is_box(g: dict[str, str]) -> str:
    """Axis-aligned rectangle or point: its envelope is the geometry itself."""
    return (
        f"({g['geom_type']} = 'ST_Point' OR ({g['geom_type']} = 'ST_Polygon' AND size({g['parts']}) = 1 "
        f"AND size({g['parts']}[0]) = 1 AND size({g['parts']}[0][0]) = 5 AND forall({g['parts']}[0][0], "
        f"q -> q.x IN ({g['xmin']}, {g['xmax']}) AND q.y IN ({g['ymin']}, {g['ymax']}))))"
    )


def envelopes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (
        (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    )


def named(prefix: str = "") -> dict[str, str]:
    """Geometry columns of a row under a name prefix."""
    return {c: prefix + c for c in ("geom_type", "parts", "xmin", "ymin", "xmax", "ymax")}


def box_sql(xmin: float, ymin: float, xmax: float, ymax: float) -> dict[str, str]:
    """A constant rectangle in the form of :func:`named`."""
    x0, y0, x1, y1 = (f"({float(v)!r}D)" for v in (xmin, ymin, xmax, ymax))
    ring = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (
        (x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))
    return {"geom_type": "'ST_Polygon'", "parts": f"array(array(array({ring})))",
            "xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1}


def _touches_box(shape: dict[str, str], box: dict[str, str]) -> str:
    """Some segment of ``shape`` reaches the rectangle, or a polygon ``shape`` holds a corner of it.

    A segment and a rectangle are apart only along x, y or across the segment, so three comparisons decide.
    """
    corners = [f"(s.b.x - s.a.x) * ({box[y]} - s.a.y) - (s.b.y - s.a.y) * ({box[x]} - s.a.x)" for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    met = (f"least(s.a.x, s.b.x) <= {box['xmax']} AND greatest(s.a.x, s.b.x) >= {box['xmin']} AND least(s.a.y, s.b.y) <= {box['ymax']} "
           f"AND greatest(s.a.y, s.b.y) >= {box['ymin']} AND least({', '.join(corners)}) <= 0D AND greatest({', '.join(corners)}) >= 0D")
    holds = in_polygon(box["xmin"], box["ymin"], shape["parts"])
    return f"(exists({segments(shape['parts'])}, s -> {met}) OR ({shape['geom_type']} LIKE '%Polygon' AND {holds}))"


def intersects(a: dict[str, str], b: dict[str, str], box_a: str | None = None, box_b: str | None = None) -> Column:
    """Closed intersection test of two geometries given as in :func:`named`.

    ``box_a`` and ``box_b`` tell which sides are their own envelopes, where that is already known. Two such
    sides need their envelopes only, one of them a pass over the segments of the other; only
    two general shapes compare segments with segments, and of those the near ones.
    """
    def holds(outer: dict[str, str], inner: dict[str, str]) -> str:
        inside = in_polygon("cp[0][0].x", "cp[0][0].y", outer["parts"])
        return f"({outer['geom_type']} LIKE '%Polygon' AND exists({inner['parts']}, cp -> {inside}))"

    overlap = (f"{a['xmin']} <= {b['xmax']} AND {b['xmin']} <= {a['xmax']} "
               f"AND {a['ymin']} <= {b['ymax']} AND {b['ymin']} <= {a['ymax']}")

    def near(shape: dict[str, str], other: dict[str, str]) -> str:
        """Segments that reach the other envelope; only they can cross."""
        return (f"filter({segments(shape['parts'])}, n -> greatest(n.a.x, n.b.x) >= {other['xmin']} "
                f"AND least(n.a.x, n.b.x) <= {other['xmax']} AND greatest(n.a.y, n.b.y) >= {other['ymin']} "
                f"AND least(n.a.y, n.b.y) <= {other['ymax']})")

    # The second segment list is bound once, outside the loop over the first.
    crossing = (f"exists(array({near(b, a)}), sb -> exists({near(a, b)}, "
                f"s -> exists(sb, t -> {_CROSS})))")
    box_a, box_b = box_a or is_box(a), box_b or is_box(b)
    return F.expr(f"{overlap} AND CASE WHEN {box_a} AND {box_b} THEN true WHEN {box_a} THEN {_touches_box(b, a)} "
                  f"WHEN {box_b} THEN {_touches_box(a, b)} ELSE {crossing} OR {holds(a, b)} OR {holds(b, a)} END")


def _signed_area(ring: str, fx, fy) -> str:
    return (f"(aggregate({ring_segments(ring)}, 0D, (acc, e) -> acc + {fx('e.a')} * {fy('e.b')} "
            f"- {fx('e.b')} * {fy('e.a')}) / 2D)")


def _area(parts: str, fx, fy) -> Column:
    """Shells minus holes after mapping the coordinates."""
    ring = f"if(ri = 0, 1D, -1D) * abs({_signed_area('rg', fx, fy)})"
    return F.expr(
        f"aggregate(flatten(transform({parts}, pt -> transform(pt, (rg, ri) -> {ring}))), 0D, (tot, v) -> tot + v)")


def area_deg2(parts: str) -> Column:
    """Planar area in squared degrees."""
    return _area(parts, lambda p: f"{p}.x", lambda p: f"{p}.y")


def area_km2(parts: str) -> Column:
    """Area in a cylindrical equal-area projection of the authalic sphere."""
    return _area(parts, lambda p: f"(radians({p}.x) * {EARTH_KM}D)", lambda p: f"(sin(radians({p}.y)) * {EARTH_KM}D)")


def box_area_km2(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed form of the area of a lon/lat rectangle."""
    return (
        F.radians(xmax - xmin) * (F.sin(F.radians(ymax)) - F.sin(F.radians(ymin)))
        * d(EARTH_KM) * d(EARTH_KM)
    )


def approx_box_km2(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Rough rectangle area from degrees per kilometre at the mean latitude."""
    return (
        F.abs(ymax - ymin) * d(KM_PER_DEG_LAT)
        * (F.abs(xmax - xmin) * (d(KM_PER_DEG_LON) * F.cos(F.radians((ymin + ymax) / d(2)))))
    )


def overlap_share_box(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of rectangle ``a`` covered by rectangle ``b``, clipped to 0..1."""
    xmin, xmax = F.greatest(a["xmin"], b["xmin"]), F.least(a["xmax"], b["xmax"])
    ymin, ymax = F.greatest(a["ymin"], b["ymin"]), F.least(a["ymax"], b["ymax"])
    inter = F.when((xmax > xmin) & (ymax > ymin), box_area_km2(xmin, ymin, xmax, ymax)).otherwise(d(0))
    whole = box_area_km2(a["xmin"], a["ymin"], a["xmax"], a["ymax"])
    return F.least(F.greatest(F.try_divide(inter, whole), d(0)), d(1))


def _slopes(parts: str) -> str:
    """Non-vertical edges from left to right in (lon, sin lat), signed so that the areas below them add up to the polygon."""
    def y(p: str) -> str:
        return f"sin(radians({p}.y))"

    turn = (f"if(ri = 0, 1D, -1D) * sign(aggregate({ring_segments('rg')}, 0D, "
            f"(acc, e) -> acc + (e.b.x - e.a.x) * ({y('e.a')} + {y('e.b')})))")
    edge = (f"named_struct('x0', least(e.a.x, e.b.x), 'y0', if(e.a.x < e.b.x, {y('e.a')}, {y('e.b')}), "
            f"'x1', greatest(e.a.x, e.b.x), 'y1', if(e.a.x < e.b.x, {y('e.b')}, {y('e.a')}), 's', sign(e.b.x - e.a.x) * k)")
    ring = f"transform(array({turn}), k -> transform(filter({ring_segments('rg')}, e -> e.a.x <> e.b.x), e -> {edge}))[0]"
    return f"flatten(transform({parts}, pt -> flatten(transform(pt, (rg, ri) -> {ring}))))"


def edge_list(parts: str) -> Column:
    """Five numbers per edge that is not vertical, as ``overlay`` takes them, in (lon, sin lat)."""
    return F.expr(f"flatten(transform({_slopes(parts)}, e -> array(e.x0, e.y0, e.x1, e.y1, e.s)))")


def clip_ring(ring: str, axis: str, bound: str, keep_above: bool) -> str:
    """Cut a closed ring at one axis-parallel line; the result is closed again."""
    other = "y" if axis == "x" else "x"
    sign = ">=" if keep_above else "<="
    at = (f"(e.a.{other} + (({bound}) - e.a.{axis}) / (e.b.{axis} - e.a.{axis}) * (e.b.{other} - e.a.{other}))")
    cut = f"named_struct('{axis}', ({bound}), '{other}', {at})"
    cut = cut if axis == "x" else f"named_struct('x', {at}, 'y', ({bound}))"
    edge = (f"CASE WHEN e.a.{axis} {sign} ({bound}) AND e.b.{axis} {sign} ({bound}) THEN array(e.b) "
            f"WHEN e.a.{axis} {sign} ({bound}) THEN array({cut}) "
            f"WHEN e.b.{axis} {sign} ({bound}) THEN array({cut}, e.b) "
            f"ELSE cast(array() AS array<struct<x:double,y:double>>) END")
    return (f"transform(array(flatten(transform({ring_segments(ring)}, e -> {edge}))), "
            f"o -> if(size(o) > 0, concat(slice(o, -1, 1), o), o))[0]")


def clip_sql(parts: str, xmin: str, ymin: str, xmax: str, ymax: str, axes: str = "xy") -> str:
    """Polygon parts cut to a rectangle (or a strip along one axis); vanished parts are dropped."""
    steps = [("x", xmin, True), ("x", xmax, False)] * ("x" in axes)
    steps += [("y", ymin, True), ("y", ymax, False)] * ("y" in axes)
    out = "array(rg)"
    for i, (axis, bound, above) in enumerate(steps):
        # Each stage is bound once by its lambda, so text and work grow linearly.
        out = f"transform({out}, c{i} -> {clip_ring(f'c{i}', axis, bound, above)})"
    part = f"filter(transform(pt, rg -> {out}[0]), (kr, ki) -> ki = 0 OR size(kr) >= 4)"
    return f"filter(transform({parts}, pt -> {part}), kp -> size(kp[0]) >= 4)"


def clip_parts(parts: str, xmin: str, ymin: str, xmax: str, ymax: str, axes: str = "xy") -> Column:
    return F.expr(clip_sql(parts, xmin, ymin, xmax, ymax, axes))


def centroid(geom_type: str = "geom_type", parts: str = "parts") -> Column:
    """Struct (x, y): area centroid, length-weighted line midpoint, or the point."""
    zero = "named_struct('w', 0D, 'mx', 0D, 'my', 0D)"
    finish = (f"m -> if(m.w = 0D, {parts}[0][0][0], named_struct('x', m.mx / m.w, 'y', m.my / m.w))")
    # Ring moments are taken relative to the first vertex to keep digits.
    w = "((e.a.x - g[0].x) * (e.b.y - g[0].y) - (e.b.x - g[0].x) * (e.a.y - g[0].y))"
    ring = (f"aggregate({ring_segments('g')}, {zero}, (acc, e) -> named_struct('w', acc.w + {w} / 2D, "
            f"'mx', acc.mx + (e.a.x + e.b.x - 2D * g[0].x) * {w} / 6D, "
            f"'my', acc.my + (e.a.y + e.b.y - 2D * g[0].y) * {w} / 6D), "
            f"r -> named_struct('w', abs(r.w) * k, 'mx', sign(r.w) * k * (r.mx + g[0].x * r.w), "
            f"'my', sign(r.w) * k * (r.my + g[0].y * r.w)))")
    moments = (f"flatten(transform({parts}, pt -> transform(pt, (g, gi) -> "
               f"transform(array(if(gi = 0, 1D, -1D)), k -> {ring})[0])))")
    total = (f"aggregate({moments}, {zero}, (t, v) -> named_struct('w', t.w + v.w, 'mx', t.mx + v.mx, "
             f"'my', t.my + v.my), {finish})")
    length = "hypot(e.b.x - e.a.x, e.b.y - e.a.y)"
    line = (f"aggregate({segments(parts)}, {zero}, (acc, e) -> named_struct('w', acc.w + {length}, "
            f"'mx', acc.mx + {length} * (e.a.x + e.b.x) / 2D, 'my', acc.my + {length} * (e.a.y + e.b.y) / 2D), {finish})")
    return F.expr(
        f"CASE WHEN {geom_type} = 'ST_Point' THEN {parts}[0][0][0] WHEN {geom_type} LIKE '%LineString' THEN {line} "
        f"WHEN {geom_type} LIKE '%Polygon' THEN {total} END")


def haversine_miles(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / d(2)), d(2))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
        * F.pow(F.sin(F.radians(lon2 - lon1) / d(2)), d(2))
    )
    metres = d(2) * d(HAVERSINE_KM * 1000) * F.asin(F.least(F.sqrt(a), d(1)))
    return metres * d(MILES_PER_METRE)


def _number(value: str, digits: int | None) -> str:
    """Fixed digits without trailing zeros, or the plain double text when None."""
    if digits is None:
        return f"cast({value} AS string)"
    return (f"regexp_replace(regexp_replace(cast(round({value}, {digits}) AS string), '[.]0$', ''), "
            f"'^-0$', '0')")


def _nested(kinds: dict[str, str], geom_type: str) -> str:
    return "CASE " + " ".join(f"WHEN {geom_type} = '{k}' THEN {v}" for k, v in kinds.items())


def to_wkt(geom_type: str = "geom_type", parts: str = "parts", digits: int | None = None) -> Column:
    """Well-known text; holes stay separate rings, an unknown type gives ''."""
    def joined(array: str, head: str = "(", tail: str = ")") -> str:
        return f"concat('{head}', array_join({array}, ', '), '{tail}')"

    vert = f"concat({_number('v.x', digits)}, ' ', {_number('v.y', digits)})"
    ring = joined(f"transform(r, v -> {vert})")
    lines = f"transform({parts}, p -> transform(slice(p, 1, 1), r -> {ring})[0])"
    polys = f"transform({parts}, p -> {joined(f'transform(p, r -> {ring})')})"
    bare = f"transform({parts}, p -> transform(slice(p[0], 1, 1), v -> {vert})[0])"
    return F.expr(_nested({
        "ST_Point": joined(bare, "POINT ("), "ST_MultiPoint": joined(bare, "MULTIPOINT ("),
        "ST_LineString": joined(lines, "LINESTRING ", ""), "ST_MultiLineString": joined(lines, "MULTILINESTRING ("),
        "ST_Polygon": joined(polys, "POLYGON ", ""), "ST_MultiPolygon": joined(polys, "MULTIPOLYGON ("),
    }, geom_type) + " ELSE '' END")


def to_geojson_geometry(geom_type: str = "geom_type", parts: str = "parts") -> Column:
    """GeoJSON geometry text."""
    def listed(array: str) -> str:
        return f"concat('[', array_join({array}, ','), ']')"

    vert = "concat('[', cast(v.x AS string), ',', cast(v.y AS string), ']')"
    ring = listed(f"transform(r, v -> {vert})")
    lines = f"transform({parts}, p -> transform(slice(p, 1, 1), r -> {ring})[0])"
    polys = f"transform({parts}, p -> {listed(f'transform(p, r -> {ring})')})"
    coords = _nested({
        "ST_Point": f"transform({parts}[0][0], v -> {vert})[0]", "ST_LineString": f"{lines}[0]",
        "ST_MultiLineString": listed(lines), "ST_Polygon": f"{polys}[0]", "ST_MultiPolygon": listed(polys),
    }, geom_type) + " END"
    return F.concat(F.lit('{"type":"'), F.substring(geom_type, 4, 32), F.lit('","coordinates":'),
                    F.expr(coords), F.lit("}"))


def geojson_parts(geometry: Column) -> Column:
    """``parts`` of a GeoJSON geometry text (points, lines, polygons and multis)."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")

    def read(schema: str) -> Column:
        return F.from_json(coords, schema)

    def vert(p: Column) -> Column:
        return vertex(p[0], p[1])

    def ring(r: Column) -> Column:
        return F.transform(r, vert)

    one, two = read("array<double>"), read("array<array<double>>")
    three, four = read("array<array<array<double>>>"), read("array<array<array<array<double>>>>")
    return (
        F.when(kind == "Point", F.array(F.array(F.array(vert(one)))))
        .when(kind == "MultiPoint", F.transform(two, lambda p: F.array(F.array(vert(p)))))
        .when(kind == "LineString", F.array(F.array(ring(two))))
        .when(kind == "MultiLineString", F.transform(three, lambda l: F.array(ring(l))))
        .when(kind == "Polygon", F.array(F.transform(three, ring)))
        .when(kind == "MultiPolygon", F.transform(four, lambda p: F.transform(p, ring)))
    )


def geojson_valid(feature: Column) -> Column:
    """Feature text has the type, a known geometry with 2-number positions, and properties."""
    geometry = F.get_json_object(feature, "$.geometry")
    kind = F.get_json_object(feature, "$.geometry.type")
    known = kind.isin("Point", "LineString", "Polygon", "MultiLineString", "MultiPolygon")
    coords = F.get_json_object(geometry, "$.coordinates")

    def pair(p: Column) -> Column:
        return (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull())

    flat = (
        F.when(kind == "Point", F.array(F.from_json(coords, "array<double>")))
        .when(kind == "LineString", F.from_json(coords, "array<array<double>>"))
        .when(kind.isin("Polygon", "MultiLineString"),
              F.flatten(F.from_json(coords, "array<array<array<double>>>")))
        .when(kind == "MultiPolygon",
              F.flatten(F.flatten(F.from_json(coords, "array<array<array<array<double>>>>"))))
    )
    return F.coalesce(
        (F.get_json_object(feature, "$.type") == "Feature") & known
        & F.get_json_object(feature, "$.properties").startswith("{")
        & (F.size(flat) > 0) & F.forall(flat, pair),
        F.lit(False),
    )


def display_geometry(geom_type: str = "geom_type", parts: str = "parts") -> tuple[Column, Column]:
    """Centroid in place of the geometry, keeping points and single lines."""
    keep = F.col(geom_type).isin("ST_Point", "ST_LineString")
    return (
        F.when(keep, F.col(geom_type)).otherwise(F.lit("ST_Point")),
        F.when(keep, F.col(parts)).otherwise(F.array(F.array(F.array(centroid(geom_type, parts))))),
    )
