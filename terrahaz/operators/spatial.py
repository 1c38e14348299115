"""Spatial joins planned as equi-joins on tiles.

Envelopes are exploded over square tiles and joined on the tile, never by a
nested loop. Rows of a crowded tile are dealt into lots on both sides, so a dense city (or a
third of all rows in one spot) costs many small groups instead of one quadratic one. A pair
is emitted only in the tile that holds the lower-left corner of the shared envelope, which
keeps the result duplicate-free without a ``distinct``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahaz.functions import cutting, kernels, overlay
from terrahaz.functions import geometry as geo
from terrahaz.session import written

ENVELOPE = ("xmin", "ymin", "xmax", "ymax")
GEOMETRY_COLUMNS = ("geom_type", "parts", *ENVELOPE)
LOT = 2000
"""Rows of one side of a tile that meet in one group."""

_TILE = ("_tx", "_ty", "_sl", "_sr")


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / (geo.d(size) if isinstance(size, (int, float)) else size)).cast("long")


def _tiled(df: DataFrame, env: Sequence[str], tile: float) -> DataFrame:
    """One row per covered tile; x and y explode apart so no row holds the full product."""
    def span(low: str, high: str) -> str:
        return (f"explode(sequence(cast(floor({low} / {float(tile)!r}D) AS bigint), "
                f"cast(floor({high} / {float(tile)!r}D) AS bigint)))")

    x0, y0, x1, y1 = env
    return df.selectExpr("*", f"{span(x0, x1)} AS _tx").selectExpr("*", f"{span(y0, y1)} AS _ty")


def crowded_tiles(left: DataFrame, right: DataFrame, lot: int = LOT) -> DataFrame:
    """Tiles of both sides with more than ``lot`` rows on one, with the number of lots of each side.

    Both sides are counted in one aggregate with map-side combine; the result only holds
    crowded tiles, so attaching it is a broadcast unless there are very many of them.
    """
    both = left.select("_tx", "_ty", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select("_tx", "_ty", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = both.groupBy("_tx", "_ty").agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    return counts.filter((F.greatest("_nl", "_nr") > lot) & (F.least("_nl", "_nr") > 0)).select(
        "_tx", "_ty", *[F.ceil(F.col(n) / geo.d(lot)).cast("int").alias(k) for n, k in (("_nl", "_kl"), ("_nr", "_kr"))])


def _dealt(df: DataFrame, crowded: DataFrame, own: str, other: str, columns: Sequence[str]) -> DataFrame:
    """Each row in one lot of its own side and in all lots of the other side."""
    lots = df.join(crowded, ["_tx", "_ty"], "left")
    mine = F.pmod(F.xxhash64(*columns), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
    return lots.withColumn(f"_s{own[-1]}", mine).withColumn(
        f"_s{other[-1]}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_kl", "_kr")


def _meet(lt: DataFrame, rt: DataFrame, left: Sequence[str], right: Sequence[str], split_hot: bool = True, lot: int = LOT) -> DataFrame:
    """Rows of both sides that share a tile; those of a crowded tile meet in lots, dealt by the columns named."""
    keys = ["_tx", "_ty"]
    if split_hot:
        crowded = crowded_tiles(lt, rt, lot)
        lt, rt = _dealt(lt, crowded, "_kl", "_kr", left), _dealt(rt, crowded, "_kr", "_kl", right)
        keys += ["_sl", "_sr"]
    # Testing pairs costs far more than moving rows: both sides are dealt by tile and lot to as many tasks
    # as the session shuffles with, whatever the files or a broadcast of one side would give.
    tasks = int(lt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lt.repartition(tasks, *keys).join(rt.repartition(tasks, *keys), keys)


def _scalars(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """``right`` with an ``r_`` before the names that ``left`` has too."""
    return right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c in left.columns})


def tile_candidates(
    left: DataFrame, right: DataFrame, tile_deg: float, split_hot: bool = True, lot: int = LOT,
) -> DataFrame:
    """Pairs whose envelopes overlap (closed). Clashing right columns get an ``r_`` prefix.

    Rows of a crowded tile are dealt into lots on both sides: each pair of lots is a group of
    its own, with at most about ``lot`` rows a side however many rows lie in one spot.
    """
    right = _apart(left, right)
    renv = [f"r_{c}" for c in ENVELOPE]
    met = _meet(_tiled(left, ENVELOPE, tile_deg), _tiled(right, renv, tile_deg), _scalars(left), _scalars(right), split_hot, lot)
    corner = {"x": "greatest(xmin, r_xmin)", "y": "greatest(ymin, r_ymin)"}
    owner = " AND ".join(
        f"cast(floor({corner[c]} / {float(tile_deg)!r}D) AS bigint) = _t{c}" for c in "xy")
    overlap = "xmin <= r_xmax AND r_xmin <= xmax AND ymin <= r_ymax AND r_ymin <= ymax"
    return met.filter(f"{overlap} AND {owner}").drop(*_TILE)


def intersecting(left: DataFrame, right: DataFrame, tile_deg: float, split_hot: bool = True) -> DataFrame:
    """Pairs of geometries that share at least a boundary point."""
    # Whether a row is its own envelope is decided once per row, not once per pair.
    box = F.expr(geo.is_box(geo.named()))
    pairs = tile_candidates(left.withColumn("_box", box), right.withColumn("_box", box), tile_deg, split_hot)
    exact = geo.intersects(geo.named(), geo.named("r_"), "_box", "r__box")
    return pairs.filter(exact).drop("_box", "r__box")


def spatial_join(
    left: DataFrame, right: DataFrame, tile_deg: float, how: str = "inner", key: str = "osm_id",
) -> DataFrame:
    """Intersection join; ``left`` keeps unmatched rows, ``left_semi`` keeps matched ones once."""
    geometry = left.select(key, *GEOMETRY_COLUMNS)
    hits = intersecting(geometry, right, tile_deg)
    extra = [c for c in hits.columns if c not in geometry.columns
             and c not in [f"r_{g}" for g in GEOMETRY_COLUMNS]]
    return left.join(hits.select(key, *extra) if how != "left_semi" else hits.select(key), key, how)


def in_boxes(df: DataFrame, boxes: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """Rows that touch any user box; the boxes are request parameters, so a plain OR suffices."""
    test = F.lit(False)
    for box in boxes:
        test = test | geo.intersects(geo.named(), geo.box_sql(*box))
    return df.filter(test)


def _miles_to_lat(miles: float) -> float:
    return miles / geo.MILES_PER_METRE / 1000.0 / 111.0


def _least_cos(low: Column, high: Column) -> Column:
    """Least size of the cosine between two latitudes less than 180 degrees apart: zero over a pole."""
    pole = F.floor((low + geo.d(90)) / geo.d(180)) != F.floor((high + geo.d(90)) / geo.d(180))
    return F.when(pole, geo.d(0)).otherwise(F.least(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high)))))


def _in_band(band: Column, side: float) -> Column:
    """Tiles of a band of latitude: each about ``side`` degrees of a great circle wide, so towards the poles there are fewer."""
    low = band.cast("double") * geo.d(side)
    return F.greatest(F.floor(_least_cos(low, low + geo.d(side)) * geo.d(360 / side)), F.lit(1).cast("long"))


def _banded(df: DataFrame, lon: str, lat: str, side: float) -> DataFrame:
    """Each point in its tile (_tx, _ty) of its band."""
    tiles = _in_band(F.col("_ty"), side)
    return df.withColumn("_ty", _cell(F.col(lat), side)).withColumn(
        "_tx", F.least(F.floor(F.pmod(F.col(lon), geo.d(360)) / geo.d(360) * tiles), tiles - 1))


def _circled(df: DataFrame, reach: float, side: float, slack: float = 0.0) -> DataFrame:
    """Each point (lon, lat) in all tiles that may hold a point within ``reach`` degrees, or the lower left corner of a box of ``slack``
    degrees that holds one. The turn of longitude is the greatest at which the great circle is not longer, so tiles per
    point are as many at the poles as elsewhere."""
    lat, lon = F.col("lat"), F.col("lon")
    least = _least_cos(lat - geo.d(reach + slack), lat + geo.d(reach + slack))
    far = F.sin(F.radians(geo.d(min(reach, 180.0))) / 2)
    turn = F.when(least <= far, geo.d(180)).otherwise(F.degrees(F.asin(far / least)) * 2) + geo.d(1e-9)
    bands = F.sequence(_cell(lat - geo.d(reach + slack), side), _cell(lat + geo.d(reach), side))
    out = df.withColumn("_turn", turn).withColumn("_ty", F.explode(bands)).withColumn("_n", _in_band(F.col("_ty"), side))
    first = F.floor((lon - F.col("_turn") - geo.d(slack)) / geo.d(360) * F.col("_n"))
    last = F.floor((lon + F.col("_turn")) / geo.d(360) * F.col("_n"))
    return out.withColumns({"_a": first, "_z": F.least(last, first + F.col("_n") - 1)}).withColumn(
        "_tx", F.explode(F.sequence("_a", "_z"))).withColumn("_tx", F.pmod("_tx", "_n")).drop("_turn", "_n", "_a", "_z")


def within_radius(left: DataFrame, right: DataFrame, miles: float, tile_deg: float | None = None) -> DataFrame:
    """Point pairs at most ``miles`` apart, with ``distance_miles``.

    Both sides need ``lon`` and ``lat``; clashing right columns get ``r_``. Right points stand in one tile of
    their band of latitude, left points in those their circle meets, on either side of the antimeridian and of the poles.
    """
    right = _apart(left, right)
    reach = _miles_to_lat(miles)
    side = tile_deg or max(reach, 0.05)
    pairs = _meet(_circled(left, reach, side), _banded(right, "r_lon", "r_lat", side), _scalars(left), _scalars(right)).drop(*_TILE)
    return pairs.filter(F.abs(F.col("lat") - F.col("r_lat")) <= reach).withColumn("distance_miles", geo.haversine_miles(
        F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))).filter(F.col("distance_miles") <= miles)


def counts_within(left: DataFrame, right: DataFrame, miles: Sequence[float], id_col: str) -> DataFrame:
    """Number of right points inside each radius per left row, 0 when none.

    Right points are counted per place and per small tile (an eighth of the widest radius) beforehand. A tile
    that lies wholly inside a circle adds its count, one wholly outside nothing, by the near and far
    edge of the places it holds; only tiles on the rim meet their places. So work follows the tiles of a
    circle and the places on its rim, not all places within it. A tile of one place is never opened.
    """
    names = {m: f"count_{m:g}mi" for m in miles}
    base = left.select(id_col, "lon", "lat")
    reach = _miles_to_lat(max(miles))
    side = max(reach, 0.05) / 8
    places = right.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_fx": _cell(F.col("lon"), side), "_fy": _cell(F.col("lat"), side)})
    sizes = places.groupBy("_fx", "_fy").agg(
        F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_places"), F.min("lon").alias("r_xmin"), F.min("lat").alias("r_ymin"),
        F.max("lon").alias("r_xmax"), F.max("lat").alias("r_ymax"))

    def bounds(pairs: DataFrame) -> DataFrame:
        """Least and greatest distance of a point to the places of a tile; the exact one where there is one place."""
        x, y = F.col("lon"), F.col("lat")
        near = {"x": F.greatest(F.col("r_xmin") - x, x - F.col("r_xmax"), geo.d(0)), "y": F.greatest(F.col("r_ymin") - y, y - F.col("r_ymax"), geo.d(0))}
        edge = {"x": F.least(F.greatest(F.abs(F.col("r_xmin") - x), F.abs(F.col("r_xmax") - x)), geo.d(180)),
                "y": F.greatest(F.abs(F.col("r_ymin") - y), F.abs(F.col("r_ymax") - y))}
        most = F.greatest(F.abs("r_ymin"), F.abs("r_ymax"))
        least = F.when(F.col("r_ymin") * F.col("r_ymax") <= 0, geo.d(0)).otherwise(F.least(F.abs("r_ymin"), F.abs("r_ymax")))
        exact = geo.haversine_miles(x, y, F.col("r_xmin"), F.col("r_ymin"))
        one, beyond = F.col("_places") == 1, F.greatest(most, F.abs(y)) > 90  # no bound holds beyond a pole
        return pairs.withColumns({
            "_low": F.when(one, exact).when(beyond, geo.d(0)).otherwise(_span_miles(near, {"a": y, "b": most}) * (1 - 1e-12)),
            "_high": F.when(one, exact).when(beyond, geo.d(float("inf"))).otherwise(_span_miles(edge, {"a": y, "b": least}) * (1 + 1e-12))})

    met = _meet(_circled(base, reach, max(reach, 0.05), side), _banded(sizes, "r_xmin", "r_ymin", max(reach, 0.05)),
                _scalars(base), _scalars(sizes)).drop(*_TILE)
    met = met.filter((F.col("r_ymin") <= F.col("lat") + reach) & (F.col("r_ymax") >= F.col("lat") - reach))
    turn = F.round((F.col("lon") - F.col("r_xmin")) / geo.d(360)) * geo.d(360)  # the side of the antimeridian on which the tile is near
    pairs = bounds(met.withColumn("_t", turn).withColumns({c: F.col(c) + F.col("_t") for c in ("r_xmin", "r_xmax")}))
    rim = reduce(lambda a, b: a | b, [(F.col("_low") <= m) & (F.col("_high") > m) for m in miles])
    # Tiles that need no places are added up where they are; only those on the rim travel to theirs.
    whole = pairs.filter(~rim & (F.col("_high") <= max(miles))).select(id_col, F.col("_high").alias("_d"), F.col("_total").alias("_n"))
    opened = pairs.filter(rim).select(id_col, "lon", "lat", "_fx", "_fy").join(
        places.select("_fx", "_fy", F.col("lon").alias("_x"), F.col("lat").alias("_y"), "_n"), ["_fx", "_fy"])
    distance = geo.haversine_miles(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    found = whole.unionByName(opened.select(id_col, distance.alias("_d"), "_n"))
    counts = found.groupBy(id_col).agg(*[
        F.sum(F.when(F.col("_d") <= m, F.col("_n")).otherwise(F.lit(0).cast("long"))).alias(n) for m, n in names.items()])
    return left.select(id_col).join(counts, id_col, "left").na.fill(0, list(names.values()))


# Nested tile sides in degrees; crowded tiles of the finest one go on below it.
NEAREST_LEVELS = (1 / 64, 1 / 16, 0.25, 1.0, 4.0, 16.0, 64.0, 512.0)
CROWD = 256
"""Distinct places of a tile beyond which it is split into sixteen."""
_FINEST = 1e-9


def _quadtree(left: DataFrame, right: DataFrame, side: float, crowd: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """Both sides with the leaf (_lv, _tx, _ty) of each place, and the tile sides below ``side`` in use, finest first.

    A leaf holds at most ``crowd`` places of the right side. Each round counts the tiles of what is still crowded, with
    map-side combine, and places of crowded tiles go on, written down, to the next; without any that is one round.
    """
    done: list[list[DataFrame]] = [[], []]
    finer: list[float] = []
    rest = [left, right]
    while True:
        keyed = [df.withColumns({"_lv": F.lit(side), "_tx": _cell(F.col("lon"), side), "_ty": _cell(F.col("lat"), side)}) for df in rest]
        crowded = keyed[1].groupBy("_tx", "_ty").count().filter(F.col("count") > crowd).select("_tx", "_ty")
        last = side < _FINEST or crowded.isEmpty()
        for out, df in zip(done, keyed):
            out.append(df if last else df.join(crowded, ["_tx", "_ty"], "left_anti"))
        if last:
            found = [reduce(DataFrame.unionByName, out) for out in done]
            return *([written(df) for df in found] if finer else found), finer
        rest = [written(df.join(crowded, ["_tx", "_ty"], "left_semi").drop("_lv", "_tx", "_ty")) for df in keyed]
        side /= 4
        finer.insert(0, side)


def _span_miles(apart: dict[str, Column], lat: dict[str, Column]) -> Column:
    """Great circle over differences ``apart`` (x, y in degrees) between latitudes ``lat`` (a, b)."""
    h = F.pow(F.sin(F.radians(apart["y"]) / 2), geo.d(2)) + F.cos(F.radians(lat["a"])) * F.cos(F.radians(lat["b"])) * F.pow(
        F.sin(F.radians(apart["x"]) / 2), geo.d(2))
    return geo.d(2 * geo.HAVERSINE_KM * 1000 * geo.MILES_PER_METRE) * F.asin(F.sqrt(F.least(h, geo.d(1))))


def _on_globe(df: DataFrame) -> DataFrame:
    """Points with latitudes within 90 degrees; one beyond a pole is the same point seen from the other side."""
    around = F.pmod(F.col("lat") + geo.d(90), geo.d(360))
    beyond, over = F.abs("lat") > 90, around > 180
    lat = F.when(over, geo.d(270) - around).otherwise(around - geo.d(90))
    return df.withColumns({"lat": F.when(beyond, lat).otherwise(F.col("lat")),
                           "lon": F.when(beyond & over, F.col("lon") + geo.d(180)).otherwise(F.col("lon"))})


_CUBE, _AXES = ("_kx", "_ky", "_kz"), "xyz"


def _balls(places: DataFrame, prefix: str) -> DataFrame:
    """Leaves with a ball (centre on the unit sphere, radius) around their places."""
    leaf = [f"_{c}" for c in ("lv", "tx", "ty")]
    ends = places.groupBy(*leaf).agg(*[f(c).alias(f"_{n}{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    lon, lat = [F.radians((F.col(f"_min{c}") + F.col(f"_max{c}")) / 2) for c in ("lon", "lat")]
    wide, high = [F.radians((F.col(f"_max{c}") - F.col(f"_min{c}")) / 2) for c in ("lon", "lat")]
    return ends.select(
        *[F.col(c).alias(f"_{prefix}{c[1:]}") for c in leaf], (F.cos(lat) * F.cos(lon)).alias(f"_{prefix}x"), (F.cos(lat) * F.sin(lon)).alias(f"_{prefix}y"),
        F.sin(lat).alias(f"_{prefix}z"), F.sqrt(wide * wide + high * high).alias(f"_{prefix}q"))


def _cubes(prefix: str, level: Column) -> list[Column]:
    """The cube of a ball's centre, of the side of a level."""
    return [_cell(F.col(f"_{prefix}{a}"), F.radians(level)).alias(k) for a, k in zip(_AXES, _CUBE)]


def _spread(df: DataFrame, spans: Sequence[tuple[Column, Column]], level: Column) -> DataFrame:
    """One row per cube of the spans that the unit sphere may pass through."""
    for k, (first, last) in zip(_CUBE, spans):
        df = df.withColumn(k, F.explode(F.sequence(first, last)))
    side = F.radians(level)
    centre = F.sqrt(sum(((F.col(k) + geo.d(0.5)) * side * ((F.col(k) + geo.d(0.5)) * side) for k in _CUBE), geo.d(0)))
    return df.filter(F.abs(centre - geo.d(1)) <= side * geo.d(0.8661))


def nearest(left: DataFrame, right: DataFrame, id_col: str, right_id: str,
            levels: Sequence[float] = NEAREST_LEVELS, crowd: int = CROWD) -> DataFrame:
    """Nearest right point (lowest id on ties) and its distance for every left row.

    Identical places are collapsed on both sides, and places lie in tiles that are split while they
    are crowded, so no tile is quadratic, however many places one spot holds. Tiles are balls on the unit
    sphere and meet in nested cubes of space, which know neither poles nor an antimeridian: the finest level at which
    the cubes around that of a left ball hold a right one gives a bound of the distance; the cubes within that bound
    give the right balls that may be as near; and places meet in what is left. Distances are great circles.
    """
    left, right = _on_globe(left.select(id_col, "lon", "lat")), _on_globe(right)
    places_l, places_r, finer = _quadtree(
        left.select("lon", "lat").distinct(), right.groupBy("lon", "lat").agg(F.min(right_id).alias(right_id)), levels[0], crowd)
    every = F.array(*[F.lit(v) for v in (*finer, *levels)])
    k, cube = F.col("_k"), ["_k", *_CUBE]
    own, leaf, ball = ["_blv", "_btx", "_bty"], ["_rlv", "_rtx", "_rty"], [f"_b{c}" for c in "xyzq"]
    tiles_l, tiles_r = _balls(places_l, "b"), _balls(places_r, "r")

    def at_levels(tiles: DataFrame, prefix: str) -> DataFrame:
        return tiles.withColumn("_k", F.explode(F.filter(every, lambda v: v >= F.col(f"_{prefix}lv")))).select("*", *_cubes(prefix, k))

    def around(df: DataFrame) -> DataFrame:
        return _spread(df, [(F.col(c) - 1, F.col(c) + 1) for c in _CUBE], k)

    # Sizes are measured before rows are exploded: the sides that grow by it are sorted, not broadcast.
    keys = at_levels(tiles_r, "r")
    found = at_levels(tiles_l, "b").join(around(keys.select(*cube).distinct()).hint("merge"), cube, "left_semi").groupBy(*own, *ball).agg(F.min("_k").alias("_k"))
    apart = F.sqrt(sum(((F.col(f"_b{a}") - F.col(f"_r{a}")) * (F.col(f"_b{a}") - F.col(f"_r{a}")) for a in _AXES), geo.d(0)))
    met = around(found.select(*own, *ball, "_k", *_cubes("b", k))).join(keys.select(*cube, *[f"_r{c}" for c in "xyzq"]).hint("merge"), cube)
    bound = met.groupBy(*own, *ball).agg(F.min(apart + F.col("_bq") + F.col("_rq")).alias("_most"))
    # A leaf that may hold a nearer place has its centre within the bound and both radii, of which its own is
    # below the side of its level. Leaves coarser than the first level wide enough stand at their own.
    first = F.array_min(F.filter(every, lambda v: (F.radians(v) >= F.col("_most") + F.col("_bq")) | (v == geo.d(max(levels)))))
    wide = bound.withColumn("_first", first).withColumn("_k", F.explode(
        F.filter(every, lambda v: (v == F.col("_first")) | ((v > F.col("_first")) & (v <= geo.d(levels[0])))))).withColumn(
        "_far", F.col("_most") + F.col("_bq") + F.radians(k) * geo.d(0.7072))
    side = F.radians(k)
    wide = _spread(wide, [(_cell(F.col(f"_b{a}") - F.col("_far"), side), _cell(F.col(f"_b{a}") + F.col("_far"), side)) for a in _AXES], k)
    gaps = [F.greatest(F.col(c) * side - F.col(f"_b{a}"), F.col(f"_b{a}") - (F.col(c) + 1) * side, geo.d(0)) for a, c in zip(_AXES, _CUBE)]
    wide = wide.filter(sum((g * g for g in gaps), geo.d(0)) <= F.col("_far") * F.col("_far") * 1.000001)
    kept = wide.join(keys.hint("merge"), cube).filter(
        ((k == F.col("_first")) | (k == F.col("_rlv"))) & (apart - F.col("_bq") - F.col("_rq") <= F.col("_most") * 1.000001 + 1e-13)).select(*own, *leaf)
    pairs = (
        places_l.select(F.col("lon").alias("_llon"), F.col("lat").alias("_llat"), *[F.col(f"_{c}").alias(f"_b{c}") for c in ("lv", "tx", "ty")])
        .join(kept, own).join(places_r.select(right_id, "lon", "lat", *[F.col(f"_{c}").alias(f"_r{c}") for c in ("lv", "tx", "ty")]), leaf))
    best = (
        pairs.withColumn("_d", geo.haversine_miles(F.col("_llon"), F.col("_llat"), F.col("lon"), F.col("lat")))
        .groupBy(F.col("_llon").alias("lon"), F.col("_llat").alias("lat"))
        .agg(F.min(F.struct("_d", right_id)).alias("_b"))
        .select("lon", "lat", F.col("_b")[right_id].alias(f"nearest_{right_id}"),
                F.col("_b")["_d"].alias("distance_miles"))
    )
    return left.join(best, ["lon", "lat"], "left").drop("lon", "lat")


LEAST_SHARE = 1e-9
"""Share below which two polygons only touch (rounding)."""


def overlap_shares(left: DataFrame, right: DataFrame, tile_deg: float) -> DataFrame:
    """Pairs of polygons with the share of the left one that the right one covers, as ``overlap_share``.

    Exact in the equal-area plane, also for concave shapes, holes and several parts. Each
    row makes its list of edges once, before it meets any other; two rectangles take the closed
    form in the JVM, all other pairs go through ``overlay.shared_areas`` in Arrow batches.
    """
    box = F.expr(geo.is_box(geo.named()))
    edges = F.when(F.col("_box"), overlay.box_edges(*ENVELOPE)).otherwise(geo.edge_list("parts"))
    sides = [df.withColumn("_box", box).withColumn("_edges", edges) for df in (left, right)]
    pairs = tile_candidates(*sides, tile_deg)
    boxes = F.col("_box") & F.col("r__box")
    closed = geo.overlap_share_box({c: F.col(c) for c in ENVELOPE}, {c: F.col(f"r_{c}") for c in ENVELOPE})
    # Empty lists, not nulls: Arrow's list writer walks back over every null of a batch.
    none = F.expr("cast(array() AS array<double>)")
    general = overlay.share_udf()(*[F.when(boxes, none).otherwise(F.col(c)) for c in ("_edges", "r__edges")])
    return pairs.withColumn("overlap_share", F.when(boxes, closed).otherwise(general)).filter(
        F.col("overlap_share") > LEAST_SHARE).drop("_box", "r__box", "_edges", "r__edges")


def subdivide(df: DataFrame, max_vertices: int = 64) -> DataFrame:
    """Polygons of more than ``max_vertices`` vertices as several rows, one per piece; other rows pass through.

    Cuts go through the middle of a piece's longer side until every piece is within the limit
    (at least 8). Pieces of a concave shape come apart at a cut, holes stay holes or open into
    the outline, so pieces cover the same points as the whole: they serve joins as well
    as areas. A pair found in several pieces is one pair: rank or aggregate by its ids. Parts of
    a cut row become pieces of their own, without rings that have no area. Only polygons over the
    limit leave the JVM.
    """
    limit = max(max_vertices, 8)
    big = F.col("geom_type").isin(*geo.POLYGONS) & (F.size(geo.vertices(F.col("parts"))) > limit)
    marked = df.withColumn("_big", F.coalesce(big, F.lit(False)))
    cut = cutting.pieces_udf(limit)(F.when(F.col("_big"), F.col("parts")).otherwise(F.expr(f"cast(array() AS {geo.PARTS_TYPE})")))
    found = marked.withColumn("_cut", cut).withColumn("_p", F.explode(
        F.when(F.size("_cut") > 0, F.col("_cut")).otherwise(F.array("parts"))))
    pieces = geo.with_envelope(found.withColumn("parts", F.col("_p")).withColumn(
        "geom_type", F.when(F.size("_cut") > 0, "ST_Polygon").otherwise(F.col("geom_type"))))
    return pieces.select(*df.columns)


def collapse_small(df: DataFrame, km2: float = 20.0) -> DataFrame:
    """Polygons below the area threshold become their centroid.

    The generator binds the centroid once per row; as a plain projection it would
    be copied into every filter that later reads the envelope.
    """
    rest = [f"`{c}`" for c in df.columns if c not in GEOMETRY_COLUMNS]
    point = ("named_struct('geom_type', 'ST_Point', 'parts', array(array(array(c))), "
             "'xmin', c.x, 'ymin', c.y, 'xmax', c.x, 'ymax', c.y)")
    same = "named_struct(" + ", ".join(f"'{c}', {c}" for c in GEOMETRY_COLUMNS) + ")"
    found = df.withColumn("_c", F.when(
        F.col("geom_type").isin(*geo.POLYGONS) & (geo.area_km2("parts") < km2), geo.centroid()))
    return found.selectExpr(
        *rest, f"inline(transform(array(_c), c -> if(c IS NULL, {same}, {point})))").select(*df.columns)


def line_vertices(df: DataFrame, tolerance: float = 0.0, dedup: bool = False) -> DataFrame:
    """One row (lon, lat) per line vertex after optional simplification (0: none), which only longer lines need."""
    source = df.filter(F.col("geom_type").isin(*geo.LINES))
    parts = F.col("parts")
    if tolerance > 0:
        long = F.coalesce(F.exists(geo.rings(parts), lambda r: F.size(r) > 2), F.lit(False))
        none = F.expr(f"cast(array() AS {geo.PARTS_TYPE})")
        parts = F.when(long, kernels.simplify_udf(tolerance)(F.when(long, parts).otherwise(none))).otherwise(parts)
    rest = [c for c in df.columns if c not in GEOMETRY_COLUMNS]
    points = source.select(*rest, F.explode(geo.vertices(parts)).alias("_v")).select(
        *rest, F.col("_v.x").alias("lon"), F.col("_v.y").alias("lat"))
    return points.distinct() if dedup else points
