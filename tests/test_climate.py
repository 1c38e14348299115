"""Climate kernels and operators with published or hand-checked values."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrahaz.functions import kernels as K
from terrahaz.functions import values as V
from terrahaz.operators import climate as C

# Van Wagner and Pickett (1985), first days of the sample run.
WEATHER = [(17.0, 42.0, 25.0, 0.0), (20.0, 21.0, 25.0, 2.4), (8.5, 40.0, 17.0, 0.0)]
PUBLISHED = [(87.7, 8.5, 19.0, 10.9, 8.5, 10.1), (86.2, 10.4, 23.6, 8.8, 10.4, 9.3), (87.0, 11.8, 26.1, 6.5, 11.7, 7.6)]


def daily(spark, cells=1):
    rows = [("m", "s", "r", 46.0 + c, 0.0, f"2001-04-{13 + i}", t, h, w, p)
            for c in range(cells) for i, (t, h, w, p) in enumerate(WEATHER)]
    return spark.createDataFrame(
        rows, "model string, scenario string, member string, lat double, lon double, date string, tasmax double, "
              "hurs double, sfcwind double, pr double").withColumn("date", F.to_date("date"))


def test_fire_weather_published_days(spark):
    out = C.fwi(daily(spark)).orderBy("date").collect()
    for row, want in zip(out, PUBLISHED):
        got = [row[c] for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")]
        assert got == [pytest.approx(v, abs=0.06) for v in want]


def test_fire_weather_carries_state_over_a_split(spark):
    whole = C.moisture_codes(daily(spark, 3))
    first = C.moisture_codes(daily(spark, 3).filter("date < '2001-04-15'"))
    state = C.last_state(first, [*C.SERIES, "lat", "lon"])
    rest = C.moisture_codes(daily(spark, 3).filter("date >= '2001-04-15'"), init=state)
    want = {(r["lat"], str(r["date"])): r["dc"] for r in whole.filter("date = '2001-04-15'").collect()}
    got = {(r["lat"], str(r["date"])): r["dc"] for r in rest.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def years(spark, *chosen):
    rows = [("m", "s", r, lat, 0.0, f"{y}-{m:02d}-10", 12.0 + m, 30.0 + y % 7, 10.0, float(m % 3))
            for y in chosen for m in (3, 6, 9) for r in ("r1", "r2") for lat in (46.0, 47.0)]
    return spark.createDataFrame(
        rows, "model string, scenario string, member string, lat double, lon double, date string, tasmax double, "
              "hurs double, sfcwind double, pr double").withColumn("date", F.to_date("date"))


def codes_by_day(df):
    return {(r["member"], r["lat"], str(r["date"])): (r["ffmc"], r["dmc"], r["dc"]) for r in df.collect()}


def test_pending_years_start_from_the_store(spark):
    """Each pending run equals the whole record, a run without a year before it starts anew."""
    keys = [*C.SERIES, "lat", "lon"]
    whole = C.moisture_codes(years(spark, 2000, 2001, 2002, 2003, 2004))
    store = C.last_state(whole, keys).filter("year IN (2000, 2002)").select(*keys, "year", "ffmc", "dmc", "dc")
    want = codes_by_day(whole)
    got = codes_by_day(C.moisture_codes(years(spark, 2001, 2003, 2004), store))
    assert got == {k: pytest.approx(want[k]) for k in got} and len(got) == 36
    # 2001 is walked in this run: the store's older value of it has no say
    stale = store.withColumn("year", F.lit(2003)).withColumn("dc", F.lit(999.0))
    got = codes_by_day(C.moisture_codes(years(spark, 2003, 2004), store.unionByName(stale)))
    assert got == {k: pytest.approx(want[k]) for k in got}


def test_a_year_without_days_ends_a_run(spark):
    fresh, after = codes_by_day(C.moisture_codes(years(spark, 2005))), codes_by_day(C.moisture_codes(years(spark, 2002, 2003, 2005)))
    assert {k: v for k, v in after.items() if "2005" in k[2]} == {k: pytest.approx(v) for k, v in fresh.items()}
    joined = codes_by_day(C.moisture_codes(years(spark, 2004, 2005)))
    assert joined["r1", 46.0, "2005-03-10"] != pytest.approx(fresh["r1", 46.0, "2005-03-10"])


def test_repeated_rows_null_dates_and_empty_input(spark):
    df = years(spark, 2001)
    twice = df.unionByName(df).unionByName(df.limit(1).withColumn("date", F.lit(None).cast("date")))
    assert codes_by_day(C.moisture_codes(twice)) == {k: pytest.approx(v) for k, v in codes_by_day(C.moisture_codes(df)).items()}
    assert C.moisture_codes(df.limit(0)).collect() == []


def test_fire_weather_work_follows_the_days_of_a_cell(monkeypatch):
    """Cells that never share a date advance together; each gets what it gets alone, with repeats, gaps of years and stored codes."""
    rng = np.random.default_rng(3)
    rows = []
    for cell in range(40):
        days = 40 * rng.permutation(120)[:5] + cell
        days = np.append(np.append(days, days[0]), days.max() + 1100)
        rows += [(int(d), 0, cell, *rng.uniform(5, 30, 2), *rng.uniform(10, 60, 2)) for d in days]
        rows += [(int(days.max()) - 400, 1, cell, 80.0 + cell / 9, 20.0, 200.0 + cell)]
    rows = sorted(rows)

    def walked(rows):
        columns = list(zip(*rows))
        known = [k == 1 for k in columns[1]]
        numbers = np.array([r[3:] if r[1] == 0 else (None,) * 4 for r in rows], float).T
        codes = np.array([r[3:] if r[1] else (None,) * 3 for r in rows], float).T
        cells = np.array(columns[2], np.int64)
        table = pa.table({"date": pa.array(columns[0], pa.int32()).cast(pa.date32()), "_kind": pa.array(columns[1], pa.int8()), "_key": cells,
                          "lat": 2.0 * cells - 40, **dict(zip(K.WEATHER, numbers)), **dict(zip(K.START, codes))})
        out = pa.Table.from_batches(K.walk_days(iter(table.to_batches(max_chunksize=97)), K.DayWalk(), ["date", "_key"]))
        return sorted((r["_key"], r["date"], *(round(r[c], 9) for c in K.START)) for r in out.to_pylist()), sum(not k for k in known)

    alone = [r for cell in range(40) for r in walked([row for row in rows if row[2] == cell])[0]]
    calls, real = [], K.next_codes
    monkeypatch.setattr(K, "next_codes", lambda *a: calls.append(1) or real(*a))
    together, days = walked(rows)
    assert together == alone and len(together) == days
    assert len(calls) < days / 10  # a step a date made 240 of them


def test_fire_weather_gap_keeps_state(spark):
    df = daily(spark).withColumn("hurs", F.when(F.col("date") != "2001-04-14", F.col("hurs")))
    rows = C.moisture_codes(df).orderBy("date").collect()
    assert rows[1]["ffmc"] is None and rows[2]["ffmc"] is not None


def test_block_size_does_not_change_results(spark):
    def run(deg):
        return sorted((r["lat"], str(r["date"]), round(r["fwi"], 9)) for r in C.fwi(daily(spark, 6), block_deg=deg).collect())

    assert run(0.5) == run(10.0)


def test_incomplete_gamma_and_quantile():
    assert K.lower_gamma_ratio(np.array([1.0, 2.0, 0.5]), np.array([1.0, 3.0, 0.2])) == pytest.approx(
        [1 - math.exp(-1), 1 - math.exp(-3) * 4, math.erf(math.sqrt(0.2))])
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999])
    assert K.normal_cdf(K.normal_quantile(p)) == pytest.approx(p, rel=1e-9)
    assert K.normal_quantile(np.array([0.975]))[0] == pytest.approx(1.959963984540054)


def test_pearson3_limits():
    one = np.ones(1)
    assert K.pearson3_cdf(0 * one, 0 * one, one, 0 * one)[0] == pytest.approx(0.5)
    # skew 2 is a shifted exponential: P(X <= loc) = 1 - exp(-1)
    assert K.pearson3_cdf(0 * one, 0 * one, one, 2 * one)[0] == pytest.approx(1 - math.exp(-1))
    assert K.pearson3_cdf(0 * one, 0 * one, one, -2 * one)[0] == pytest.approx(math.exp(-1))
    score = K.standardise(np.array([-5.0]), np.zeros(1), np.zeros(1), one, 2 * one)
    assert score[0] == pytest.approx(K.normal_quantile(np.array([0.0005]))[0], abs=1e-9) or score[0] == -3.09


def test_l_moments_of_a_known_sample(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 10)], "k int, v double")
    r = C.l_moments(df, ["k"], "v").first()
    x = [1, 2, 3, 4, 10]
    n = 5
    b0 = sum(x) / n
    b1 = sum(j * v for j, v in enumerate(x)) / (n * (n - 1))
    b2 = sum(j * (j - 1) * v for j, v in enumerate(x)) / (n * (n - 1) * (n - 2))
    assert r["l1"] == b0 and r["l2"] == pytest.approx(2 * b1 - b0)
    assert r["t3"] == pytest.approx((6 * b2 - 6 * b1 + b0) / (2 * b1 - b0))


def test_gev_recovers_its_own_quantiles(spark):
    xi, alpha, k, n = 10.0, 3.0, 0.1, 400
    probs = [(i + 0.5) / n for i in range(n)]
    rows = [(1, xi + alpha / k * (1 - (-math.log(p)) ** k)) for p in probs]
    params = C.gev_parameters(C.l_moments(spark.createDataFrame(rows, "k0 int, v double"), ["k0"], "v")).first()
    assert params["k"] == pytest.approx(k, abs=0.01) and params["alpha"] == pytest.approx(alpha, rel=0.02)
    level = C.return_levels(spark.createDataFrame(rows, "k0 int, annual_max double"), ["k0"], [100]).first()
    assert level["return_level"] == pytest.approx(xi + alpha / k * (1 - (-math.log(0.99)) ** k), rel=0.02)


def test_return_levels_need_four_years(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k0 int, annual_max double")
    assert all(r["return_level"] is None for r in C.return_levels(df, ["k0"]).collect())


def test_gamma_expression(spark):
    rows = spark.createDataFrame([(x,) for x in (0.3, 1.0, 2.5, 7.0)], "x double").select("x", V.gamma(F.col("x")).alias("g"))
    for r in rows.collect():
        assert r["g"] == pytest.approx(math.gamma(r["x"]), rel=1e-12)


def series(spark, years=range(1990, 2000)):
    rng = np.random.default_rng(1)
    days = pd.date_range(f"{years[0]}-01-01", f"{years[-1]}-12-31")
    pdf = pd.DataFrame({"lat": 40.0, "lon": 1.0, "date": days.date, "pr": rng.gamma(0.6, 4, len(days)),
                        "tasmin": 5 + 8 * np.sin(days.dayofyear / 58), "tasmax": 15 + 9 * np.sin(days.dayofyear / 58)})
    return spark.createDataFrame(pdf)


def test_spei_is_standardised(spark):
    out = C.spei(C.pet_hargreaves(series(spark)), ["lat", "lon"], 3, 1990, 1999).toPandas()
    assert out["scaled"].isna().sum() == 2 and len(out) == 120
    vals = out["spei"].dropna()
    assert len(vals) == 118 and abs(vals.mean()) < 0.1 and 0.8 < vals.std() < 1.2
    assert vals.between(-3.09, 3.09).all()


def test_spei_needs_sixty_calibration_months(spark):
    short = series(spark, range(1990, 1993))
    assert C.spei(C.pet_hargreaves(short), ["lat", "lon"], 3, 1990, 1999).filter("spei IS NOT NULL").count() == 0


def test_pet_is_plausible(spark):
    r = C.pet_hargreaves(series(spark)).agg(F.avg("pet").alias("p"), F.min("pet").alias("m")).first()
    assert 1 < r["p"] < 6 and r["m"] >= 0


def test_zero_baseline_is_null(spark):
    base = spark.createDataFrame([(1, 5, 0.0)], "c int, doy int, baseline double")
    day = spark.createDataFrame([(1, 2.0)], "c int, pr double").withColumn("date", F.to_date(F.lit("2020-01-05")))
    assert C.precip_pct_change(day, base, ["c"]).first()["pr_percent_change"] is None


def test_future_periods(spark):
    got = [(r[0], r[1]) for r in C.future_periods(spark).orderBy("start_year").collect()]
    assert got == [(2015, 2044), (2045, 2074), (2075, 2100)]


def test_slope_default(spark):
    df = spark.createDataFrame([(1, 0.0, 3.0)], "m int, p double, x double")
    assert C.log_odds_slope(df, ["m"], "p", "x").first()["beta1"] == 0.1


def test_sliding_sum_stops_at_missing_months(spark):
    import datetime

    from pyspark.sql import functions as F

    from terrahaz.operators import climate

    months = [(2000, 1), (2000, 2), (2000, 3), (2000, 4), (2005, 7), (2005, 8)]
    df = spark.createDataFrame([(1, datetime.date(y, m, 1), 1.0) for y, m in months], "cell int, month_start date, v double")
    got = [r["scaled"] for r in climate.sliding_sum(df, ["cell"], "v", 3).orderBy(F.col("month_start")).collect()]
    assert got == [None, None, 3.0, 3.0, None, None]


def test_grid_rows_beside_the_spec_are_left_out(spark):
    from terrahaz.operators import grid

    cells = spark.createDataFrame([(float(i), 0.0, float(i)) for i in range(10)], "lon double, lat double, v double")
    spec = grid.GridSpec(0.0, 0.0, 1.0, 1.0, 3, 1)
    point = spark.createDataFrame([(7, 8.0, 0.0)], "osm_id int, lon double, lat double")
    assert [r["v"] for r in grid.sample_points(cells, point, spec).collect()] == [2.0]
    assert spec.keyed(cells).count() == 3


def test_targets_beside_the_source_are_null(spark):
    from terrahaz.operators import grid

    cells = spark.createDataFrame([("a", float(i), 0.0, float(i)) for i in range(3)], "k string, lon double, lat double, v double")
    source, target = grid.GridSpec(0.0, 0.0, 1.0, 1.0, 3, 1), grid.GridSpec(-2.0, 0.0, 1.0, 1.0, 7, 1)
    for method in ("nearest", "linear"):
        got = {r["lon"]: r["v"] for r in grid.align(cells, source, target, "v", method, ["k"]).collect()}
        assert len(got) == 7 and [got[x] for x in (0.0, 1.0, 2.0)] == [0.0, 1.0, 2.0] and got[-2.0] is None and got[4.0] is None


def test_column_distributions_equal_the_kernels(spark):
    from terrahaz.functions import distributions as D

    rng = np.random.default_rng(4)
    a = np.concatenate([rng.uniform(0.02, 100, 300), 10 ** rng.uniform(2, 6, 100)])
    y = np.maximum(a + rng.uniform(-3, 4, 400) * np.sqrt(a), 1e-6)
    df = spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(zip(a, y))], "i int, a double, y double")
    got = df.select("i", F.when(F.col("a") > 100, D._large_gamma_ratio(F.col("a"), F.col("y"))).otherwise(
        D.lower_gamma_ratio(F.col("a"), F.col("y"))).alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    assert got == pytest.approx(K.lower_gamma_ratio(a, y), abs=1e-8)
    p = np.concatenate([np.linspace(1e-4, 1 - 1e-4, 200), [0.075, 0.925]])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double").select("i", D.normal_quantile(F.col("p")).alias("z")).orderBy("i")
    assert got.toPandas()["z"].to_numpy() == pytest.approx(K.normal_quantile(p), abs=1e-9)


def test_pearson_scores_equal_the_kernels(spark):
    from terrahaz.functions import distributions as D

    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal(900, 400)), float(rng.choice([0, 0.2])), 900.0, float(rng.uniform(50, 300)), float(rng.choice([0, 1e-3, -0.5, 0.7, 2.5, -4])))
            for i in range(400)] + [(400, 0.0, 0.1, 5.0, 2.0, 1.0), (401, 0.0, 0.0, 5.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, p0 double, loc double, scale double, skew double")
    got = df.select("i", D.pearson3_score("x", "p0", "loc", "scale", "skew").alias("s")).orderBy("i").toPandas()["s"].to_numpy()
    x, p0, loc, scale, skew = (np.array([r[k] for r in rows]) for k in range(1, 6))
    assert got == pytest.approx(K.standardise(x, p0, loc, scale, skew), abs=1e-7)
