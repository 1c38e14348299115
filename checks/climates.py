"""Climate indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.harness import Tables, check
from checks.recurrence import codes_sql
from checks.rounding import r6
from terrahaz.operators import climate as C
from terrahaz.operators import grid as G

CELL = ["model", "lat", "lon"]

BASELINE = """
base AS (SELECT model, lat, lon, dayofyear(date) AS doy, avg(pr) AS b FROM {fx_grid}
         WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY 1, 2, 3, 4)
"""


@check("baseline_day_of_year", f"""
WITH {BASELINE} SELECT model, lat, lon, cast(doy AS int) AS doy, round(b, 6) AS baseline FROM base
""")
def baseline_day_of_year(t: Tables):
    return r6(C.baseline_doy(t.fx_grid, CELL, "pr", 1995, 1998), ["baseline"])


@check("precip_percent_change", f"""
WITH {BASELINE}
SELECT g.model, g.lat, g.lon, g.date, round((pr - b) / nullif(b, 0) * 100e0, 6) AS pr_percent_change
FROM {{fx_grid}} g LEFT JOIN base ON base.model = g.model AND base.lat = g.lat AND base.lon = g.lon
 AND base.doy = dayofyear(g.date)
""")
def precip_percent_change(t: Tables):
    base = C.baseline_doy(t.fx_grid, CELL, "pr", 1995, 1998)
    daily = t.fx_grid.select(*CELL, "date", "pr")
    return r6(C.precip_pct_change(daily, base, CELL).drop("pr"), ["pr_percent_change"])


# Two overlapping records of four years each stand for the historical and the future run.
MAXIMA = """
records AS (SELECT lat, lon, date, pr, 'historical' AS scenario FROM {fx_grid} WHERE year(date) <= 1998
            UNION ALL SELECT lat, lon, date, pr, 'ssp245' AS scenario FROM {fx_grid} WHERE year(date) >= 1998),
maxima AS (SELECT lat, lon, scenario, cast(month(date) AS int) AS month, cast(year(date) AS int) AS year,
                  max(pr) AS annual_max FROM records GROUP BY 1, 2, 3, 4, 5)
"""


def _maxima(t: Tables):
    old = t.fx_grid.filter(F.year("date") <= 1998).withColumn("scenario", F.lit("historical"))
    new = t.fx_grid.filter(F.year("date") >= 1998).withColumn("scenario", F.lit("ssp245"))
    return C.annual_max(old.unionByName(new), ["lat", "lon", "scenario"])


@check("annual_monthly_maximum", f"WITH {MAXIMA} SELECT lat, lon, scenario, month, year, annual_max FROM maxima")
def annual_monthly_maximum(t: Tables):
    return _maxima(t)


def moments_sql(source: str, keys: str, value: str) -> str:
    return f"""
ranked AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1e0 AS j,
                  count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE {value} IS NOT NULL),
sums AS (SELECT {keys}, count(*) AS n, avg(x) AS b0, avg(CASE WHEN n > 1 THEN x * j / (n - 1e0) END) AS b1,
                avg(CASE WHEN n > 2 THEN x * j * (j - 1e0) / ((n - 1e0) * (n - 2e0)) END) AS b2 FROM ranked GROUP BY {keys}),
moments AS (SELECT {keys}, n, b0 AS l1, 2e0 * b1 - b0 AS l2,
                   (6e0 * b2 - 6e0 * b1 + b0) / nullif(2e0 * b1 - b0, 0) AS t3 FROM sums)
"""


MONTH_KEYS = "lat, lon, scenario, month"


@check("l_moments", f"""
WITH {MAXIMA}, {moments_sql('maxima', MONTH_KEYS, 'annual_max')}
SELECT {MONTH_KEYS}, n, round(l1, 6) AS l1, round(l2, 6) AS l2,
       CASE WHEN abs(l2) > 1e-9 THEN round(t3, 6) END AS t3 FROM moments
""")
def l_moments(t: Tables):
    out = C.l_moments(_maxima(t), MONTH_KEYS.split(", "), "annual_max")
    return r6(out.withColumn("t3", F.when(F.abs("l2") > 1e-9, F.col("t3"))), ["l1", "l2", "t3"])


LEVELS = f"""
WITH {MAXIMA}, {moments_sql('maxima', MONTH_KEYS, 'annual_max')},
shape AS (SELECT *, 2e0 / (3e0 + t3) - ln(2e0) / ln(3e0) AS c FROM moments WHERE n >= 4 AND l2 > 1e-9 AND abs(t3) < 1),
k AS (SELECT *, 7.8590e0 * c + 2.9554e0 * c * c AS k FROM shape),
a AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN l2 / ln(2e0) ELSE l2 * k / ((1e0 - pow(2e0, -k)) * gamma(1e0 + k)) END AS alpha FROM k),
x AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN l1 - 0.5772156649015329e0 * alpha
                     ELSE l1 - alpha * (1e0 - gamma(1e0 + k)) / k END AS xi FROM a),
levels AS (SELECT m.lat, m.lon, m.scenario, m.month, cast(rp AS int) AS return_period,
   CASE WHEN abs(k) < 1e-6 THEN xi - alpha * ln(-ln(1e0 - 1e0 / rp))
        ELSE xi + alpha / k * (1e0 - pow(-ln(1e0 - 1e0 / rp), k)) END AS return_level
  FROM moments m CROSS JOIN (SELECT unnest([2, 5, 20, 100, 500]) AS rp) p
  LEFT JOIN x ON x.lat = m.lat AND x.lon = m.lon AND x.scenario = m.scenario AND x.month = m.month)
"""


def _levels(t: Tables):
    return C.return_levels(_maxima(t), MONTH_KEYS.split(", "))


@check("return_levels", LEVELS + f"""
SELECT {MONTH_KEYS}, return_period, round(return_level, 5) AS return_level FROM levels
""")
def return_levels(t: Tables):
    # Groups too small or flat to fit carry a NULL level.
    return r6(_levels(t), ["return_level"], 5)


@check("pluvial_change_factor", LEVELS + """
SELECT lat, lon, month, return_period, round(max(CASE WHEN scenario = 'ssp245' THEN return_level END)
  / nullif(max(CASE WHEN scenario = 'historical' THEN return_level END), 0), 5) AS change_factor
FROM levels GROUP BY ALL HAVING count(CASE WHEN scenario = 'ssp245' THEN 1 END) > 0 AND count(CASE WHEN scenario = 'historical' THEN 1 END) > 0
""")
def pluvial_change_factor(t: Tables):
    levels = _levels(t)
    keys = ["lat", "lon", "month", "return_period"]
    future = levels.filter("scenario = 'ssp245'").drop("scenario")
    past = levels.filter("scenario = 'historical'")
    return r6(C.change_factor(future, past, keys).drop("return_level"), ["change_factor"], 5)


@check("period_ensemble", """
WITH yearly AS (
  SELECT model, lat, lon, cast(2015 + floor((y - 2015) / 30) * 30 AS int) AS start_year,
         cast(least(2015 + floor((y - 2015) / 30) * 30 + 29, 2100) AS int) AS end_year, pr
  FROM (SELECT *, cast(year(date) + 20 + (year(date) - 1995) * 11 AS int) AS y FROM {fx_grid}) q WHERE y BETWEEN 2015 AND 2100),
per_model AS (SELECT lat, lon, start_year, end_year, model, avg(pr) AS v FROM yearly GROUP BY ALL)
SELECT lat, lon, start_year, end_year, round(avg(v), 6) AS ensemble_mean, round(quantile_cont(v, 0.5), 6) AS ensemble_median,
       round(quantile_cont(v, 0.75), 6) AS ensemble_q3, cast(count(*) AS int) AS ensemble_count
FROM per_model GROUP BY ALL
""")
def period_ensemble(t: Tables):
    year = (F.year("date") + 20 + (F.year("date") - 1995) * 11).cast("int")
    start, end = C.period_of(F.col("_y"))
    df = t.fx_grid.withColumn("_y", year).withColumns({"start_year": start, "end_year": end}).filter(
        "start_year IS NOT NULL")
    keys = ["lat", "lon", "start_year", "end_year"]
    return r6(G.ensemble_stats(df, keys, "pr").select(
        *keys, "ensemble_mean", "ensemble_median", "ensemble_q3", "ensemble_count"),
        ["ensemble_mean", "ensemble_median", "ensemble_q3"])


FWI_SQL = """
SELECT model, lat, lon, date, round(isi, 6) AS isi, round(bui, 6) AS bui,
       round(CASE WHEN b > 1 THEN exp(2.72e0 * pow(0.434e0 * ln(b), 0.647e0)) ELSE b END, 6) AS fwi
FROM (SELECT *, 0.1e0 * isi * CASE WHEN bui <= 80 THEN 0.626e0 * pow(bui, 0.809e0) + 2e0
        ELSE 1000e0 / (25e0 + 108.64e0 * exp(-0.023e0 * bui)) END AS b
 FROM (SELECT *, 0.208e0 * exp(0.05039e0 * sfcwind) * 91.9e0 * exp(-0.1386e0 * m) * (1e0 + pow(m, 5.31e0) / 4.93e7) AS isi,
         greatest(CASE WHEN dmc <= 0.4e0 * dc THEN 0.8e0 * dmc * dc / (dmc + 0.4e0 * dc)
           ELSE dmc - (1e0 - 0.8e0 * dc / (dmc + 0.4e0 * dc)) * (0.92e0 + pow(0.0114e0 * dmc, 1.7e0)) END, 0e0) AS bui
  FROM (SELECT *, 147.2e0 * (101e0 - ffmc) / (59.5e0 + ffmc) AS m
   FROM (SELECT model, lat, lon, date, sfcwind, 50e0 + pr AS ffmc, tasmax * 3e0 AS dmc, tasmin * 10e0 + 50e0 AS dc FROM {fx_grid}) a) b) c) d
"""


@check("fire_weather_indices", FWI_SQL)
def fire_weather_indices(t: Tables):
    codes = t.fx_grid.select(
        *CELL, "date", "sfcwind", (F.col("pr") + 50.0).alias("ffmc"), (F.col("tasmax") * 3.0).alias("dmc"),
        (F.col("tasmin") * 10.0 + 50.0).alias("dc"))
    return r6(C.with_indices(codes).select(*CELL, "date", "isi", "bui", "fwi"), ["isi", "bui", "fwi"])


SERIES = "model, scenario, member, lat, lon"
CODES = "WITH RECURSIVE " + codes_sql(SERIES, f"SELECT {SERIES}, date, tasmax, pr, hurs, sfcwind FROM {{fx_grid}}")


@check("fire_weather_recurrence", CODES + f"""
SELECT {SERIES}, date, round(ffmc, 5) AS ffmc, round(dmc, 5) AS dmc, round(dc, 5) AS dc FROM codes WHERE rn > 0
""")
def fire_weather_recurrence(t: Tables):
    out = C.fwi(t.fx_grid)
    return r6(out.select(*C.SERIES, "lat", "lon", "date", "ffmc", "dmc", "dc"), ["ffmc", "dmc", "dc"], 5)


@check("fire_weather_last_state", CODES + f"""
SELECT {SERIES}, cast(year(date) AS int) AS year, round(ffmc, 5) AS ffmc, round(dmc, 5) AS dmc, round(dc, 5) AS dc FROM (
  SELECT *, row_number() OVER (PARTITION BY {SERIES}, year(date) ORDER BY date DESC) AS pick FROM codes WHERE rn > 0) q WHERE pick = 1
""")
def fire_weather_last_state(t: Tables):
    codes = C.moisture_codes(t.fx_grid)
    return r6(C.last_state(codes, [*C.SERIES, "lat", "lon"]).withColumn("year", F.col("year").cast("int")).drop("date"),
              ["ffmc", "dmc", "dc"], 5)


@check("last_state_per_year", """
SELECT model, lat, lon, year, ffmc, dmc, dc FROM (
  SELECT model, lat, lon, cast(year(date) AS int) AS year, pr AS ffmc, tasmax AS dmc, tasmin AS dc,
         row_number() OVER (PARTITION BY model, lat, lon, year(date) ORDER BY date DESC) AS rn FROM {fx_grid}) q WHERE rn = 1
""")
def last_state_per_year(t: Tables):
    codes = t.fx_grid.select(*CELL, "date", F.col("pr").alias("ffmc"), F.col("tasmax").alias("dmc"),
                             F.col("tasmin").alias("dc"))
    return C.last_state(codes, CELL).withColumn("year", F.col("year").cast("int")).drop("date")


PET = """
pet AS (
  SELECT lat, lon, date, pr, greatest(0.0023e0 * ra / (2.5e0 - 0.002361e0 * (tasmin + tasmax) / 2e0)
      * sqrt(greatest(tasmax - tasmin, 0e0)) * ((tasmin + tasmax) / 2e0 + 17.8e0), 0e0) AS pet
  FROM (SELECT *, 24e0 * 60e0 / pi() * 0.0820e0 * (1e0 + 0.033e0 * cos(ang))
          * (ws * sin(phi) * sin(decl) + cos(phi) * cos(decl) * sin(ws)) AS ra
   FROM (SELECT *, acos(greatest(-1e0, least(1e0, -tan(phi) * tan(decl)))) AS ws
    FROM (SELECT *, radians(lat) AS phi, 2e0 * pi() / 365e0 * dayofyear(date) AS ang,
                 0.409e0 * sin(2e0 * pi() / 365e0 * dayofyear(date) - 1.39e0) AS decl FROM {fx_cell_daily}) a) b) c)
"""


@check("pet_hargreaves", f"WITH {PET} SELECT lat, lon, date, round(pet, 6) AS pet FROM pet")
def pet_hargreaves(t: Tables):
    return r6(C.pet_hargreaves(t.fx_cell_daily).select("lat", "lon", "date", "pet"), ["pet"])


SCALED = PET + """,
monthly AS (SELECT lat, lon, cast(date_trunc('month', date) AS date) AS month_start,
                   greatest(sum(pr), 0e0) - sum(pet) + 1000e0 AS balance FROM pet GROUP BY 1, 2, 3),
scaled AS (SELECT *, CASE WHEN count(balance) OVER w = 3 THEN sum(balance) OVER w END AS scaled FROM monthly
           WINDOW w AS (PARTITION BY lat, lon ORDER BY year(month_start) * 12 + month(month_start) RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
"""


def _scaled(t: Tables):
    daily = C.pet_hargreaves(t.fx_cell_daily)
    return C.sliding_sum(C.water_balance(daily, ["lat", "lon"]), ["lat", "lon"], "balance", 3)


@check("water_balance_sliding_sum", f"WITH {SCALED} SELECT lat, lon, month_start, round(scaled, 5) AS scaled FROM scaled")
def water_balance_sliding_sum(t: Tables):
    return r6(_scaled(t).select("lat", "lon", "month_start", "scaled"), ["scaled"], 5)


CALIBRATED = SCALED + f""", cal AS (
  SELECT lat, lon, cast(month(month_start) AS int) AS month, scaled FROM (
    SELECT *, min(year(month_start)) OVER (PARTITION BY lat, lon) AS y0, max(year(month_start)) OVER (PARTITION BY lat, lon) AS y1
    FROM scaled) q WHERE scaled IS NOT NULL AND (y0 > 1995 OR y1 + 1 < 2000 OR year(month_start) BETWEEN 1995 AND 2000)),
{moments_sql('cal', 'lat, lon, month', 'scaled')}
"""


@check("drought_l_moments", f"""
WITH {CALIBRATED} SELECT lat, lon, month, n, round(l1, 4) AS l1, round(l2, 4) AS l2, round(t3, 4) AS t3 FROM moments WHERE n >= 4
""")
def drought_l_moments(t: Tables):
    params = C.drought_parameters(_scaled(t), ["lat", "lon"], 1995, 2000)
    return r6(params.select("lat", "lon", "month", "n", "l1", "l2", "t3"), ["l1", "l2", "t3"], 4)


@check("drought_parameters", f"""
WITH {CALIBRATED}, f AS (SELECT *, CASE WHEN abs(t3) < 0.333333333e0 THEN (1e0 + 0.2906e0 * tl) / (tl * (1e0 + tl * (0.1882e0 + tl * 0.0442e0)))
    ELSE th * (0.36067e0 + th * (-0.59567e0 + th * 0.25361e0)) / (1e0 + th * (-2.78861e0 + th * (2.56096e0 + th * -0.77045e0))) END AS a
  FROM (SELECT *, pi() * 3e0 * t3 * t3 AS tl, 1e0 - abs(t3) AS th FROM moments WHERE n >= 4 AND l2 > 0 AND abs(t3) > 1e-3) m)
SELECT lat, lon, month, 0e0 AS p_zero, round(l1, 3) AS loc, round(sqrt(pi()) * l2 * exp(lgamma(a) - lgamma(a + 0.5e0)) * sqrt(a), 3) AS scale,
       round(CASE WHEN t3 < 0 THEN -2e0 ELSE 2e0 END / sqrt(a), 3) AS skew FROM f
""")
def drought_parameters(t: Tables):
    params = C.drought_parameters(_scaled(t), ["lat", "lon"], 1995, 2000).filter("abs(t3) > 1e-3")
    return r6(params.select("lat", "lon", "month", "p_zero", "loc", "scale", "skew"), ["loc", "scale", "skew"], 3)


def _quantile(p: str) -> str:
    """Normal quantile by bisection: forty halvings of -4..4 on the error function's series."""
    return (f"list_reduce(list_concat([0e0], list_transform(range(1, 40), lambda k: 4e0 / pow(2e0, k))), "
            f"lambda z, h: CASE WHEN {_normal('z')} < {p} THEN z + h ELSE z - h END)")


def _normal(z: str) -> str:
    """Normal distribution function by its power series."""
    return (f"(0.5e0 + exp(-({z}) * ({z}) / 2e0) / sqrt(2e0 * pi()) * ({z}) * list_sum(list_transform(range(0, 60), "
            f"lambda j: exp(j * ln(greatest(({z}) * ({z}), 1e-300)) - (lgamma(2e0 * j + 2e0) - lgamma(j + 1e0) - j * ln(2e0))))))")


@check("spei_three_months", f"""
WITH {CALIBRATED}, f AS (SELECT *, CASE WHEN abs(t3) < 0.333333333e0 THEN (1e0 + 0.2906e0 * tl) / (tl * (1e0 + tl * (0.1882e0 + tl * 0.0442e0)))
    ELSE th * (0.36067e0 + th * (-0.59567e0 + th * 0.25361e0)) / (1e0 + th * (-2.78861e0 + th * (2.56096e0 + th * -0.77045e0))) END AS a
  FROM (SELECT *, pi() * 3e0 * t3 * t3 AS tl, 1e0 - abs(t3) AS th FROM moments WHERE n >= 4 AND l2 > 0 AND abs(t3) > 1e-6) m),
par AS (SELECT lat, lon, month, l1 AS loc, sqrt(pi()) * l2 * exp(lgamma(a) - lgamma(a + 0.5e0)) * sqrt(a) AS scale,
  CASE WHEN t3 < 0 THEN -2e0 ELSE 2e0 END / sqrt(a) AS skew FROM f),
months AS (SELECT s.lat, s.lon, s.month_start, s.scaled, p.loc, p.scale, p.skew, count(CASE WHEN year(s.month_start) BETWEEN 1995 AND 2000 THEN 1 END)
    OVER (PARTITION BY s.lat, s.lon) AS months FROM scaled s LEFT JOIN par p ON p.lat = s.lat AND p.lon = s.lon AND p.month = month(s.month_start)),
arg AS (SELECT *, 4e0 / (skew * skew) AS a, 2e0 / skew * ((scaled - loc) / scale + 2e0 / skew) AS y, loc - 2e0 * scale / skew AS edge
  FROM months WHERE months >= 60 AND scaled IS NOT NULL AND scale IS NOT NULL),
cdf AS (SELECT *, CASE WHEN y <= 0 THEN 0e0 ELSE exp(a * ln(y) - y - lgamma(a + 1e0)) * list_sum(list_transform(
    range(0, cast(ceil(30e0 * sqrt(a) + greatest(y - a, 0e0) * 3e0 + 80e0) AS bigint)), lambda k: exp(k * ln(y) + lgamma(a + 1e0) - lgamma(a + 1e0 + k)))) END AS g FROM arg),
prob AS (SELECT *, greatest(least(CASE WHEN scaled >= edge AND skew < 0 THEN 0.9995e0 WHEN scaled <= edge AND skew > 0 THEN 0.0005e0
    WHEN scaled < 0.0005e0 THEN 0.0005e0 WHEN skew > 0 THEN g ELSE 1e0 - g END, 0.9995e0), 0.0005e0) AS p FROM cdf),
score AS (SELECT lat, lon, month_start, greatest(least({_quantile('p')}, 3.09e0), -3.09e0) AS spei FROM prob)
SELECT m.lat, m.lon, m.month_start, round(m.scaled, 5) AS scaled, round(s.spei, 4) AS spei
FROM months m LEFT JOIN score s ON s.lat = m.lat AND s.lon = m.lon AND s.month_start = m.month_start
""")
def spei_three_months(t: Tables):
    out = C.spei(C.pet_hargreaves(t.fx_cell_daily), ["lat", "lon"], 3, 1995, 2000)
    return r6(r6(out, ["spei"], 4), ["scaled"], 5)


@check("monthly_onto_days", """
WITH m AS (SELECT lat, lon, date_trunc('month', date) AS ms, avg(pr) AS v FROM {fx_cell_daily} GROUP BY 1, 2, 3)
SELECT d.lat, d.lon, d.date, round(m.v, 6) AS v FROM {fx_cell_daily} d
LEFT JOIN m ON m.lat = d.lat AND m.lon = d.lon AND m.ms = date_trunc('month', d.date)
""")
def monthly_onto_days(t: Tables):
    monthly = G.monthly_mean(t.fx_cell_daily, ["lat", "lon"], ["pr"]).withColumnRenamed("pr", "v")
    days = t.fx_cell_daily.select("lat", "lon", "date")
    return r6(C.monthly_onto_days(monthly, days, ["lat", "lon"], "v"), ["v"])


@check("forward_fill_days", """
SELECT lat, lon, date, last_value(CASE WHEN pr > 30 THEN pr END IGNORE NULLS)
         OVER (PARTITION BY lat, lon ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM {fx_cell_daily}
""")
def forward_fill_days(t: Tables):
    df = t.fx_cell_daily.select("lat", "lon", "date", F.when(F.col("pr") > 30, F.col("pr")).alias("v"))
    return C.forward_fill(df, ["lat", "lon"], "date", "v")


@check("concat_time_keep_first", """
SELECT lat, lon, date, pr FROM (
  SELECT *, row_number() OVER (PARTITION BY lat, lon, date ORDER BY part) AS rn FROM (
    SELECT lat, lon, date, max(pr) AS pr, 0 AS part FROM {fx_grid} WHERE model < 'M4' GROUP BY 1, 2, 3
    UNION ALL SELECT lat, lon, date, max(pr) AS pr, 1 AS part FROM {fx_grid} WHERE model >= 'M4' GROUP BY 1, 2, 3) u) q WHERE rn = 1
""")
def concat_time_keep_first(t: Tables):
    def part(where: str):
        return t.fx_grid.filter(where).groupBy("lat", "lon", "date").agg(F.max("pr").alias("pr"))

    return C.concat_time(part("model < 'M4'"), part("model >= 'M4'"), ["lat", "lon"])


@check("gamma_parameters", """
SELECT lat, lon, month, p_zero, round(alpha, 5) AS alpha, round(m / alpha, 5) AS beta FROM (
  SELECT *, CASE WHEN a > 1e-12 THEN (1e0 + sqrt(1e0 + 4e0 * a / 3e0)) / (4e0 * a) END AS alpha FROM (
    SELECT lat, lon, cast(month(date) AS int) AS month, avg(CASE WHEN pr = 0 THEN 1e0 ELSE 0e0 END) AS p_zero,
           avg(CASE WHEN pr > 0 THEN pr END) AS m,
           ln(avg(CASE WHEN pr > 0 THEN pr END)) - avg(CASE WHEN pr > 0 THEN ln(pr) END) AS a
    FROM {fx_grid} GROUP BY 1, 2, 3) q) r
""")
def gamma_parameters(t: Tables):
    df = t.fx_grid.select("lat", "lon", F.month("date").cast("int").alias("month"), "pr")
    return r6(C.gamma_parameters(df, ["lat", "lon", "month"], "pr"), ["alpha", "beta"], 5)


BURN_COLUMNS = """
(SELECT model, lat, lon, date, pr / 64e0 AS p, tasmin + 3e0 AS f0, tasmax + 1e0 AS f1, cast(month(date) AS int) AS month FROM {fx_grid})
"""


def _burn(t: Tables):
    return t.fx_grid.select(*CELL, "date", (F.col("pr") / 64.0).alias("p"), (F.col("tasmin") + 3.0).alias("f0"),
                            (F.col("tasmax") + 1.0).alias("f1"), F.month("date").cast("int").alias("month"))


@check("future_burn_relative", f"""
SELECT model, lat, lon, date, round(least(greatest(p * (1e0 + (f1 - f0) / nullif(f1, 0)), 0e0), 1e0), 6) AS burn FROM {BURN_COLUMNS} q
""")
def future_burn_relative(t: Tables):
    out = _burn(t).withColumn("burn", C.future_burn_relative(F.col("p"), F.col("f0"), F.col("f1")))
    return r6(out.select(*CELL, "date", "burn"), ["burn"])


SLOPE = f"""
slope AS (SELECT month, coalesce(regr_slope(ln(p / (1e0 - p)), f0), 0.1e0) AS beta1 FROM {BURN_COLUMNS} q
          WHERE p > 0 AND p < 1 GROUP BY month)
"""


@check("log_odds_slope", f"WITH {SLOPE} SELECT month, round(beta1, 6) AS beta1 FROM slope")
def log_odds_slope(t: Tables):
    return r6(C.log_odds_slope(_burn(t), ["month"], "p", "f0"), ["beta1"])


@check("future_burn_odds", f"""
WITH {SLOPE}
SELECT model, lat, lon, date, round(least(greatest(p * exp(beta1 * (f1 - f0)) / (1e0 + p * (exp(beta1 * (f1 - f0)) - 1e0)), 0e0), 1e0), 6) AS burn,
       round(least(greatest(p * exp(beta1 * (f1 - f0)) / (1e0 + p * (exp(beta1 * (f1 - f0)) - 1e0)), 0e0), 1e0) * (f0 / 64e0), 6) AS joint
FROM {BURN_COLUMNS} q JOIN slope USING (month)
""")
def future_burn_odds(t: Tables):
    rows = _burn(t)
    slope = C.log_odds_slope(rows, ["month"], "p", "f0")
    out = rows.join(slope, "month").withColumn(
        "burn", C.future_burn_odds(F.col("p"), F.col("beta1"), F.col("f1") - F.col("f0")))
    # joint probability with a flame-length exceedance
    out = out.withColumn("joint", F.col("burn") * (F.col("f0") / 64.0))
    return r6(out.select(*CELL, "date", "burn", "joint"), ["burn", "joint"])
