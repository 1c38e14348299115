"""The daily fire-weather recurrence as a recursive SQL text over a ``days`` CTE.

``days`` has the key columns, lat, date, tasmax, pr, hurs and sfcwind, one row per
key and date.
"""

from __future__ import annotations

from terrahaz.functions.kernels import DAY_LENGTHS, DRYING


def _listed(values) -> str:
    return "[" + ", ".join(f"{v}e0" for v in values) + "]"


def codes_sql(keys: str, source: str) -> str:
    """CTEs ``days``, ``seq`` and ``codes`` (keys, date, sfcwind, ffmc, dmc, dc); start with WITH RECURSIVE."""
    key_list = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"d.{k} = s.{k}" for k in key_list)
    d_keys = ", ".join(f"d.{k}" for k in key_list)

    def fresh(code: str, start: str) -> str:
        """A whole year without days ends a run."""
        return f"(CASE WHEN year(s.date) < year(d.date) - 1 THEN {start} ELSE s.{code} END)"

    rate = ("(0.424e0 * (1e0 - pow({h}, 1.7e0)) + 0.0694e0 * sqrt(w) * (1e0 - pow({h}, 8e0))) * 0.581e0 * exp(0.0365e0 * t)")
    return f"""
days AS ({source}),
seq AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS rn FROM days),
codes AS (
 SELECT {keys}, cast(0 AS bigint) AS rn, cast(NULL AS date) AS date, cast(NULL AS double) AS sfcwind, 85e0 AS ffmc, 6e0 AS dmc, 15e0 AS dc
 FROM (SELECT DISTINCT {keys} FROM days) k
 UNION ALL
 SELECT {keys}, rn, date, w AS sfcwind,
  least(greatest(59.5e0 * (250e0 - m3) / (147.2e0 + m3), 0e0), 101e0) AS ffmc,
  CASE WHEN r > 1.5e0 THEN greatest(244.72e0 - 43.43e0 * ln(greatest(wet - 20e0, 1e-9)), 0e0) ELSE p0 END
    + 1.894e0 * (greatest(t, -1.1e0) + 1.1e0) * (100e0 - least(h, 100e0)) * len * 1e-4 AS dmc,
  CASE WHEN r > 2.8e0 THEN greatest(400e0 * ln(800e0 / greatest(800e0 * exp(-d0 / 400e0) + 3.937e0 * (0.83e0 * r - 1.27e0), 1e-9)), 0e0) ELSE d0 END
    + 0.5e0 * greatest(0.36e0 * (greatest(t, -2.8e0) + 2.8e0) + dry, 0e0) AS dc
 FROM (SELECT *, CASE WHEN m1 > ed THEN ed + (m1 - ed) * pow(10e0, -({rate.format(h='(least(h, 100e0) / 100e0)')}))
                     WHEN m1 < ew THEN ew - (ew - m1) * pow(10e0, -({rate.format(h='((100e0 - least(h, 100e0)) / 100e0)')})) ELSE m1 END AS m3,
        20e0 + exp(5.6348e0 - p0 / 43.43e0) + 1000e0 * (0.92e0 * r - 1.27e0) / (48.77e0 + slope * (0.92e0 * r - 1.27e0)) AS wet
  FROM (SELECT *, CASE WHEN r > 0.5e0 THEN least(m0 + 42.5e0 * (r - 0.5e0) * exp(-100e0 / (251e0 - m0)) * (1e0 - exp(-6.93e0 / (r - 0.5e0)))
              + CASE WHEN m0 > 150e0 THEN 0.0015e0 * pow(m0 - 150e0, 2) * sqrt(r - 0.5e0) ELSE 0e0 END, 250e0) ELSE m0 END AS m1,
         0.942e0 * pow(least(h, 100e0), 0.679e0) + 11e0 * exp((least(h, 100e0) - 100e0) / 10e0) + 0.18e0 * (21.1e0 - t) * (1e0 - exp(-0.115e0 * least(h, 100e0))) AS ed,
         0.618e0 * pow(least(h, 100e0), 0.753e0) + 10e0 * exp((least(h, 100e0) - 100e0) / 10e0) + 0.18e0 * (21.1e0 - t) * (1e0 - exp(-0.115e0 * least(h, 100e0))) AS ew,
         CASE WHEN p0 <= 33e0 THEN 100e0 / (0.5e0 + 0.3e0 * p0) WHEN p0 <= 65e0 THEN 14e0 - 1.3e0 * ln(p0) ELSE 6.2e0 * ln(p0) - 17.2e0 END AS slope
   FROM (SELECT {d_keys}, d.rn, d.date, d.tasmax AS t, d.pr AS r, d.hurs AS h, d.sfcwind AS w,
           147.2e0 * (101e0 - {fresh('ffmc', '85e0')}) / (59.5e0 + {fresh('ffmc', '85e0')}) AS m0, greatest({fresh('dmc', '6e0')}, 0e0) AS p0, greatest({fresh('dc', '15e0')}, 0e0) AS d0,
           CASE WHEN d.lat < 30e0 THEN {_listed(DAY_LENGTHS['north_near'])} ELSE {_listed(DAY_LENGTHS['north_far'])} END[month(d.date)] AS len,
           {_listed(DRYING['north'])}[month(d.date)] AS dry
         FROM codes s JOIN seq d ON {on} AND d.rn = s.rn + 1) a) b) c)
"""
