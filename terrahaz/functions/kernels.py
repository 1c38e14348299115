"""Small numpy kernels for the few steps that column expressions cannot express.

Spark decides which rows meet (a block of cells, an Arrow batch); these functions
only do the arithmetic inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from terrahaz.functions.geometry import PARTS_TYPE

# ---------------------------------------------------------------- fire weather
# Published equations: Van Wagner (1987), Forestry Technical Report 35.

# Effective day length (h) per month by latitude band.
DAY_LENGTHS = {
    "south_far": (11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10.0, 11.2, 11.8),
    "south_near": (10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2),
    "equator": (9.0,) * 12,
    "north_near": (7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8),
    "north_far": (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0),
}
# Seasonal drying term of the drought code.
DRYING = {
    "north": (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6),
    "equator": (1.39,) * 12,
    "south": (6.4, 5.0, 2.4, 0.4, -1.6, -1.6, -1.6, -1.6, -1.6, 0.9, 3.8, 5.8),
}
# Start-up moisture codes.
START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}


def day_length(lat: np.ndarray, month: np.ndarray) -> np.ndarray:
    band = np.digitize(lat, [-30.0, -15.0, 15.0, 30.0])
    return np.array(list(DAY_LENGTHS.values()))[band, month - 1]


def drying_term(lat: np.ndarray, month: np.ndarray) -> np.ndarray:
    north, equator, south = (np.array(DRYING[k])[month - 1] for k in ("north", "equator", "south"))
    return np.where(lat > 15, north, np.where(lat < -15, south, equator))


def next_ffmc(code, temp, rain, humid, wind):
    humid = np.minimum(humid, 100.0)
    moist = 147.2 * (101.0 - code) / (59.5 + code)
    net = np.maximum(rain - 0.5, 1e-12)
    wet = moist + 42.5 * net * np.exp(-100.0 / (251.0 - moist)) * (1.0 - np.exp(-6.93 / net))
    wet = wet + np.where(moist > 150.0, 0.0015 * (moist - 150.0) ** 2 * np.sqrt(net), 0.0)
    moist = np.where(rain > 0.5, np.minimum(wet, 250.0), moist)
    shared = 0.18 * (21.1 - temp) * (1.0 - np.exp(-0.115 * humid))
    tail = np.exp((humid - 100.0) / 10.0)
    dry_level = 0.942 * humid**0.679 + 11.0 * tail + shared
    wet_level = 0.618 * humid**0.753 + 10.0 * tail + shared
    pace = 0.581 * np.exp(0.0365 * temp)

    def rate(h):
        return (0.424 * (1.0 - h**1.7) + 0.0694 * np.sqrt(wind) * (1.0 - h**8)) * pace

    dried = dry_level + (moist - dry_level) * 10.0 ** -rate(humid / 100.0)
    wetted = wet_level - (wet_level - moist) * 10.0 ** -rate((100.0 - humid) / 100.0)
    moist = np.where(moist > dry_level, dried, np.where(moist < wet_level, wetted, moist))
    return np.clip(59.5 * (250.0 - moist) / (147.2 + moist), 0.0, 101.0)


def next_dmc(code, temp, rain, humid, length):
    code = np.maximum(code, 0.0)
    net = 0.92 * rain - 1.27
    start = 20.0 + np.exp(5.6348 - code / 43.43)
    safe = np.maximum(code, 1e-9)
    slope = np.where(
        code <= 33.0, 100.0 / (0.5 + 0.3 * code),
        np.where(code <= 65.0, 14.0 - 1.3 * np.log(safe), 6.2 * np.log(safe) - 17.2),
    )
    wet = start + 1000.0 * net / (48.77 + slope * net)
    lowered = np.maximum(244.72 - 43.43 * np.log(np.maximum(wet - 20.0, 1e-9)), 0.0)
    base = np.where(rain > 1.5, lowered, code)
    drying = 1.894 * (np.maximum(temp, -1.1) + 1.1) * (100.0 - np.minimum(humid, 100.0)) * length * 1e-4
    return base + drying


def next_dc(code, temp, rain, drying):
    code = np.maximum(code, 0.0)
    net = 0.83 * rain - 1.27
    store = 800.0 * np.exp(-code / 400.0) + 3.937 * net
    lowered = np.maximum(400.0 * np.log(800.0 / np.maximum(store, 1e-9)), 0.0)
    base = np.where(rain > 2.8, lowered, code)
    demand = np.maximum(0.36 * (np.maximum(temp, -2.8) + 2.8) + drying, 0.0)
    return base + 0.5 * demand


def next_codes(state: np.ndarray, lat: np.ndarray, month: np.ndarray, t: np.ndarray, r: np.ndarray, h: np.ndarray, w: np.ndarray):
    """State after one day of many cells, and the day's codes (NaN, and no change of state, where an input is missing)."""
    ok = ~(np.isnan(t) | np.isnan(r) | np.isnan(h) | np.isnan(w))
    if not ok.any():
        return state, np.full(state.shape, np.nan)
    with np.errstate(all="ignore"):
        new = np.stack([
            next_ffmc(state[0], t, r, h, w),
            next_dmc(state[1], t, r, h, day_length(lat, month)),
            next_dc(state[2], t, r, drying_term(lat, month)),
        ])
    return np.where(ok, new, state), np.where(ok, new, np.nan)


class DayWalk:
    """The codes of many cells: the first day of every cell as one vector, then the second of every cell, and so on.

    Cells are known by a 64-bit key. A step holds the cells that have a further day, so work follows the rows
    and not the cells known, and there are as many steps as days of the cell that has most, however
    few cells have rows of the same date. State that is older than the end of the year before is
    not carried on: a cell that lacks a whole year starts anew. A cell keeps its state over shorter gaps.
    """

    def __init__(self):
        self.keys, self.lat = np.zeros(0, np.int64), np.zeros(0)
        self.codes, self.last = np.zeros((3, 0)), np.zeros(0, np.int64)

    def _places(self, keys: np.ndarray, lat: np.ndarray) -> np.ndarray:
        own, first, row = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        fresh = np.append(self.keys, 0)[at] != own
        fresh |= at == len(self.keys)
        if fresh.any():
            self.keys = np.insert(self.keys, at[fresh], own[fresh])
            self.lat = np.insert(self.lat, at[fresh], lat[first[fresh]])
            self.codes = np.insert(self.codes, at[fresh], np.array(list(START.values()))[:, None], axis=1)
            self.last = np.insert(self.last, at[fresh], NEVER)
            at = np.searchsorted(self.keys, own)
        places = at[row]
        if not np.array_equal(self.lat[places], lat, equal_nan=True):
            raise ValueError("two cells share a key")
        return places

    def _start(self, date: np.ndarray, places: np.ndarray, codes: np.ndarray) -> None:
        """Known codes at the end of a day, for cells that were not walked in that year themselves."""
        use = (_year(self.last[places]) < _year(date)) & ~np.isnan(codes).any(0)
        self.codes[:, places[use]], self.last[places[use]] = codes[:, use], date[use]

    def _day(self, date: np.ndarray, places: np.ndarray, lat: np.ndarray, weather: np.ndarray) -> np.ndarray:
        """One day's codes (NaN where an input is missing); of repeated rows of a cell the last one leaves its state."""
        old = _year(self.last[places]) < _year(date) - 1
        state = np.where(old, np.array(list(START.values()))[:, None], self.codes[:, places])
        month = date.astype("datetime64[D]").astype("datetime64[M]").astype(int) % 12 + 1
        after, out = next_codes(state, lat, month, *weather)
        self.codes[:, places], self.last[places] = after, date
        return out

    def walk(self, date: np.ndarray, keys: np.ndarray, lat: np.ndarray, weather: np.ndarray,
             known: np.ndarray | None = None, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes of rows that come by date, all rows of the last one among them.

        Rows marked in ``known`` are no days (their result is NaN): they hold ``codes`` at the end of their date and lie behind its days.
        """
        out = np.full((3, len(date)), np.nan)
        if not len(date):
            return out
        known = np.zeros(len(date), bool) if known is None else known
        places = self._places(keys, lat)
        order = np.argsort(places, kind="stable")
        p, d, k = places[order], date[order], known[order]
        begin = np.append(True, p[1:] != p[:-1])
        number = np.cumsum(begin | np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
        step = number - np.maximum.accumulate(np.where(begin, number, 0))
        order = order[np.argsort(step, kind="stable")]
        edges = np.cumsum(np.append(0, np.bincount(step))).tolist()
        for a, b in zip(edges, edges[1:]):
            rows = order[a:b]
            stored = rows[known[rows]]
            if len(stored):
                self._start(date[stored], places[stored], codes[:, stored])
                rows = rows[~known[rows]]
            if len(rows):
                out[:, rows] = self._day(date[rows], places[rows], lat[rows], weather[:, rows])
        return out


NEVER = -(10 ** 8)


def _year(days):
    """Calendar year of days since 1970."""
    return np.asarray(days, np.int64).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64)


WEATHER = ("tasmax", "pr", "hurs", "sfcwind")


def walk_days(batches: Iterator[pa.RecordBatch], walk: DayWalk, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Codes of rows that come sorted by date and kind; holds one batch and the last day before it.

    Rows of kind 0 are days and come out with the columns ``kept`` and their codes; rows of kind 1 hold known codes.
    """
    held = None

    def walked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All rows of ``table``, whose last day is complete."""
        def numbers(name: str) -> np.ndarray:
            return table.column(name).cast(pa.float64()).to_numpy()

        date = table.column("date").cast(pa.int32()).to_numpy().astype(np.int64)
        known = table.column("_kind").to_numpy() != 0
        out = walk.walk(date, table.column("_key").to_numpy(), numbers("lat"), np.stack([numbers(c) for c in WEATHER]),
                        known, np.stack([numbers(c) for c in START]))
        days = pa.array(~known)
        codes = [pa.array(v, mask=np.isnan(v)).filter(days) for v in out]
        rows = table.select(kept).filter(days)
        for name, column in zip(START, codes):
            rows = rows.append_column(name, column)
        yield from rows.to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        date = table.column("date").cast(pa.int32()).to_numpy()
        cut = int(np.searchsorted(date, date[-1]))
        if cut:
            yield from walked(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield from walked(held)


# ------------------------------------------------------------ drought quantile

def _gamma_ratio_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for a > 100 by the uniform expansion (DLMF 8.12), two terms."""
    mu = x / a - 1.0
    with np.errstate(all="ignore"):
        eta = np.sign(mu) * np.sqrt(np.maximum(2.0 * (mu - np.log1p(mu)), 0.0))
        c0 = np.where(np.abs(eta) < 0.02, -1.0 / 3.0 + eta / 12.0 - 2.0 * eta**2 / 135.0 + eta**3 / 864.0,
                      1.0 / mu - 1.0 / eta)
        c1 = np.where(np.abs(eta) < 0.02, -1.0 / 540.0 - eta / 288.0 + eta**2 / 378.0,
                      1.0 / eta**3 - 1.0 / mu**3 - 1.0 / mu**2 - 1.0 / (12.0 * mu))
        rest = np.exp(-0.5 * a * eta**2) / np.sqrt(2.0 * np.pi * a) * (c0 + c1 / a)
    return np.clip(1.0 - normal_cdf(-eta * np.sqrt(a)) - rest, 0.0, 1.0)


def lower_gamma_ratio(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x)."""
    from math import lgamma

    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    good = np.isfinite(a) & np.isfinite(x) & (a > 0)
    out[good & (x <= 0)] = 0.0
    large = good & (x > 0) & (a > 100)
    if large.any():
        out[large] = _gamma_ratio_large(a[large], x[large])
    todo = good & (x > 0) & (a <= 100)
    if not todo.any():
        return out
    aa, xx = a[todo], x[todo]
    scale = np.exp(aa * np.log(xx) - xx - np.array([lgamma(v) for v in aa]))
    by_series = xx < aa + 1.0
    # power series
    term = 1.0 / aa
    total = term.copy()
    k = aa.copy()
    for _ in range(3000):
        k = k + 1.0
        term = term * xx / k
        total = total + term
        if np.all((term < total * 1e-15) | ~by_series):
            break
    # continued fraction (modified Lentz)
    tiny = 1e-300
    b = xx + 1.0 - aa
    c = np.full_like(xx, 1.0 / tiny)
    dd = 1.0 / np.where(b == 0, tiny, b)
    h = dd.copy()
    for i in range(1, 3000):
        an = -i * (i - aa)
        b = b + 2.0
        dd = an * dd + b
        dd = 1.0 / np.where(np.abs(dd) < tiny, tiny, dd)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = dd * c
        h = h * step
        if np.all((np.abs(step - 1.0) < 1e-15) | by_series):
            break
    with np.errstate(all="ignore"):
        out[todo] = np.where(by_series, scale * total, 1.0 - scale * h)
    return np.clip(out, 0.0, 1.0)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    half = 0.5 * lower_gamma_ratio(np.full(np.shape(z), 0.5), np.asarray(z) ** 2 / 2.0)
    return np.where(np.asarray(z) < 0, 0.5 - half, 0.5 + half)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal by rational start and two Newton steps; 0 and 1 give -inf and inf."""
    p = np.asarray(p, float)
    q = np.clip(np.minimum(p, 1.0 - p), 1e-300, 0.5)
    t = np.sqrt(-2.0 * np.log(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (
        1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(2):
        density = np.exp(-z * z / 2.0) / np.sqrt(2.0 * np.pi)
        with np.errstate(all="ignore"):
            z = z + np.where(density > 1e-280, (normal_cdf(-z) - q) / density, 0.0)
    z = np.where(p < 0.5, -z, z)
    return np.where(np.isnan(p), np.nan, np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z)))


def pearson3_cdf(x, loc, scale, skew):
    with np.errstate(all="ignore"):
        z = (x - loc) / np.where(scale > 0, scale, np.nan)
        near_normal = np.abs(skew) < 1e-9
        beta = 2.0 / np.where(near_normal, 1.0, skew)
        alpha = beta * beta
        part = lower_gamma_ratio(alpha, beta * (z + beta))
        return np.where(near_normal, normal_cdf(z), np.where(skew > 0, part, 1.0 - part))


def standardise(x, p_zero, loc, scale, skew):
    """Pearson III probability with the zero / trace / limit rules, as a normal score."""
    with np.errstate(all="ignore"):
        limit = loc - 2.0 * scale / skew
        cdf = pearson3_cdf(x, loc, scale, skew)
        cdf = np.where((x < 0.0005) & (p_zero > 0), 0.0, cdf)
        cdf = np.where((x < 0.0005) & (p_zero <= 0), 0.0005, cdf)
        cdf = np.where((x <= limit) & (skew > 0), 0.0005, cdf)
        cdf = np.where((x >= limit) & (skew < 0), 0.9995, cdf)
    prob = np.clip(p_zero + (1.0 - p_zero) * cdf, 0.0, 1.0)
    return np.clip(normal_quantile(prob), -3.09, 3.09)


# ------------------------------------------------------------- simplification

def kept_vertices(xy: np.ndarray, offsets: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on all vertex lists of a batch at once: which vertices stay; first and last ones do.

    ``offsets`` are the borders of the lists in ``xy``. A round looks at every stretch that is still open
    in any list: its farthest vertex, if farther than ``tolerance``, stays and splits it.
    """
    keep = np.zeros(len(xy), bool)
    some = offsets[1:] > offsets[:-1]
    low, high = offsets[:-1][some], offsets[1:][some] - 1
    keep[low], keep[high] = True, True
    while True:
        inner = high - low > 1
        low, high = low[inner], high[inner]
        if not len(low):
            return keep
        sizes = high - low - 1
        first = np.cumsum(sizes) - sizes
        stretch = np.repeat(np.arange(len(low)), sizes)
        at = low[stretch] + 1 + np.arange(len(stretch)) - first[stretch]
        start, chord = xy[low], xy[high] - xy[low]
        length2 = (chord * chord).sum(1)
        away = xy[at] - start[stretch]
        t = np.divide((away * chord[stretch]).sum(1), length2[stretch], out=np.zeros(len(at)), where=length2[stretch] > 0).clip(0, 1)
        distance = np.hypot(*(away - t[:, None] * chord[stretch]).T)
        farthest = np.maximum.reduceat(distance, first)
        split = farthest > tolerance
        is_farthest = np.flatnonzero((distance == farthest[stretch]) & split[stretch])
        _, one = np.unique(stretch[is_farthest], return_index=True)
        middle = at[is_farthest[one]]
        keep[middle] = True
        low, high = np.concatenate([low[split], middle]), np.concatenate([middle, high[split]])


def simplified(parts: pa.Array, tolerance: float) -> pa.Array:
    """Geometries with every ring or line simplified; all vertices of the array are one flat one."""
    def borders(lists: pa.Array) -> np.ndarray:
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
        return np.append(0, np.cumsum(sizes)).astype(np.int64)

    def nested(offsets: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

    lists = parts.flatten()
    rings = lists.flatten() if len(lists) else pa.array([], lists.type.value_type)
    points = rings.flatten() if len(rings) else pa.array([], rings.type.value_type)
    xy = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) if len(points) else np.zeros((0, 2))
    keep = kept_vertices(xy, borders(rings), tolerance)
    kept = pa.StructArray.from_arrays([pa.array(xy[keep, 0]), pa.array(xy[keep, 1])], names=["x", "y"])
    return nested(borders(parts), nested(borders(lists), nested(np.append(0, np.cumsum(keep))[borders(rings)], kept)))


def simplify_udf(tolerance: float) -> Callable:
    @F.arrow_udf(PARTS_TYPE)
    def simplify(parts: pa.Array) -> pa.Array:
        return simplified(parts, tolerance)

    return simplify
