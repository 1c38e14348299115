"""Polygon overlay on flat arrays: areas that pairs of polygons share.

A polygon is a list of five numbers per edge that is not vertical: x0, y0, x1, y1 from left
to right and a sign, so that the signed areas below the edges add up to the polygon.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1_000_000
"""Pairs of edges worked on at once."""


def _edges(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of all rows behind one another (columns x0, y0, x1, y1, s) and the row of each."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) // 5
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 5), np.repeat(np.arange(len(lists)), counts)


def _span(edges: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, row, edges[:, 0])
    np.maximum.at(high, row, edges[:, 2])
    return low, high


def _below(edges: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heights over ``base`` of each edge at two places."""
    x0, y0, x1, y1 = edges[:, 0], edges[:, 1], edges[:, 2], edges[:, 3]
    slope = (y1 - y0) / (x1 - x0)
    return y0 - base + slope * (low - x0), y0 - base + slope * (high - x0)


def _lower_area(e: np.ndarray, f: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Area over ``base`` below the lower of two edges between two places."""
    e0, e1 = _below(e, low, high, base)
    f0, f1 = _below(f, low, high, base)
    first, last = e0 - f0, e1 - f1
    plain = (np.minimum(e0, f0) + np.minimum(e1, f1)) / 2
    crossed = first * last < 0
    at = np.divide(first, first - last, out=np.zeros_like(first), where=crossed)
    middle = e0 + (e1 - e0) * at
    bent = (at * (np.minimum(e0, f0) + middle) + (1 - at) * (middle + np.minimum(e1, f1))) / 2
    return (high - low) * np.where(crossed, bent, plain)


def _in_slabs(edges: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, slabs: np.ndarray, first: np.ndarray):
    """Each edge once per slab it crosses, in the order of the slabs: (edge, slab)."""
    wide = (high - low)[row] / slabs[row]
    a = np.floor((np.maximum(edges[:, 0], low[row]) - low[row]) / wide).astype(np.int64)
    b = np.ceil((np.minimum(edges[:, 2], high[row]) - low[row]) / wide).astype(np.int64) - 1
    a = np.clip(a, 0, slabs[row] - 1)
    many = np.clip(b, a, slabs[row] - 1) - a + 1
    edge = np.repeat(np.arange(len(edges)), many)
    slab = first[row[edge]] + a[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many)
    order = np.argsort(slab, kind="stable")
    return edge[order], slab[order]


def shared_areas(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared area and own area of ``n`` pairs of polygons, both as (edges, row).

    The x-range a pair shares is cut into about as many slabs as its edges are long on average,
    edges meet those of the other polygon in their slab only, and each meeting adds
    the signed area below the lower edge within the slab. So work follows the edges and
    the pairs of edges that lie over one another, not the product of both numbers.
    """
    (own_edges, own_row), (other_edges, other_row) = own, other
    base = np.full(n, np.inf)
    np.minimum.at(base, own_row, np.minimum(own_edges[:, 1], own_edges[:, 3]))
    spans = [_span(*side, n) for side in (own, other)]
    low, high = np.maximum(spans[0][0], spans[1][0]), np.minimum(spans[0][1], spans[1][1])
    whole = np.bincount(own_row, own_edges[:, 4] * (own_edges[:, 2] - own_edges[:, 0])
                        * ((own_edges[:, 1] + own_edges[:, 3]) / 2 - base[own_row]), n)
    sides, length, count = [], np.zeros(n), np.zeros(n)
    for edges, row in (own, other):
        near = (edges[:, 2] > low[row]) & (edges[:, 0] < high[row])
        edges, row = edges[near], row[near]
        length += np.bincount(row, np.minimum(edges[:, 2], high[row]) - np.maximum(edges[:, 0], low[row]), n)
        count += np.bincount(row, minlength=n)
        sides.append((edges, row))
    met = (high > low) & (length > 0)
    slabs = np.ones(n, np.int64)
    slabs[met] = np.maximum(1, (count[met] * (high - low)[met] / length[met]).astype(np.int64))
    first = np.cumsum(slabs) - slabs
    (e_edges, e_row), (f_edges, f_row) = sides
    e, e_slab = _in_slabs(e_edges, e_row, low, high, slabs, first)
    f, f_slab = _in_slabs(f_edges, f_row, low, high, slabs, first)
    starts = np.searchsorted(f_slab, e_slab, "left")
    many = np.searchsorted(f_slab, e_slab, "right") - starts
    until = np.cumsum(many)
    shared, at = np.zeros(n), 0
    while at < len(e):
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + CHUNK, "right")))
        some, k = np.arange(at, to), many[at:to]
        mine = np.repeat(some, k)
        theirs = np.arange(len(mine)) - np.repeat(np.cumsum(k) - k, k) + starts[mine]
        a, b, row = e_edges[e[mine]], f_edges[f[theirs]], e_row[e[mine]]
        slab = e_slab[mine] - first[row]
        wide = (high - low)[row] / slabs[row]
        left = np.maximum(np.maximum(a[:, 0], b[:, 0]), low[row] + slab * wide)
        right = np.minimum(np.minimum(a[:, 2], b[:, 2]), np.where(slab == slabs[row] - 1, high[row], low[row] + (slab + 1) * wide))
        real = right > left
        a, b, row, left, right = a[real], b[real], row[real], left[real], right[real]
        shared += np.bincount(row, a[:, 4] * b[:, 4] * _lower_area(a, b, left, right, base[row]), n)
        at = to
    return shared, whole


def share_udf():
    """Share of the first polygon that the second covers, both as lists of edges; NULL where one has none."""
    @F.arrow_udf("double")
    def share(own: pa.Array, other: pa.Array) -> pa.Array:
        n = len(own)
        shared, whole = shared_areas(_edges(own), _edges(other), n)
        some = whole > 0
        return pa.array(np.clip(np.divide(shared, whole, out=np.zeros(n), where=some), 0, 1), mask=~some)

    return share.asNondeterministic()  # worked out once, not again in every filter on it


def box_edges(xmin: str, ymin: str, xmax: str, ymax: str) -> Column:
    """The edge list of a rectangle in (lon, sin lat): its upper side and, taken off, its lower one."""
    def side(y: str, sign: str) -> str:
        return f"{xmin}, sin(radians({y})), {xmax}, sin(radians({y})), {sign}"

    return F.expr(f"if({xmax} > {xmin}, array({side(ymax, '1D')}, {side(ymin, '-1D')}), cast(array() AS array<double>))")
