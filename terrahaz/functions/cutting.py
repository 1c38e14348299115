"""Cutting polygons along straight lines into their real pieces, on vertex arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrahaz.functions.geometry import PARTS_TYPE

Rings = list[np.ndarray]
"""A polygon: shell, then holes, each an array of vertices without the closing one."""


def turn_area(ring: np.ndarray) -> float:
    """Signed area, positive if the ring turns left."""
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def turned(rings: Rings) -> Rings:
    """Shell to the left, holes to the right, rings without area left out."""
    out = []
    for i, ring in enumerate(rings):
        ring = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
        area = turn_area(ring) if len(ring) > 2 else 0.0
        if area == 0.0:
            if i == 0:
                return []
            continue
        out.append(ring if (area > 0) == (i == 0) else ring[::-1])
    return out


def holds(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, 0)
    up = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(all="ignore"):
        at = (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((up & (point[0] < at)).sum() % 2)


def _chains(ring: np.ndarray, inside: np.ndarray, axis: int, at: float) -> Rings:
    """The stretches of a ring on the kept side, each from its crossing of the line to the next."""
    after, following = np.roll(inside, -1), np.roll(ring, -1, 0)
    with np.errstate(all="ignore"):
        t = (at - ring[:, axis]) / (following[:, axis] - ring[:, axis])
        cross = ring + np.where((inside != after)[:, None], t[:, None] * (following - ring), 0.0)
    cross[:, axis] = at
    n = len(ring)
    enter = np.flatnonzero(~inside & after)
    leave = np.flatnonzero(inside & ~after)
    ends = leave[np.searchsorted(leave, enter, "right") % len(leave)]
    return [np.concatenate([cross[i:i + 1], ring[np.arange(i + 1, j + 1 + (n if j <= i else 0)) % n], cross[j:j + 1]])
            for i, j in zip(enter.tolist(), ends.tolist())]


def half(rings: Rings, axis: int, at: float, low: bool) -> list[Rings]:
    """The pieces of a polygon on one side of the line ``axis`` = ``at``.

    On the line the inside of the polygon is a row of separate intervals, each between a
    place where the outline leaves the kept side and one where it comes back. Sorted along the line,
    the first leaving belongs to the first coming back, and so on; joining stretches
    that way closes every piece by itself, so the parts of a concave shape come apart.
    """
    whole, chains = [], []
    for ring in rings:
        inside = ring[:, axis] < at if low else ring[:, axis] >= at
        if inside.all():
            whole.append(ring)
        elif inside.any():
            chains += _chains(ring, inside, axis, at)
    pieces: list[Rings] = []
    if chains:
        comes = np.argsort([c[0, 1 - axis] for c in chains], kind="stable")
        leaves = np.argsort([c[-1, 1 - axis] for c in chains], kind="stable")
        onward = np.empty(len(chains), np.int64)
        onward[leaves] = comes
        open_ = np.ones(len(chains), bool)
        for start in range(len(chains)):
            ring, k = [], start
            while open_[k]:
                open_[k] = False
                ring.append(chains[k])
                k = int(onward[k])
            if ring:
                closed = np.concatenate(ring)
                closed = closed[(closed != np.roll(closed, 1, 0)).any(1)]
                if len(closed) > 2 and turn_area(closed) != 0.0:
                    pieces.append([closed])
        holes = whole
    else:
        pieces, holes = ([[whole[0]]] if whole else []), whole[1:]
    for hole in holes:
        if chains and turn_area(hole) > 0:  # an outline that does not meet the line although others do
            pieces.append([hole])
            continue
        owner = pieces if len(pieces) == 1 else [p for p in pieces if holds(p[0], hole[0])]
        if owner:
            owner[0].append(hole)
    return pieces


def size(rings: Rings) -> int:
    return sum(len(r) + 1 for r in rings)


def pieces(rings: Rings, limit: int) -> list[Rings]:
    """A polygon cut in the middle of its longer side, again and again, until no piece has more than ``limit`` vertices.

    Only what has no extent left to cut, more than ``limit`` vertices in one place, stays larger.
    """
    out, todo = [], [rings]
    while todo:
        one = todo.pop()
        if size(one) <= limit:
            out.append(one)
            continue
        low, high = one[0].min(0), one[0].max(0)
        axis = int(high[1] - low[1] > high[0] - low[0])
        at = float(low[axis] + (high[axis] - low[axis]) / 2)
        if not low[axis] < at < high[axis]:
            out.append(one)
            continue
        todo += half(one, axis, at, True) + half(one, axis, at, False)
    return out


def _offsets(counts: list[int]) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(np.array(counts, np.int64))).astype(np.int32))


def pieces_udf(limit: int):
    """Lists of geometries of one part each, from ``parts``; an empty list for an empty one."""
    @F.arrow_udf(f"array<{PARTS_TYPE}>")
    def cut(parts: pa.Array) -> pa.Array:
        vertices, lengths, rings, made = [], [], [], []
        for row in parts:
            found: list[Rings] = []
            for part in row.values or []:
                xy = [np.column_stack([ring.values.field(0).to_numpy(), ring.values.field(1).to_numpy()]) for ring in part.values]
                shape = turned(xy)
                found += pieces(shape, limit) if shape else []
            for one in found:
                closed = [np.concatenate([ring, ring[:1]]) for ring in one]
                vertices += closed
                lengths += [len(ring) for ring in closed]
                rings.append(len(closed))
            made.append(len(found))
        xy = np.concatenate(vertices) if vertices else np.zeros((0, 2))
        out = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
        for counts in (lengths, rings, [1] * len(rings), made):
            out = pa.ListArray.from_arrays(_offsets(counts), out)
        return out

    return cut
