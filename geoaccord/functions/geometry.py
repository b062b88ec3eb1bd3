"""Polygon measures. A polygon is array<array<struct<x,y>>>: rings without a repeated last vertex, outer or hole.

Areas, lengths, centroids and hit tests are column expressions; overlay areas are numpy in a pandas UDF. A hole is a ring
that turns against its outer ring: :func:`geoaccord.functions.arrangement.cleaned` gives rings of any source these turns
and repairs rings that cross.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def _edges(ring: Column) -> Column:
    """(a, b) of each edge, the last vertex joined to the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(rings: Column, of) -> Column:
    return F.aggregate(F.flatten(F.transform(rings, _edges)), F.lit(0.0), lambda s, e: s + of(e["a"], e["b"]))


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(rings: Column) -> Column:
    return _total(rings, _cross) / 2


def area(rings: Column) -> Column:
    return F.abs(signed_area(rings))


def perimeter(rings: Column) -> Column:
    return _total(rings, lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))


def centroid(rings: Column) -> tuple[Column, Column]:
    six = 6 * signed_area(rings)
    return tuple(_total(rings, lambda a, b, k=k: (a[k] + b[k]) * _cross(a, b)) / six for k in ("x", "y"))


def bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = (F.flatten(rings)[k] for k in ("x", "y"))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd hit test: an odd number of edges lies to the right of the point."""
    crossings = _total(
        rings,
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1.0).otherwise(0.0),
    )
    return crossings % 2 == 1


def valid(rings: Column) -> Column:
    """Whether there is a ring, every ring has three vertices or more, and the area is not 0."""
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, lambda r: F.size(r) >= 3) & (area(rings) > 0), F.lit(False))


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(at(minx, miny), at(maxx, miny), at(maxx, maxy), at(minx, maxy)))


def l_shape(minx: Column, miny: Column, w: Column, h: Column) -> Column:
    """A rectangle without its upper right quarter."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(at(minx, miny), at(minx + w, miny), at(minx + w, miny + h / 2), at(minx + w / 2, miny + h / 2), at(minx + w / 2, miny + h), at(minx, miny + h)))


def polygon(parts: Column) -> Column:
    """Rings of a polygon that was read from a file: closing vertices and rings under three vertices go."""
    opened = F.transform(parts, lambda r: F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r))
    return F.filter(opened, lambda r: F.size(r) >= 3)


def decimate(ring: Column, most: int = 300) -> Column:
    """Every second vertex of a long ring, its last vertex kept."""
    thin = F.filter(ring, lambda v, i: (i % 2 == 0) | (i == F.size(ring) - 1))
    return F.when(F.size(ring) > most, thin).otherwise(ring)


def edge_arrays(rings: list) -> tuple:
    """Arrays (x1, y1, x2, y2) of the edges of rings of {x, y}."""
    ends = [(a["x"], a["y"], b["x"], b["y"]) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]
    return tuple(np.array(v, float) for v in zip(*ends)) if ends else (np.zeros(0),) * 4


def overlap_area(one: tuple, two: tuple) -> float:
    """Intersection area of two polygons, given as arrays (x1, y1, x2, y2) of their directed edges.

    A polygon is the signed sum of the areas under its edges, so the intersection is the signed sum, over pairs of
    edges, of the area under both: the integral of the lower one over the x that they share.
    """
    if not len(one[0]) or not len(two[0]):
        return 0.0
    ox, oy = float(one[0].min()), min(float(one[1].min()), float(two[1].min()))
    (a, b), total = (_upward(edges, ox, oy) for edges in (one, two)), 0.0
    step = max(1, (1 << 18) // len(b[0]))
    for k in range(0, len(a[0]), step):
        x1, y1, x2, y2, sign = (v[k : k + step, None] for v in a)
        u1, v1, u2, v2, turn = (v[None, :] for v in b)
        lo, hi = np.maximum(x1, u1), np.minimum(x2, u2)
        rows, columns = np.nonzero(hi > lo)
        lo, hi = lo[rows, columns], hi[rows, columns]
        at = lambda x, p, q, r, s: q + (s - q) * (x - p) / (r - p)
        e, f = [v[rows, 0] for v in (x1, y1, x2, y2)], [v[0, columns] for v in (u1, v1, u2, v2)]
        e_lo, e_hi, f_lo, f_hi = at(lo, *e), at(hi, *e), at(lo, *f), at(hi, *f)
        d_lo, d_hi = e_lo - f_lo, e_hi - f_hi
        size = np.abs(d_lo) + np.abs(d_hi)
        apart = np.where(d_lo * d_hi >= 0, size / 2, (d_lo**2 + d_hi**2) / (2 * np.where(size > 0, size, 1.0)))
        under = (hi - lo) * ((e_lo + e_hi + f_lo + f_hi) / 4 - apart / 2)
        total += float(np.sum(under * sign[rows, 0] * turn[0, columns]))
    return max(0.0, total * _turn(one) * _turn(two))


def _turn(edges: tuple) -> float:
    x1, y1, x2, y2 = edges
    return 1.0 if float(np.sum((x1 - x1[0]) * (y2 - y1[0]) - (x2 - x1[0]) * (y1 - y1[0]))) >= 0 else -1.0


def _upward(edges: tuple, ox: float, oy: float) -> tuple:
    """Edges from left to right over the origin, with 1 for those that ran to the left; upright ones are left out."""
    x1, y1, x2, y2 = edges
    some = x1 != x2
    x1, y1, x2, y2 = x1[some] - ox, y1[some] - oy, x2[some] - ox, y2[some] - oy
    left = x2 < x1
    pick = lambda p, q: np.where(left, q, p)
    return pick(x1, x2), pick(y1, y2), pick(x2, x1), pick(y2, y1), np.where(left, 1.0, -1.0)


def overlap(one, two) -> Column:
    """Intersection area of two polygon columns, null where one is null."""

    @F.pandas_udf("double")
    def areas(*sides: pd.Series) -> pd.Series:
        return pd.Series([None if v[0] is None or v[4] is None else overlap_area(v[:4], v[4:]) for v in zip(*sides)], dtype=float)

    columns = []
    for rings in (one, two):
        edges = F.flatten(F.transform(rings, _edges))
        columns += [edges[v][k] for v in "ab" for k in "xy"]
    return areas(*columns)
