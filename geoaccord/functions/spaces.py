"""Distances between points, each with the cells in which points within a radius are found.

In the plane a distance is a Minkowski one of any power (2 by default, ``inf`` for the greatest difference), along axes that
may be turned. On the globe it is the great circle between degrees of longitude and latitude, in kilometres: on the WGS 84
ellipsoid by the formula of Andoyer and Lambert (Meeus, Astronomical Algorithms), or on a sphere. Cells of the globe are cubes
around unit vectors, so there is no seam at 180 degrees and no crowd of cells at a pole.

Cases: equal points are at distance 0; antipodes at half a circle of the equator; a null coordinate gives a null distance;
latitudes beyond 90 degrees are taken as angles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equator and flattening of WGS 84, the mean radius of the sphere; kilometres.
EQUATOR, FLATTENING, SPHERE = 6378.137, 1 / 298.257223563, 6371.0088
#: Kilometres of a radian of arc at the least, on the ellipsoid (6335 at the equator, northwards) or the sphere.
LEAST_RADIUS = 6300.0


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ellipsoid: bool = True) -> Column:
    """Kilometres between two places in degrees."""
    rad = F.radians
    f, g, l = rad((lat1 + lat2) / 2), rad((lat1 - lat2) / 2), rad((lon1 - lon2) / 2)  # noqa: E741
    sq = lambda x: x * x
    if not ellipsoid:
        part = sq(F.sin(g)) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * sq(F.sin(l))
        return 2 * SPHERE * F.when(part >= 1, math.pi / 2).otherwise(F.asin(F.sqrt(part)))
    s = sq(F.sin(g)) * sq(F.cos(l)) + sq(F.cos(f)) * sq(F.sin(l))
    c = sq(F.cos(g)) * sq(F.cos(l)) + sq(F.sin(f)) * sq(F.sin(l))
    half = F.atan2(F.sqrt(s), F.sqrt(c))
    third = 3 * F.sqrt(s * c) / half
    flat = FLATTENING * ((third - 1) / (2 * c) * sq(F.sin(f)) * sq(F.cos(g)) - (third + 1) / (2 * s) * sq(F.cos(f)) * sq(F.sin(g)))
    # Near antipodes the formula does not hold; the arc itself is taken there.
    return F.when(s == 0, 0.0 * s).when(c < 1e-9, 2 * half * EQUATOR).otherwise(2 * half * EQUATOR * (1 + flat))


@dataclass(frozen=True)
class Space:
    """Power ``p`` and turn ``theta`` (radians, counter-clockwise) of distances in the plane, or the globe: "" (the plane),
    "ellipsoid" or "sphere"."""

    p: float = 2.0
    theta: float = 0.0
    globe: str = ""

    def __post_init__(self):
        if not self.p >= 1 or self.globe not in ("", "ellipsoid", "sphere"):
            raise ValueError("a power of 1 or more, and a globe that is an ellipsoid or a sphere, are needed")

    def axes(self, x: Column, y: Column) -> list[Column]:
        """Coordinates that differ by at most :meth:`side` between points within a radius."""
        if self.globe:
            lon, lat = F.radians(x), F.radians(y)
            return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
        if self.theta:
            cos, sin = math.cos(self.theta), math.sin(self.theta)
            return [x * cos - y * sin, x * sin + y * cos]
        return [x, y]

    def side(self, radius: float) -> float:
        return 2 * math.sin(min(radius / LEAST_RADIUS, math.pi) / 2) * (1 + 1e-12) if self.globe else radius

    def distance(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        if self.globe:
            return great_circle(x1, y1, x2, y2, self.globe == "ellipsoid")
        dx, dy = (a - b for a, b in zip(self.axes(x1, y1), self.axes(x2, y2)))
        if self.p == 2:
            return F.sqrt(dx * dx + dy * dy)
        if math.isinf(self.p):
            return F.when(F.abs(dx) >= F.abs(dy), F.abs(dx)).when(F.abs(dx) < F.abs(dy), F.abs(dy))
        return F.pow(F.pow(F.abs(dx), self.p) + F.pow(F.abs(dy), self.p), 1 / self.p)

    def reach(self, width: float, height: float) -> float:
        """A distance that no two points in a box of this size exceed."""
        return math.pi * EQUATOR * 1.01 if self.globe else math.hypot(width, height) * 2 ** (1 / self.p) * (1 + 1e-7)


#: The Euclidean plane.
PLANE = Space()
