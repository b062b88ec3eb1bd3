"""Map projections of WGS 84 and back as column expressions: Albers equal-area conic (Snyder 1987) and UTM (Krüger series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, INVERSE_FLATTENING = 6378137.0, 298.257223563
FLAT = 1 / INVERSE_FLATTENING
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)


def _q_number(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def _m_number(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def albers(lon: Column, lat: Column, lon0: float = 105.0, lat0: float = 0.0, lat1: float = 25.0, lat2: float = 47.0) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    m1, m2, q0, q1, q2 = _m_number(p1), _m_number(p2), _q_number(p0), _q_number(p1), _q_number(p2)
    n = (m1 * m1 - m2 * m2) / (q2 - q1) if p1 != p2 else math.sin(p1)
    c = m1 * m1 + n * q1
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    rho, rho0 = A * F.sqrt(c - n * q) / n, A * math.sqrt(c - n * q0) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres, by the third-order Krüger series."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, dl = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    k = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(s) - k * atanh(k * s))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north_part = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north_part = north_part + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * east, (0.0 if north else 10_000_000.0) + 0.9996 * radius * north_part


def albers_degrees(x: Column, y: Column, lon0: float = 105.0, lat0: float = 0.0, lat1: float = 25.0, lat2: float = 47.0) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing of :func:`albers`, by the series of the authalic latitude."""
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    m1, m2, q0, q1, q2 = _m_number(p1), _m_number(p2), _q_number(p0), _q_number(p1), _q_number(p2)
    n = (m1 * m1 - m2 * m2) / (q2 - q1) if p1 != p2 else math.sin(p1)
    c = m1 * m1 + n * q1
    up = A * math.sqrt(c - n * q0) / n - y
    beta = F.asin((c - (x * x + up * up) * (n * n / (A * A))) / (n * _q_number(math.pi / 2)))
    series = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
    phi = beta
    for j, k in enumerate(series, 1):
        phi = phi + k * F.sin(2 * j * beta)
    return lon0 + F.degrees(F.atan2(x, up) / n), F.degrees(phi)


def utm_degrees(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing of :func:`utm`."""
    n = FLAT / (2 - FLAT)
    radius = 0.9996 * A / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n * n / 3 + 37 * n**3 / 96, n * n / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n * n / 3 - 2 * n**3, 7 * n * n / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - (0.0 if north else 10_000_000.0)) / radius, (x - 500_000) / radius
    up, side = xi, eta
    for j, b in enumerate(beta, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        side = side - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(side))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return 6 * zone - 183 + F.degrees(F.atan2(F.sinh(side), F.cos(up))), F.degrees(phi)


def plane_of(epsg: int, degrees: bool = False):
    """The function (x, y) -> (x, y) from degrees to the plane of an EPSG code, or back; degrees stay as they are."""
    if epsg == 4326:
        return lambda x, y: (x, y)
    zone = zone_of(epsg)
    if zone is None:
        raise ValueError(f"no projection for EPSG:{epsg}")
    return lambda x, y: (utm_degrees if degrees else utm)(x, y, *zone)


def zone_of(epsg: int) -> tuple[int, bool] | None:
    """UTM zone and hemisphere of an EPSG code 326zz or 327zz."""
    kind, zone = divmod(epsg, 100)
    return (zone, kind == 326) if kind in (326, 327) and 1 <= zone <= 60 else None
