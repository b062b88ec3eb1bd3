"""Coordinate reference systems from WKT or EPSG codes, and shifts between them as column expressions.

A system is an ellipsoid, a shift of its datum to WGS 84, a prime meridian, and a projection. Methods follow the formulas
of EPSG Guidance Note 7-2: transverse Mercator (Krüger series), Lambert conformal conic with one or two parallels,
Mercator by a scale or a parallel, web Mercator, and Albers equal-area. Everything stays in built-in functions, so a layer
or a grid of any size is moved without a Python worker.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the projections in WKT, without case, spaces and underscores, and what they are here.
METHODS = {
    "transversemercator": "tm", "gausskruger": "tm", "lambertconformalconic": "lcc", "lambertconformalconic1sp": "lcc", "lambertconformalconic2sp": "lcc", "mercator": "mercator", "mercator1sp": "mercator",
    "mercator2sp": "mercator", "mercatorauxiliarysphere": "web", "popularvisualisationpseudomercator": "web", "albers": "albers", "albersconicequalarea": "albers", "albersequalarea": "albers",
}
#: Semi-major axis and inverse flattening of the ellipsoids of common EPSG codes.
WGS84, CGCS2000 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)
#: Seconds of arc and parts in a million.
ARC, PPM = math.pi / 648_000, 1e-6


@dataclass(frozen=True)
class System:
    """``shift``: metres, seconds of arc and parts in a million to WGS 84 (position vector rotation), None where the file
    names none; ``unit``: metres of a plane coordinate, or degrees of an angle."""

    name: str
    axis: float = WGS84[0]
    flattening: float = WGS84[1]
    method: str = "degrees"
    values: dict = field(default_factory=dict, hash=False, compare=True)
    unit: float = 1.0
    meridian: float = 0.0
    shift: tuple | None = None

    @property
    def e2(self) -> float:
        f = 1 / self.flattening if self.flattening else 0.0
        return f * (2 - f)

    def value(self, name: str, default: float = 0.0) -> float:
        return float(self.values.get(name, default))


# -- reading ----------------------------------------------------------------------------------------------------------


def parse(text: str) -> list:
    """WKT as nested lists: a node is its keyword followed by its values and nodes."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_]\w*|[-+]?\d[\d.]*(?:[eE][-+]?\d+)?|[\[\](),]', text)
    stack: list[list] = [[]]
    for k, token in enumerate(tokens):
        if token in "[(":
            continue
        if token in "])":
            if len(stack) == 1:
                raise ValueError("brackets do not match")
            done = stack.pop()
            stack[-1].append(done)
        elif token[0] == '"':
            stack[-1].append(token[1:-1].replace('""', '"'))
        elif token[0].isalpha() and k + 1 < len(tokens) and tokens[k + 1] in ("[", "("):
            stack.append([token.upper()])
        elif token != ",":
            stack[-1].append(float(token) if re.match(r"[-+]?\d", token) else token)
    if len(stack) > 1 or not stack[0] or not isinstance(stack[0][0], list):
        raise ValueError("not a reference system")
    return stack[0][0]


def _find(node: list, name: str) -> list | None:
    """The first child of that keyword, of the node or of those below it."""
    for child in node:
        if isinstance(child, list):
            if child[0] == name:
                return child
            if found := _find(child, name):
                return found
    return None


def from_wkt(text: str) -> System:
    """The system of a WKT text (version 1, with the names that ESRI gives, too)."""
    root = parse(text)
    if root[0] not in ("PROJCS", "GEOGCS"):
        raise ValueError(f"{root[0]} is not a projected or geographic system")
    own = lambda name: next((c for c in root if isinstance(c, list) and c[0] == name), None)
    geographic = root if root[0] == "GEOGCS" else _find(root, "GEOGCS")
    if geographic is None or not (ball := _find(geographic, "SPHEROID")):
        raise ValueError("the system names no ellipsoid")
    datum = _find(geographic, "TOWGS84")
    angle = next((c for c in geographic if isinstance(c, list) and c[0] == "UNIT"), None)
    degrees = math.degrees(angle[2]) if angle else 1.0
    degrees = 1.0 if abs(degrees - 1) < 1e-9 else degrees  # the radians of a file are rounded
    zero = _find(geographic, "PRIMEM")
    base = {"axis": ball[2], "flattening": ball[3], "shift": tuple(float(v) for v in datum[1:8]) + (0.0,) * (8 - len(datum)) if datum else None, "meridian": zero[2] * degrees if zero else 0.0}
    if root[0] == "GEOGCS":
        return System(root[1], unit=degrees, **base)
    named = own("PROJECTION")[1]
    method = METHODS.get(re.sub(r"[\s_]|\(.*\)", "", named).lower())
    if method is None:
        raise ValueError(f"no projection {named}")
    unit = own("UNIT")
    values = {c[1].lower().replace(" ", "_"): c[2] for c in root if isinstance(c, list) and c[0] == "PARAMETER"}
    metres = unit[2] if unit else 1.0
    angles = {k: v * degrees for k, v in values.items() if k not in ("scale_factor", "false_easting", "false_northing")}
    return System(root[1], method=method, values=values | angles | {k: values[k] * metres for k in ("false_easting", "false_northing") if k in values}, unit=metres, **base)


def from_epsg(code: int) -> System:
    """Degrees on WGS 84 (4326) and CGCS 2000 (4490), UTM (326zz, 327zz), web Mercator (3857), and the zones of Gauss and
    Krüger on CGCS 2000: 6 degrees wide (4491 to 4512) and 3 degrees wide (4513 to 4554)."""
    kind, zone = divmod(code, 100)
    if code in (4326, 4490):
        return System(f"EPSG:{code}", *(WGS84 if code == 4326 else CGCS2000), shift=(0.0,) * 7)
    if kind in (326, 327) and 1 <= zone <= 60:
        values = {"central_meridian": 6.0 * zone - 183, "scale_factor": 0.9996, "false_easting": 500_000.0, "false_northing": 0.0 if kind == 326 else 10_000_000.0}
        return System(f"EPSG:{code}", method="tm", values=values, shift=(0.0,) * 7)
    if code == 3857:
        return System("EPSG:3857", method="web", shift=(0.0,) * 7)
    if 4491 <= code <= 4554:
        wide = 6 if code <= 4512 else 3
        # a run of codes has the zone's number in front of the eastings, the next run of the same zones has none
        first, numbered, number = (4491, True, 13) if code <= 4501 else (4502, False, 13) if code <= 4512 else (4513, True, 25) if code <= 4533 else (4534, False, 25)
        zone = number + code - first
        middle = 6.0 * zone - 3 if wide == 6 else 3.0 * zone
        return System(f"EPSG:{code}", *CGCS2000, method="tm", values={"central_meridian": middle, "scale_factor": 1.0, "false_easting": 500_000.0 + (zone * 1e6 if numbered else 0.0)}, shift=(0.0,) * 7)
    raise ValueError(f"no system for EPSG:{code}")


def system(given) -> System:
    """A system from a WKT text, an EPSG code (whole number or EPSG:code), the name albers, or itself."""
    if isinstance(given, System):
        return given
    text = str(given).strip()
    if text.lower() == "albers":
        return System("albers", method="albers", values={"central_meridian": 105.0, "latitude_of_origin": 0.0, "standard_parallel_1": 25.0, "standard_parallel_2": 47.0}, shift=(0.0,) * 7)
    code = re.fullmatch(r"(?:EPSG:)?(\d+)", text, re.I)
    return from_epsg(int(code.group(1))) if code else from_wkt(text)


# -- projections ------------------------------------------------------------------------------------------------------


def _atanh(v: Column) -> Column:
    return 0.5 * F.log((1 + v) / (1 - v))


def _isometric(s: System, phi, lib=F):
    """The isometric latitude; of a column, or of a number where ``lib`` is math."""
    e, sine = math.sqrt(s.e2), lib.sin(phi)
    atanh = _atanh if lib is F else math.atanh
    return atanh(sine) - e * atanh(e * sine)


def _third(s: System) -> float:
    """The third flattening, in whose powers the series run."""
    f = 1 / s.flattening if s.flattening else 0.0
    return f / (2 - f)


def _series(start: Column, terms: tuple) -> Column:
    out = start
    for j, term in enumerate(terms, 1):
        out = out + term * F.sin(2 * j * start)
    return out


def _latitude(s: System, conformal: Column) -> Column:
    """The latitude of a conformal one."""
    n = _third(s)
    return _series(conformal, (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630))


def _from_authalic(s: System, authalic: Column) -> Column:
    n = _third(s)
    return _series(authalic, (4 * n / 3 + 4 * n**2 / 45 - 16 * n**3 / 35 - 2582 * n**4 / 14175, 46 * n**2 / 45 + 152 * n**3 / 945 - 11966 * n**4 / 14175, 3044 * n**3 / 2835 + 3802 * n**4 / 14175, 6059 * n**4 / 4725))


def _radius(s: System, phi: float) -> float:
    """Of the parallel, in parts of the axis."""
    return math.cos(phi) / math.sqrt(1 - s.e2 * math.sin(phi) ** 2)


def _krueger(s: System) -> tuple[float, tuple, tuple]:
    n = _third(s)
    radius = s.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return radius, there, back


def _meridian(s: System, phi: float) -> float:
    """Length of the meridian from the equator, in metres."""
    radius, there, _ = _krueger(s)
    chi = math.asin(math.tanh(_isometric(s, phi, math))) if abs(phi) < math.pi / 2 else phi
    return radius * (chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(there, 1)))


def _conic(s: System) -> tuple[float, float, float, float]:
    """(n, factor, radius of the origin, scale) of a Lambert cone; the parallels are latitudes in degrees."""
    origin = math.radians(s.value("latitude_of_origin"))
    one = math.radians(s.value("standard_parallel_1", s.value("latitude_of_origin")))
    two = math.radians(s.value("standard_parallel_2", math.degrees(one)))
    n = math.sin(one) if abs(one - two) < 1e-12 else math.log(_radius(s, one) / _radius(s, two)) / (_isometric(s, two, math) - _isometric(s, one, math))
    factor = _radius(s, one) / n * math.exp(n * _isometric(s, one, math))
    return n, factor, factor * math.exp(-n * _isometric(s, origin, math)), s.value("scale_factor", 1.0)


def _q(s: System, sine, lib=F):
    """The authalic term of a latitude's sine."""
    if s.e2 == 0:
        return 2 * sine
    e, log = math.sqrt(s.e2), (F.log if lib is F else math.log)
    return (1 - s.e2) * (sine / (1 - s.e2 * sine * sine) - log((1 - e * sine) / (1 + e * sine)) / (2 * e))


def _authalic(s: System) -> tuple[float, float, float]:
    """(n, c, radius of the origin) of an Albers cone."""
    origin, one = math.sin(math.radians(s.value("latitude_of_origin", s.value("latitude_of_center")))), math.radians(s.value("standard_parallel_1"))
    two = math.radians(s.value("standard_parallel_2", math.degrees(one)))
    q0, q1, q2 = (_q(s, v, math) for v in (origin, math.sin(one), math.sin(two)))
    n = math.sin(one) if abs(one - two) < 1e-12 else (_radius(s, one) ** 2 - _radius(s, two) ** 2) / (q2 - q1)
    c = _radius(s, one) ** 2 + n * q1
    return n, c, math.sqrt(c - n * q0) / n


def _scale(s: System) -> float:
    """Of Mercator at the equator: given, or that which makes the parallel true."""
    return s.value("scale_factor", 1.0) * (_radius(s, math.radians(s.value("standard_parallel_1"))) if "standard_parallel_1" in s.values else 1.0)


def _middle(s: System) -> float:
    """The meridian where x is 0; some cones call it that of the centre."""
    return s.value("central_meridian", s.value("longitude_of_center"))


def _around(degrees: Column) -> Column:
    """Degrees from -180 to 180."""
    return F.when(F.abs(degrees) <= 180, degrees).otherwise(degrees - 360 * F.floor((degrees + 180) / 360))


def project(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Plane coordinates of degrees on the system's own datum and meridian, in its unit."""
    if s.method == "degrees":
        return lon / s.unit, lat / s.unit
    phi, turn = F.radians(lat), F.radians(_around(lon - _middle(s)))
    if s.method == "web":
        x, y = s.axis * turn, s.axis * F.log(F.tan(math.pi / 4 + phi / 2))
    elif s.method == "mercator":
        x, y = s.axis * _scale(s) * turn, s.axis * _scale(s) * _isometric(s, phi)
    elif s.method == "tm":
        radius, there, _ = _krueger(s)
        k = s.value("scale_factor", 1.0)
        t = F.sinh(_isometric(s, phi))
        up, side = F.atan2(t, F.cos(turn)), _atanh(F.sin(turn) / F.sqrt(1 + t * t))
        x, y = side, up
        for j, a in enumerate(there, 1):
            x = x + a * F.cos(2 * j * up) * F.sinh(2 * j * side)
            y = y + a * F.sin(2 * j * up) * F.cosh(2 * j * side)
        x, y = k * radius * x, k * (radius * y - _meridian(s, math.radians(s.value("latitude_of_origin"))))
    elif s.method == "lcc":
        n, factor, origin, k = _conic(s)
        r = factor * F.exp(-n * _isometric(s, phi))
        x, y = s.axis * k * r * F.sin(n * turn), s.axis * k * (origin - r * F.cos(n * turn))
    else:
        n, c, origin = _authalic(s)
        r = F.sqrt(c - n * _q(s, F.sin(phi))) / n
        x, y = s.axis * r * F.sin(n * turn), s.axis * (origin - r * F.cos(n * turn))
    return (x + s.value("false_easting")) / s.unit, (y + s.value("false_northing")) / s.unit


def degrees(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of plane coordinates, the inverse of :func:`project`."""
    if s.method == "degrees":
        return x * s.unit, y * s.unit
    x, y = x * s.unit - s.value("false_easting"), y * s.unit - s.value("false_northing")
    if s.method == "web":
        turn, phi = x / s.axis, 2 * F.atan(F.exp(y / s.axis)) - math.pi / 2
    elif s.method == "mercator":
        turn, phi = x / (s.axis * _scale(s)), _latitude(s, F.asin(F.tanh(y / (s.axis * _scale(s)))))
    elif s.method == "tm":
        radius, _, back = _krueger(s)
        k = s.value("scale_factor", 1.0)
        high, wide = (y / k + _meridian(s, math.radians(s.value("latitude_of_origin")))) / radius, x / (k * radius)
        up, side = high, wide
        for j, b in enumerate(back, 1):
            up = up - b * F.sin(2 * j * high) * F.cosh(2 * j * wide)
            side = side - b * F.cos(2 * j * high) * F.sinh(2 * j * wide)
        turn, phi = F.atan2(F.sinh(side), F.cos(up)), _latitude(s, F.asin(F.sin(up) / F.cosh(side)))
    elif s.method == "lcc":
        n, factor, origin, k = _conic(s)
        a, b = x / (s.axis * k), origin - y / (s.axis * k)
        sign = 1.0 if n > 0 else -1.0
        turn, phi = F.atan2(sign * a, sign * b) / n, _latitude(s, F.asin(F.tanh(-F.log(F.sqrt(a * a + b * b) / abs(factor)) / n)))
    else:
        n, c, origin = _authalic(s)
        a, b = x / s.axis, origin - y / s.axis
        sign = 1.0 if n > 0 else -1.0
        q, turn = (c - (a * a + b * b) * (n * n)) / n, F.atan2(sign * a, sign * b) / n
        phi = _from_authalic(s, F.asin(q / _q(s, 1.0, math)))
    return _around(F.degrees(turn) + _middle(s)), F.degrees(phi)


# -- datums -----------------------------------------------------------------------------------------------------------


def _moved(s: System, x: Column, y: Column, z: Column, back: bool) -> tuple[Column, ...]:
    """Geocentric metres to WGS 84 by the shift of a system, or back from it."""
    dx, dy, dz, rx, ry, rz, m = s.shift or (0.0,) * 7
    rx, ry, rz, k = rx * ARC, ry * ARC, rz * ARC, 1 + m * PPM
    if not back:
        return dx + k * (x - rz * y + ry * z), dy + k * (rz * x + y - rx * z), dz + k * (-ry * x + rx * y + z)
    x, y, z = (x - dx) / k, (y - dy) / k, (z - dz) / k
    size = 1 + rx * rx + ry * ry + rz * rz  # the exact inverse of the rotation's matrix
    return (
        ((1 + rx * rx) * x + (rz + rx * ry) * y + (rx * rz - ry) * z) / size,
        ((rx * ry - rz) * x + (1 + ry * ry) * y + (rx + ry * rz) * z) / size,
        ((ry + rx * rz) * x + (ry * rz - rx) * y + (1 + rz * rz) * z) / size,
    )


def _same_datum(one: System, two: System) -> bool:
    """Whether degrees need no shift: equal datums, or one that a file leaves open. Ellipsoids that differ by less than a
    millimetre (WGS 84, GRS 80, CGCS 2000) are one where no shift is named."""
    if one.shift is None or two.shift is None:
        return True
    close = abs(one.axis - two.axis) < 1e-3 and abs(one.flattening - two.flattening) < 1e-5
    return close and one.shift == two.shift


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _to_datum(one: System, two: System, lon: Column, lat: Column) -> Column:
    """struct(lon, lat) on the other datum; back from the centre by Bowring's formula."""

    def centred(v: Column) -> Column:
        phi, turn = F.radians(v["lat"]), F.radians(v["lon"])
        normal = one.axis / F.sqrt(1 - one.e2 * F.sin(phi) * F.sin(phi))
        at = normal * F.cos(phi) * F.cos(turn), normal * F.cos(phi) * F.sin(turn), normal * (1 - one.e2) * F.sin(phi)
        return F.struct(*(c.alias(k) for c, k in zip(_moved(one, *at, back=False), "xyz")))

    def around(v: Column) -> Column:
        x, y, z = _moved(two, v["x"], v["y"], v["z"], back=True)
        return F.struct(F.sqrt(x * x + y * y).alias("p"), F.atan2(y, x).alias("turn"), z.alias("z"))

    def level(v: Column) -> Column:
        minor = two.axis * math.sqrt(1 - two.e2)
        theta = F.atan2(v["z"] * two.axis, v["p"] * minor)
        phi = F.atan2(v["z"] + two.e2 / (1 - two.e2) * minor * F.pow(F.sin(theta), 3), v["p"] - two.e2 * two.axis * F.pow(F.cos(theta), 3))
        return F.struct(F.degrees(v["turn"]).alias("lon"), F.degrees(phi).alias("lat"))

    return _once(_once(_once(F.struct(lon.alias("lon"), lat.alias("lat")), centred), around), level)


def transform(source, target, x: Column, y: Column) -> tuple[Column, Column]:
    """Coordinates of one system in another one. A datum whose shift is not named is taken to be that of the other."""
    one, two = system(source), system(target)
    if one == two:
        return x, y
    lon, lat = degrees(one, x, y)
    if not _same_datum(one, two):
        moved = _to_datum(one, two, _around(lon + one.meridian), lat)
        there = lambda v: F.struct(*(c.alias(k) for c, k in zip(project(two, _around(v["lon"] - two.meridian), v["lat"]), "xy")))
        at = _once(moved, there)
        return at["x"], at["y"]
    return project(two, lon if one.meridian == two.meridian else _around(lon + (one.meridian - two.meridian)), lat)
