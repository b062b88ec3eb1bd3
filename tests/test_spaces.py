"""Distances of the plane and the globe against plain Python, at seams, poles and antipodes."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from geoaccord.functions.spaces import Space
from geoaccord.operators import weighted

PLACES = [(180.0, 0.0), (-180.0, 0.0), (179.9, 0.05), (-179.95, -0.02), (0.0, 90.0), (77.0, 90.0), (10.0, 89.9), (-170.0, 89.9), (0.0, 0.0), (2.337222222, 48.836388889), (-77.065555556, 38.921388889), (30.0, -89.95), (210.0, -89.97)]


def haversine(a, b):
    (x1, y1), (x2, y2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y1 - y2) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x1 - x2) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def places(spark, rows):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(rows)], "feature_id long, px double, py double")


def test_paris_to_washington(spark):
    """The worked example of the book that gives the formula: 6181.63 km (on the ellipsoid of 1976)."""
    d = spark.range(1).select(Space(globe="ellipsoid").distance(*map(F.lit, (*PLACES[9], *PLACES[10])))).first()[0]
    assert abs(d - 6181.63) < 0.02


@pytest.mark.parametrize("globe, radius", [("sphere", 15.0), ("sphere", 7000.0), ("sphere", 25_000.0), ("ellipsoid", 15.0)])
def test_neighbours_on_a_globe(spark, globe, radius):
    got = {(r["i"], r["j"]): r["d"] for r in weighted.neighbours(places(spark, PLACES), radius, [], space=Space(globe=globe)).collect()}
    want = {(i, j): d for (i, a), (j, b) in itertools.product(enumerate(PLACES), repeat=2) if (d := haversine(a, b)) <= radius}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= (1e-5 if globe == "sphere" else 0.01 * radius) for k in want)


def test_antipodes_and_nulls(spark):
    for globe in ("sphere", "ellipsoid"):
        row = spark.sql("select 0D as a, 90D as b, -90D as c, cast(null as double) as n, 180D as h").select(*(Space(globe=globe).distance(*(F.col(x) for x in xs)) for xs in ("abac", "aaha", "anab", "abhb"))).first()
        assert abs(row[0] - 20_015) < 25 and abs(row[1] - 20_026) < 15 and row[2] is None and row[3] < 1e-6


@pytest.mark.parametrize("p, theta", [(1.0, 0.7), (2.0, 0.3), (3.0, -1.0), (math.inf, 0.4), (math.inf, 0.0)])
def test_neighbours_in_a_turned_plane(spark, p, theta):
    rows = [(k * 37 % 101 - 50.0, k * 53 % 97 - 40.0) for k in range(80)]

    def distance(a, b):
        x, y = a[0] - b[0], a[1] - b[1]
        u, v = abs(x * math.cos(theta) - y * math.sin(theta)), abs(x * math.sin(theta) + y * math.cos(theta))
        return max(u, v) if math.isinf(p) else (u**p + v**p) ** (1 / p)

    got = {(r["i"], r["j"]): r["d"] for r in weighted.neighbours(places(spark, rows), 20.2, [], space=Space(p, theta)).collect()}
    want = {(i, j): d for (i, a), (j, b) in itertools.product(enumerate(rows), repeat=2) if (d := distance(a, b)) <= 20.2}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_nearest_on_a_globe(spark):
    for k in (2, 5, len(PLACES)):
        got = {r["i"]: r["b"] for r in weighted.nearest_distances(places(spark, PLACES), k, 10.0, Space(globe="sphere")).collect()}
        assert all(abs(got[i] - sorted(haversine(a, b) for b in PLACES)[k - 1]) < 1e-5 for i, a in enumerate(PLACES))


def test_wrong_spaces_raise():
    for wrong in ({"p": 0.5}, {"p": math.nan}, {"globe": "disc"}):
        with pytest.raises(ValueError):
            Space(**wrong)
