"""Projections against the worked examples of EPSG Guidance Note 7-2 and Snyder's, and back; files in other systems."""

import math

import pytest
from pyspark.sql import functions as F

from geoaccord.functions import crs, projection

FOOT = 0.30480060960121924


def wkt(projection, ball, unit=1.0, **values):
    given = ",".join(f'PARAMETER["{k}",{v}]' for k, v in values.items())
    return f'PROJCS["t",GEOGCS["g",DATUM["d",SPHEROID["b",{ball[0]},{ball[1]}]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["{projection}"],{given},UNIT["u",{unit}]]'


CLARKE, BESSEL, KRASSOVSKY, AIRY = (6378206.4, 294.978698213898), (6377397.155, 299.1528128), (6378245.0, 298.3), (6377563.396, 299.32496)
POINTS = [
    (wkt("Transverse_Mercator", AIRY, latitude_of_origin=49, central_meridian=-2, scale_factor=0.9996012717, false_easting=400000, false_northing=-100000), 0.5, 50.5, 577274.99, 69740.50, 0.01),
    (wkt("Lambert_Conformal_Conic_2SP", CLARKE, FOOT, latitude_of_origin=27 + 50 / 60, central_meridian=-99, standard_parallel_1=28 + 23 / 60, standard_parallel_2=30 + 17 / 60, false_easting=2000000, false_northing=0), -96, 28.5, 2963503.91, 254759.80, 0.01),
    (wkt("Lambert_Conformal_Conic_1SP", CLARKE, latitude_of_origin=18, central_meridian=-77, scale_factor=1, false_easting=250000, false_northing=150000), -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.8 / 3600, 255966.58, 142493.51, 0.01),
    (wkt("Mercator_1SP", BESSEL, central_meridian=110, scale_factor=0.997, false_easting=3900000, false_northing=900000), 120, -3, 5009726.58, 569150.82, 0.01),
    (wkt("Mercator_2SP", KRASSOVSKY, central_meridian=51, standard_parallel_1=42), 53, 53, 165704.29, 5171848.07, 0.01),
    (wkt("Albers_Conic_Equal_Area", CLARKE, latitude_of_center=23, longitude_of_center=-96, standard_parallel_1=29.5, standard_parallel_2=45.5), -75, 35, 1885472.7, 1535925.0, 0.1),
    ("EPSG:3857", -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, -11169055.58, 2800000.00, 0.01),
]


@pytest.mark.parametrize("given,lon,lat,x,y,near", POINTS)
def test_worked_examples(spark, given, lon, lat, x, y, near):
    s = crs.system(given)
    there = crs.project(s, F.col("lon"), F.col("lat"))
    found = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double").select(there[0].alias("x"), there[1].alias("y"))
    back = crs.degrees(s, F.col("x"), F.col("y"))
    row = found.select("x", "y", back[0].alias("lon"), back[1].alias("lat")).first()
    assert abs(row["x"] - x) <= near and abs(row["y"] - y) <= near
    assert row["lon"] == pytest.approx(lon, abs=1e-11) and row["lat"] == pytest.approx(lat, abs=1e-11)


def test_geocentric_shift(spark):
    """WGS 72 to WGS 84 of the Guidance Note, as metres and as degrees there and back."""
    old = crs.System("old", 6378135.0, 298.26, shift=(0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219))
    at = [F.lit(v) for v in (3657660.66, 255768.55, 5201382.11)]
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(crs._moved(old, *at, back=False), "xyz"))).first()
    assert tuple(row) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)
    turned = crs.System("turned", *BESSEL, shift=(598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7))
    there = crs.transform(turned, 4326, F.lit(13.4), F.lit(52.5))
    rows = spark.range(1).select(there[0].alias("x"), there[1].alias("y"))
    moved = rows.first()
    assert 0.0005 < abs(moved["x"] - 13.4) < 0.003 and 0.0005 < abs(moved["y"] - 52.5) < 0.003
    back = crs.transform(4326, turned, F.col("x"), F.col("y"))
    again = rows.select(back[0].alias("x"), back[1].alias("y")).first()
    assert again["x"] == pytest.approx(13.4, abs=1e-6) and again["y"] == pytest.approx(52.5, abs=1e-6)


def test_same_as_the_named_ones(spark):
    """UTM and Albers by the general formulas and by the ones of their own; zones of Gauss and Krüger."""
    rows = spark.createDataFrame([(114.2 + k / 7, 20.0 + k * 2) for k in range(15)], "lon double, lat double")
    for given, own in (("EPSG:32650", projection.utm(F.col("lon"), F.col("lat"), 50)), ("albers", projection.albers(F.col("lon"), F.col("lat")))):
        there = crs.transform(4326, given, F.col("lon"), F.col("lat"))
        worst = rows.select(F.max(F.abs(there[0] - own[0])).alias("x"), F.max(F.abs(there[1] - own[1])).alias("y")).first()
        assert worst["x"] < 1e-3 and worst["y"] < 1e-3
    zones = {4513: (75.0, 25_500_000.0), 4547: (114.0, 500_000.0), 4508: (111.0, 500_000.0), 4498: (117.0, 20_500_000.0)}
    assert {k: (s.value("central_meridian"), s.value("false_easting")) for k in zones for s in [crs.from_epsg(k)]} == zones


def test_texts():
    text = 'PROJCS["Xian_1980_GK_Zone_19",GEOGCS["x",DATUM["D_Xian",SPHEROID["Xian",6378140.0,298.257]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Gauss_Kruger"],PARAMETER["False_Easting",19500000.0],PARAMETER["Central_Meridian",111.0],PARAMETER["Scale_Factor",1.0],UNIT["Meter",1.0]]'
    s = crs.from_wkt(text)
    assert (s.method, s.axis, s.value("central_meridian"), s.value("false_easting"), s.shift) == ("tm", 6378140.0, 111.0, 19500000.0, None)
    assert crs.from_wkt('GEOGCS["g",DATUM["d",SPHEROID["b",6378137,298.257223563],TOWGS84[1,2,3]],PRIMEM["p",2.5],UNIT["grad",0.015707963267949]]').shift == (1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0)
    assert crs.from_wkt('GEOGCS["g",DATUM["d",SPHEROID["b",6378137,298.257223563]],PRIMEM["p",2.5],UNIT["grad",0.015707963267949]]').meridian == pytest.approx(2.25)
    for bad in ("", "PROJCS[", 'PROJCS["x"]', wkt("Bonne", CLARKE, central_meridian=0), 'LOCAL_CS["x"]', "EPSG:1"):
        with pytest.raises((ValueError, TypeError)):
            crs.system(bad)
    assert math.isclose(crs.from_wkt(wkt("Mercator", CLARKE, FOOT, false_easting=10)).value("false_easting"), 10 * FOOT)


def test_sides_in_one_system(spark, tmp_path):
    """Shapes in degrees of their own, beside a raster in metres, and a raster beside shapes in degrees."""
    import numpy as np

    from geoaccord.plans import compare
    from geoaccord.sources import sinks, tiff

    square = lambda x, y, s: [[{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]]
    rows = spark.createDataFrame([(square(117.0 + k / 100, 29.9, 0.005), "abc"[k]) for k in range(3)], "rings array<array<struct<x:double,y:double>>>, kind string")
    degrees = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    sinks.write_shapefile(rows, f"{tmp_path}/s.shp", ["kind"], projection=degrees)
    (tmp_path / "r.tif").write_bytes(tiff.encode(np.arange(200.0).reshape(10, 20), (500_000.0, 3_310_000.0), (100.0, 200.0), 32650))
    shapes, cells = {"path": f"{tmp_path}/s.shp", "field": "kind"}, {"path": f"{tmp_path}/r.tif"}
    raster_first = compare.sides(spark, cells, shapes)
    low = projection.utm(F.lit(117.0), F.lit(29.9), 50)
    corner = spark.range(1).select(low[0].alias("x"), low[1].alias("y")).first()
    assert raster_first[1].bounds[0] == pytest.approx(corner["x"], abs=0.01) and raster_first[1].bounds[1] == pytest.approx(corner["y"], abs=0.01)
    shapes_first = compare.sides(spark, shapes, cells)
    assert shapes_first[0].bounds == (117.0, 29.9, pytest.approx(117.025), pytest.approx(29.905)) and shapes_first[1].bounds[0] == pytest.approx(117.0, abs=1e-6)
    seen = shapes_first[1].rows.agg(F.count("*").alias("n"), F.sum((F.col("alpha") > 0).cast("int")).alias("shown")).first()
    assert seen["n"] == 200 and seen["shown"] > 150
