"""Repair and overlays of polygons against counts of grid points, and layers as files hold them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaccord.functions import arrangement, fields
from geoaccord.operators import classify, layers
from geoaccord.scratch import scratch_path
from geoaccord.sources import readers, sinks

SQUARE, HOLE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (4, 2), (4, 4), (2, 4)]


def area(rings):
    return sum(arrangement._turn(np.array(r, float)) for r in rings) / 2


def counted(rings, n=200):
    """Area by the points of a grid that lie inside under the even-odd rule, and that of a cell."""
    points = np.concatenate(rings)
    low, high = points.min(0), points.max(0)
    x, y = np.meshgrid(*(low[k] + (np.arange(n) + 0.5) * (high[k] - low[k]) / n for k in (0, 1)))
    hits = np.zeros(x.shape, bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
            if y1 != y2:
                hits ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hits.mean() * (high - low).prod()


@pytest.mark.parametrize(
    "rings,state,size,parts",
    [
        ([SQUARE], "ok", 100, None), ([SQUARE[::-1]], "ok", 100, 1), ([SQUARE, HOLE], "ok", 96, 2), ([SQUARE, HOLE[::-1]], "ok", 96, None),
        ([[(0, 0), (10, 10), (10, 0), (0, 10)]], "repaired", 50, 2), ([SQUARE, [(20, 0), (20, 5), (30, 5), (30, 0)]], "ok", 150, 2),
        ([SQUARE, [(5, 5), (15, 5), (15, 15), (5, 15)]], "repaired", 150, 2), ([[(0, 0), (10, 0), (10, 10), (10, 15), (10, 10), (0, 10)]], "repaired", 100, 1),
        ([SQUARE, [(10, 2), (20, 2), (20, 8), (10, 8)]], "repaired", 160, 1), ([SQUARE, [(10, 5), (14, 2), (14, 8)]], "ok", 112, None), ([SQUARE, [(0, 5), (3, 3), (3, 7)]], "ok", 94, 2),
        ([[(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)]], "repaired", 50, 2), ([SQUARE, HOLE, [(2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 3.5)]], "ok", 97, 3),
        ([SQUARE, SQUARE], "invalid", 0, None), ([[(0, 0), (5, 5), (10, 10)]], "invalid", 0, None), ([[(0, 0), (float("nan"), 5), (10, 0)]], "invalid", 0, None), ([[(1, 1)] * 4], "invalid", 0, None),
    ],
)
def test_shapes_of_files(rings, state, size, parts):
    given = [np.array(r, float) for r in rings]
    found, made = arrangement.clean(given)
    assert found == state and (None if made is None else len(made)) == parts
    if state != "invalid":
        assert area(made if made is not None else given) == pytest.approx(size, abs=1e-6)


def test_random_shapes():
    """Random rings, some on whole numbers with many meetings in a point: areas by counting; repair changes nothing twice."""
    rng = np.random.default_rng(3)
    for k in range(120):
        make = lambda n: rng.integers(0, 8, (n, 2)).astype(float) if k % 2 else rng.random((n, 2)) * 8
        given = [make(rng.integers(3, 9)) for _ in range(rng.integers(1, 4))]
        state, made = arrangement.clean(given)
        one = [] if state == "invalid" else [np.array(r) for r in made or given]
        assert area(one) == pytest.approx(counted(given), abs=0.6 + 0.02 * abs(area(one)))
        if one:
            again = arrangement.clean(one)
            assert again[0] == "ok" or k % 2 == 0 or area(again[1] or one) == pytest.approx(area(one), abs=1e-6)
        other = arrangement.clean([rng.random((5, 2)) * 8])
        two = [np.array(r) for r in other[1]] if other[1] else []
        both, either, first = (area(arrangement.overlay(one, two, f)) for f in (lambda s: s[:, 0] & s[:, 1], lambda s: s[:, 0] | s[:, 1], lambda s: s[:, 0] & ~s[:, 1]))
        assert both + either == pytest.approx(area(one) + area(two), abs=1e-5) and first + both == pytest.approx(area(one), abs=1e-5)
        if one and two:
            assert both == pytest.approx((counted([*one]) + counted([*two]) - counted_union(one, two)), abs=1.5)


def counted_union(one, two, n=200):
    points = np.concatenate([*one, *two])
    low, high = points.min(0), points.max(0)
    x, y = np.meshgrid(*(low[k] + (np.arange(n) + 0.5) * (high[k] - low[k]) / n for k in (0, 1)))
    inside = np.zeros(x.shape, bool)
    for rings in (one, two):
        hits = np.zeros(x.shape, bool)
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
                if y1 != y2:
                    hits ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside |= hits
    return inside.mean() * (high - low).prod()


def test_batches_tell_the_doubtful_ones():
    """What a batch calls fine is fine one by one, and single rings that it doubts are wrong."""
    rng = np.random.default_rng(4)
    polygons = [[rng.integers(0, 6, (rng.integers(3, 7), 2)).astype(float) for _ in range(1 + (k % 5 == 0))] for k in range(300)]
    lengths = [len(r) for p in polygons for r in p]
    numbers = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(polygons)), [sum(map(len, p)) for p in polygons])
    doubt, right = arrangement._doubtful(np.concatenate([r for p in polygons for r in p]), *numbers)
    for k, rings in enumerate(polygons):
        state, made = arrangement.clean(rings)
        if len(rings) == 1:
            assert (state != "ok") == doubt[k] and (doubt[k] or (made is not None) == right[k])
        else:
            assert doubt[k]


def test_many_vertices():
    turn = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = np.stack([np.cos(turn), np.sin(turn)], 1) * (100 + 10 * np.sin(40 * turn))[:, None]
    assert arrangement.clean([ring]) == ("ok", None)
    state, made = arrangement.clean([ring[np.r_[0:1500, 2000:1499:-1, 2001:4000]]])
    assert state == "repaired" and 0 < area(made) < area([ring])


def test_geojson_of_several_parts(spark):
    """MultiPolygons, holes of either turn, shapes without area and missing ones, from a file to measures."""
    closed = lambda ring, x=0: [[a + x, b] for a, b in [*ring, ring[0]]]
    shapes = [
        {"type": "MultiPolygon", "coordinates": [[closed(SQUARE), closed(HOLE)], [closed(SQUARE[::-1], 20)]]}, {"type": "Polygon", "coordinates": [closed(SQUARE), closed(HOLE[::-1])]},
        {"type": "Polygon", "coordinates": []}, None, {"type": "Polygon", "coordinates": [closed([(0, 0), (5, 5)])]}, {"type": "Point", "coordinates": [1, 2]},
    ]
    features = [{"type": "Feature", "properties": {"kind": "a"}, "geometry": s} for s in shapes]
    path = f"{scratch_path(spark, 'parts')}.geojson"
    sinks.write_bytes(spark, path, json.dumps({"type": "FeatureCollection", "features": features}).encode())
    layer = layers.measured(readers.read_geojson(spark, path).withColumn("kind", F.col("properties")["kind"]), "kind")
    found = {r["feature_id"]: r for r in layer.collect()}
    assert [found[k]["state"] for k in range(6)] == ["ok", "ok", "empty", "null", "empty", "empty"]
    assert found[0]["area"] == 196 and found[0]["perimeter"] == 88 and found[1]["area"] == 96 and found[0]["cx"] == pytest.approx((100 * 5 - 4 * 3 + 100 * 25) / 196)
    assert layers.quality(layer).first().asDict() == {"input": 6, "null_shapes": 1, "empty_shapes": 3, "invalid_shapes": 0, "repaired": 0, "too_small": 0, "processed": 2}


def test_unique_classes_follow_the_values(spark):
    rows = spark.createDataFrame([(float(v),) for v in (10, 9, 2, 2, 2, 100)] + [(None,)], "v double")
    named = lambda top: [(r["class_id"], r["class_label"], r["n"]) for r in classify.top_classes(rows, "v", top).orderBy("class_id").collect()]
    assert named(64) == [(0, "2", 3), (1, "9", 1), (2, "10", 1), (3, "100", 1)]
    assert named(3) == [(0, "2", 3), (1, "9", 1), (2, classify.OTHER, 2)]
    text = spark.createDataFrame([(v,) for v in ("10", "9", "2", "b", "B")], "v string")
    assert [r["class_label"] for r in classify.top_classes(text, "v").orderBy("class_id").collect()] == ["10", "2", "9", "B", "b"]
    assert classify.top_classes(rows.where("v is null"), "v").count() == 0
    odd = spark.createDataFrame([(0.5,), (3.0000000001,), (-1.0,)], "v double")
    assert [r["class_label"] for r in classify.top_classes(odd, "v").orderBy("class_id").collect()] == ["-1", "0.5", "3"]


def test_meanings():
    said, read = fields.meaning("LMRE", "here", "there")
    assert "divided by the size of there" in said and read.startswith("0 where here and there agree")
    assert fields.meaning("lme") == fields.meaning("LME") and fields.meaning("other") is None


def test_repair_is_dealt_and_plain_turns_need_no_closer_look(spark):
    """A layer from one task is repaired in several; a ring that meets nothing and turns right is turned for a whole batch."""
    from pyspark.sql import functions as F

    from geoaccord.operators import layers

    ring = "array(array(" + ", ".join(f"named_struct('x', id + {x}d, 'y', {y}d)" for x, y in ((0, 0), (0, 2), (1, 2), (1, 0))) + "))"
    rows = spark.range(40).coalesce(1).selectExpr("id as feature_id", "'k' as category", f"named_struct('type', 'polygon', 'parts', {ring}) as geometry")
    measured = layers.measured(rows, "category")
    assert measured.select(F.spark_partition_id()).distinct().count() > 1
    found = measured.orderBy("feature_id").collect()
    assert all(r["state"] == "ok" and r["area"] == 2 for r in found)
    assert [(p["x"], p["y"]) for p in found[3]["rings"][0]] == [(4.0, 0.0), (4.0, 2.0), (3.0, 2.0), (3.0, 0.0)]
