"""Files cut in the middle of everything: quoted values over lines, and features, in blocks of a few bytes."""

import csv
import io
import json
import random

import pytest

from geoaccord.sources import readers


@pytest.fixture(params=[150, 1 << 20])
def small_blocks(spark, request):
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_quoted_lines(spark, tmp_path, small_blocks):
    rng = random.Random(small_blocks)
    value = lambda: rng.choice(["", "x", " ", 'a "quoted" one', "two\nlines", "a\n\n,\nb", "\n", "一,二", "long " * rng.randrange(9), '"', "cr\r\nlf"])
    rows = [[value() for _ in range(3)] for _ in range(25)] + [["", " ", ""], ["last", "", '"']]
    for name, encoding, ending in (("a", "utf-8", "\n"), ("b", "utf-8-sig", "\r\n"), ("c", "gb18030", "\n")):
        held = io.StringIO()
        csv.writer(held, lineterminator=ending).writerows([["k", "name", "n"], *rows])
        path = tmp_path / f"{name}.csv"
        path.write_bytes((held.getvalue() + ending + "short" + ending + ending).encode(encoding))
        want = [r for r in [*rows, ["short", "", ""]] if any(map(str.strip, r))]
        got = readers.read_csv(spark, str(path)).orderBy("feature_id").collect()
        assert [list(r)[1:] for r in got] == want and [r["feature_id"] for r in got] == list(range(len(want)))


def test_folders_have_a_header_in_each_file(spark, tmp_path, small_blocks):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("id,text\n" + "".join(f'{k}{j},"line\n{j}"\n' for j in range(k * 2)))
    got = readers.read_csv(spark, str(tmp_path)).orderBy("feature_id").collect()
    assert [tuple(r) for r in got] == [(n, f"{k}{j}", f"line\n{j}") for n, (k, j) in enumerate((k, j) for k in range(3) for j in range(k * 2))]
    (tmp_path / "none.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_features(spark, tmp_path, small_blocks):
    rng = random.Random(small_blocks)
    text = lambda: rng.choice(["plain", 'a "b" {', "}{", "\\", '\\"}', "一}", '{"type": "Feature"}', "x" * rng.randrange(90)])
    shapes = [{"type": "Point", "coordinates": [1.5, 2]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, None, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 4]}]}]
    features = [{"type": "Feature", "properties": rng.choice([{"a": text(), "b": {"c": text()}}, {}, None, {text(): 1}]), "geometry": rng.choice(shapes)} for _ in range(9)]
    doc = {"type": "FeatureCollection", "name": text(), "crs": {"type": "name", "properties": {"name": "EPSG:4490"}}, "features": features}
    for indent, ascii in ((None, True), (2, False)):
        path = tmp_path / f"f{indent}.geojson"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii) + "\n")
        got = readers.read_geojson(spark, str(path)).orderBy("feature_id").collect()
        assert [r["feature_id"] for r in got] == list(range(9))
        for r, f in zip(got, features):
            assert r["geometry_type"] == (f["geometry"] or {}).get("type") and set(r["properties"]) == set(f["properties"] or {})
            assert all(r["properties"][k] == v for k, v in (f["properties"] or {}).items() if isinstance(v, str))
            assert [len(p) for p in r["geometry"]["parts"]] == {"Point": [1], "Polygon": [4], "GeometryCollection": [1], None: []}[r["geometry_type"]]
        meta = readers.read_metadata(spark, str(path)).first()
        assert meta["records"] == 9 and meta["crs"] == "EPSG:4490"
    one = tmp_path / "one.geojson"
    one.write_text(json.dumps({"type": "Feature", "properties": {"type": "x", "k": "{"}, "geometry": shapes[1]}))
    assert [(r["feature_id"], r["geometry_type"], r["properties"]["k"]) for r in readers.read_geojson(spark, str(one)).collect()] == [(0, "Polygon", "{")]
    one.write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    assert readers.read_geojson(spark, str(one)).count() == 0
