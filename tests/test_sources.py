"""Readers and sinks on small files that the tests write."""

import io
import json
import sqlite3
import struct
import zipfile

import pytest

from geoaccord.plans import engine
from geoaccord.sources import readers, sinks


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8-sig"), ("b", "utf-16"), ("c", "gb18030")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes("经度,纬度,name\n1.5,2,一\n3,4\n\n".encode(encoding))
        rows = readers.read_csv(spark, str(path)).orderBy("feature_id").collect()
        assert [tuple(r) for r in rows] == [(0, "1.5", "2", "一"), (1, "3", "4", "")]
    meta = readers.read_metadata(spark, str(tmp_path / "a.csv")).first()
    assert meta["records"] == 2 and meta["extent"] == [1.5, 2.0, 3.0, 4.0]


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"b": "x", "a": None}, "geometry": {"type": "Point", "coordinates": [5, 6, 7]}}]}
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps(doc))
    meta = readers.read_metadata(spark, str(path)).first()
    assert meta["fields"] == ["a", "b"] and meta["extent"] == [0.0, 0.0, 5.0, 6.0] and meta["geometry_type"] == "Polygon, Point"
    (tmp_path / "b.geojson").write_text(json.dumps(doc["features"][1]))
    assert readers.read_geojson(spark, str(tmp_path / "b.geojson")).count() == 1


def shapefile(tmp_path):
    def polygon(*rings):
        points = [p for r in rings for p in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        return struct.pack("<i4d2i", 5, 0, 0, 4, 4, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)

    bodies = [polygon([(0, 0), (0, 4), (4, 4), (0, 0)], [(1, 2), (1, 3), (2, 3), (1, 2)]), struct.pack("<i", 0), polygon([(1, 1), (1, 2), (2, 2), (1, 1)])]
    data = b"".join(struct.pack(">2i", k + 1, len(b) // 2) + b for k, b in enumerate(bodies))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<2i8d", 1000, 5, 0, 0, 4, 4, 0, 0, 0, 0)
    (tmp_path / "s.shp").write_bytes(head + data)
    fields = [("NAME", "C", 6, 0), ("POP", "N", 5, 0), ("RATE", "N", 6, 2), ("DAY", "D", 8, 0)]
    described = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields)
    rows = [" 北京  ".encode()[:0] + b" " + "一".encode().ljust(6) + b"   12" + b"  1.50" + b"20240102", b"*" + b"b     " + b"*****" + b"  2.50" + b"        ", b" " + b"c     " + b"    7" + b"     ." + b"20241301x"[:8]]
    size = 1 + 6 + 5 + 6 + 8
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 24, 1, 1, 3, 32 + 32 * 4 + 1, size) + b"\0" * 20 + described + b"\r" + b"".join(rows) + b"\x1a")
    (tmp_path / "s.cpg").write_text("UTF-8")
    (tmp_path / "s.prj").write_text('PROJCS["Test_Albers",GEOGCS["x"]]')
    return str(tmp_path / "s.shp")


def test_shapefile(spark, tmp_path):
    path = shapefile(tmp_path)
    rows = readers.read_shapefile(spark, path).orderBy("feature_id").collect()
    assert [r["geometry"]["type"] for r in rows] == ["polygon", "null", "polygon"] and len(rows[0]["geometry"]["parts"]) == 2
    assert [(r["NAME"], r["POP"], r["RATE"]) for r in rows] == [("一", 12, 1.5), ("b", None, 2.5), ("c", 7, None)]
    assert rows[0]["DAY"] == "2024-01-02" and rows[1]["DAY"] is None
    meta = readers.read_metadata(spark, path).first()
    assert meta["crs"] == "Test_Albers" and meta["records"] == 3
    assert readers.read_dbf(spark, path.replace(".shp", ".dbf"), keep_deleted=False).count() == 2


def test_other_formats(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.executescript("create table gpkg_contents(table_name, data_type, min_x, min_y, max_x, max_y, srs_id); insert into gpkg_contents values('t','features',0,1,2,3,4326); create table gpkg_geometry_columns(table_name, column_name, geometry_type_name); insert into gpkg_geometry_columns values('t','geom','POLYGON'); create table gpkg_spatial_ref_sys(srs_id, organization, organization_coordsys_id); insert into gpkg_spatial_ref_sys values(4326,'EPSG',4326); create table t(fid integer primary key, geom blob, v); insert into t values(1,x'00','a'),(2,x'00',5);")
    db.commit()
    db.close()
    meta = readers.read_metadata(spark, str(tmp_path / "g.gpkg")).first()
    assert meta["crs"] == "EPSG:4326" and meta["records"] == 2 and meta["fields"] == ["fid", "v"]
    assert [r["v"] for r in readers.read_geopackage(spark, str(tmp_path / "g.gpkg")).orderBy("feature_id").collect()] == ["a", "5"]
    for key, x in (("corner", 10), ("center", 11)):
        (tmp_path / f"{key}.asc").write_text(f"ncols 4\nnrows 3\nxll{key} {x}\nyll{key} {x + 10}\ncellsize 2\nNODATA_value -9\n" + "1 2 3 4\n5 -9 7 8\n9 10 11 12\n")
        assert readers.read_metadata(spark, str(tmp_path / f"{key}.asc")).first()["extent"] == [10.0, 20.0, 18.0, 26.0]
    cells = {(r["r"], r["c"]): r["value"] for r in readers.read_ascii_grid(spark, str(tmp_path / "corner.asc")).collect()}
    assert cells[1, 1] is None and cells[2, 3] == 12.0 and len(cells) == 12
    for order, mark in (("<", b"II"), (">", b"MM")):
        tags = [(256, 3, 7), (257, 4, 9), (277, 3, 2)]
        body = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in tags)
        (tmp_path / "t.tif").write_bytes(mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 3) + body)
        assert readers.read_metadata(spark, str(tmp_path / "t.tif")).first()["records"] == 63
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>n</t></si><si><t>v</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><dimension ref="A1:B2"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(out.getvalue())
    assert tuple(readers.read_xlsx(spark, str(tmp_path / "w.xlsx")).first()) == (0, None, "3")
    assert readers.read_metadata(spark, str(tmp_path / "missing.csv")).first()["reader"] == "fallback"
    assert readers.read_metadata(spark, str(tmp_path / "old.xls")).first()["warnings"]


def test_registry_and_report(spark, tmp_path):
    registry = sinks.Registry(spark, str(tmp_path / "project"))
    registry.add_source({"name": "a", "path": "/x/a.csv", "fields": ["f"], "warnings": []})
    registry.add_source({"name": "b", "path": "/x/a.csv", "fields": ["f"], "warnings": []})
    registry.add_source({"name": "t", "path": "/tmp/t.csv", "fields": [], "warnings": []})
    registry.purge("/tmp/")
    assert [r["name"] for r in registry.sources().collect()] == ["b"]
    registry.add_run("1", "one", "attribute", {"m": float("nan")}, "now")
    registry.rename_run("1", "two")
    assert registry.runs().first()["title"] == "two" and json.loads(registry.runs().first()["result"]) == {"m": None}
    text = sinks.report("T", sinks.success("e", {"me": 1.23456789, "gone": None}, artifacts={"shp": {"k": "p"}}))
    assert "| me | 1.23457 |" in text and "gone" not in text and "- shp__k: p" in text


def test_engine(spark, sf):
    from geoaccord.fixtures import fixture
    from geoaccord.operators import matching

    good = engine.run("attribute", {"variables": ["v_a", "v_c"], "bandwidth": 600}, points=fixture(spark, sf, "sites"))
    assert good.ok and good.envelope["metrics"]["samples"] > 100 and good.tables["local"].count() == good.envelope["metrics"]["samples"]
    assert not engine.run("attribute", {"variables": ["v_a", "nope"]}, points=fixture(spark, sf, "sites")).ok
    layers = {k: matching.rectangles(fixture(spark, sf, f"poly_{k}")) for k in "ab"}
    found = engine.run("geometry", {"category_mappings": [(str(k), f"C{k}", str(k)) for k in range(6)], "cell": 32.0, "bandwidth": 30.0}, **layers)
    assert found.ok and 0 < found.envelope["metrics"]["recommended_threshold"] < 1
    assert engine.run("raster", {"layers": ["left_v", "right_v"]}, cells=fixture(spark, sf, "grid")).ok
    assert engine.run("x", {}).envelope["status"] == "error"


def test_stream(spark, sf, tmp_path):
    from geoaccord.streaming.agreement import windowed_metrics

    events = spark.read.parquet(f"{sf}/events.parquet")
    time = next(n for n, t in events.dtypes if t.startswith("timestamp"))
    rows = events.selectExpr(f"cast({time} as timestamp) as ts", "cast(value as double) as y", "cast(value as double) * 0.9 as x")
    rows.write.parquet(str(tmp_path / "in"))
    batch = windowed_metrics(rows, "y", "x", window="1 day").count()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_metrics(stream, "y", "x", window="1 day").writeStream.outputMode("complete").format("memory").queryName("agreement").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("agreement").count() == batch > 0


if __name__ == "__main__":
    pytest.main([__file__])
