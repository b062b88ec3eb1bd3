"""Shapefiles and rasters read by ranges: the same rows as of whole files, and no more of the file than is asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaccord.sources import ranges, readers, sinks, tiff

SQUARE = "array(struct(cast({0} as double) as x, 0D as y), struct({0} + 2D as x, 0D as y), struct({0} + 2D as x, 1D as y), struct(cast({0} as double) as x, 0D as y))"


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('layer')}/layer.shp"
    rows = spark.range(0, 100, 1, 1).selectExpr(f"case when id % 7 > 0 then array({SQUARE.format('id')}) end as rings", "case when id % 5 > 0 then id % 5 end as code", "concat('类', id % 3) as xmin", "id / 4D as share")
    sinks.write_shapefile(rows, path, ["code", "xmin", "share"])
    return path


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_rows_as_of_the_whole_file(spark, layer):
    whole = readers.read_shapefile(spark, layer).select("feature_id", "geometry", "code", "xmin", "share")
    got = ranges.read_shapefile(spark, layer, records=16)
    assert got.columns == ["feature_id", "geometry", *ranges.BOX, "code", "xmin_", "share"] and got.rdd.getNumPartitions() == 7
    assert plain(got.select("feature_id", "geometry", "code", "xmin_", "share")) == plain(whole)
    assert plain(got.where("feature_id in (7, 8)").select("feature_id", *ranges.BOX)) == [(7, None, None, None, None), (8, 8.0, 0.0, 10.0, 1.0)]


@pytest.mark.parametrize("where, sql", [
    ([("code", "=", 2)], "code = 2"), ([("code", "in", [1, 3])], "code in (1, 3)"), ([("code", "in", [])], "false"), ([("code", "is null")], "code is null"),
    ([("code", "is not null"), ("share", ">", 20)], "code is not null and share > 20"), ([("xmin_", "=", "类1"), ("xmax", "<", 30)], "xmin_ = '类1' and xmax < 30"),
    ([("xmin", "is null")], "xmin is null"), ([("feature_id", ">=", 40), ("feature_id", "<=", 41)], "feature_id between 40 and 41"), ([("code", "=", None)], "false"),
])
def test_conditions_are_those_of_sql(spark, layer, where, sql):
    whole = ranges.read_shapefile(spark, layer, records=16)
    assert plain(ranges.read_shapefile(spark, layer, where=where, records=16)) == plain(whole.where(sql))
    assert plain(ranges.read_shapefile(spark, layer, ["share"], where, records=16)) == plain(whole.where(sql).select("share"))


def test_frames_of_one_scan_keep_their_filters_apart(spark, layer):
    got = ranges.read_shapefile(spark, layer)
    one, two = got.where("code = 1"), got.where("code = 2")
    assert one.count() == 20 and two.count() == 20 and got.count() == 100 and one.union(two).select("code").distinct().count() == 2


def test_only_wanted_records_are_decoded(layer, monkeypatch):
    seen = []
    shapes = readers.shapes
    monkeypatch.setattr(readers, "shapes", lambda record, number=0: seen.append(1) or shapes(record, number))
    where = [["code", "=", 2], ["xmax", "<", 40], ["feature_id", ">=", 20]]
    import json

    source = ranges.Shapefile({"path": layer, "where": json.dumps(where), "records": "16"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert [(p.first, p.behind) for p in parts] == [(k, min(100, k + 16)) for k in range(16, 100, 16)]
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert rows == len(seen) == len([k for k in range(20, 38) if k % 5 == 2 and k % 7])
    plain_table = ranges.Shapefile({"path": layer, "columns": '["share"]'})
    monkeypatch.setattr(ranges.ShapefileReader, "_shapes", None)  # shapes are not touched
    reader = plain_table.reader(plain_table.schema())
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 100


def test_wrong_conditions_raise(spark, layer):
    for where in ([("nothing", "=", 1)], [("code", "=", "1")], [("xmin_", "=", 1)], [("code", "like", 1)]):
        with pytest.raises(Exception):
            ranges.read_shapefile(spark, layer, where=where).count()
    with pytest.raises(Exception):
        ranges.read_shapefile(spark, layer, ["nothing"]).count()


def test_categories(spark, layer):
    assert [r["feature_id"] for r in ranges.read_categories(spark, layer, "code", ["2.0", 4, "x"], limit=3).orderBy("feature_id").collect()] == [2, 4, 7]
    assert ranges.read_categories(spark, layer, "xmin_", ["类2"]).count() == 33
    with pytest.raises(ValueError):
        ranges.read_categories(spark, layer, "geometry", [1])


def test_empty_shapefile_and_missing_index(spark, tmp_path):
    path = f"{tmp_path}/none.shp"
    sinks.write_shapefile(spark.sql(f"select array({SQUARE.format('1')}) as rings, 1 as code").where("false"), path, ["code"])
    assert ranges.read_shapefile(spark, path).count() == 0
    (tmp_path / "none.shx").unlink()
    with pytest.raises(ValueError):
        ranges.read_shapefile(spark, path)


def test_points(spark, tmp_path):
    import struct

    from geoaccord.sources import shapefile

    records = [struct.pack("<i2d", 1, k, -k) for k in range(5)]
    body, index, at = b"", b"", 50
    for k, r in enumerate(records):
        body += struct.pack(">2i", k + 1, len(r) // 2) + r
        index += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8)
    for suffix, data in ((".shp", head + body), (".shx", head + index), (".dbf", shapefile.encode_table(["k"], [(k,) for k in range(4)]))):
        (tmp_path / f"p{suffix}").write_bytes(data)
    got = ranges.read_shapefile(spark, f"{tmp_path}/p.shp", ["feature_id", "geometry", "ymax", "k"], [("xmin", ">=", 3)]).orderBy("feature_id").collect()
    assert [(r[0], r[1].parts[0][0].x, r[2], r[3]) for r in got] == [(3, 3.0, -3.0, 3), (4, 4.0, -4.0, None)]


def test_windows_of_rasters(spark, tmp_path, monkeypatch):
    cells = np.arange(40 * 30, dtype=float).reshape(40, 30)
    cells[5, 5] = np.nan
    path = tmp_path / "a.tif"
    path.write_bytes(tiff.encode(cells, (0.0, 0.0), 1.0, 32650, rows_per_strip=4))
    assert plain(ranges.read_tiff(spark, str(path))) == plain(tiff.read_tiff(spark, str(path)).select("r", "c", "value"))
    where = [["r", ">=", 5], ["r", "<", 9], ["c", "in", [5, 29, 77]]]
    got = plain(ranges.read_tiff(spark, f"file://{path}", where=where))
    assert got == sorted(((r, c, None if (r, c) == (5, 5) else float(r * 30 + c)) for r in range(5, 9) for c in (5, 29)), key=repr)
    reader = ranges.RasterReader(str(path), 1, ranges.conditions(where, {"r": "int", "c": "int"}))
    assert [p.numbers for p in reader.partitions()] == [[1, 2]]
    monkeypatch.setattr(ranges, "BLOCKS", 1)
    assert [p.numbers for p in reader.partitions()] == [[1], [2]]
    assert ranges.read_tiff(spark, str(path), where=[("r", ">", 100)]).count() == 0
    assert ranges.read_tiff(spark, str(path)).agg(F.count("value")).first()[0] == 1199


def test_files_are_put_together_from_pieces(spark, tmp_path, monkeypatch):
    """The driver gets a row a piece, not rows and cells: files of many pieces hold what was written, blanks too."""
    from pyspark.sql import DataFrame

    def refused(*_, **__):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(sinks, "RECORDS", 7)
    monkeypatch.setattr(sinks, "CELLS", 48)
    ring = "array(array(" + ", ".join(f"named_struct('x', id + {x}d, 'y', {y}d)" for x, y in ((0, 0), (1, 0), (1, 2), (0, 2))) + "))"
    rows = spark.range(0, 40, 1, 3).selectExpr(f"case when id % 5 > 0 then {ring} end as rings", "id as code", "case when id % 2 = 0 then concat('n', id) end as name")
    sinks.write_shapefile(rows, f"{tmp_path}/many.shp", ["code", "name"])
    for got in (ranges.read_shapefile(spark, f"{tmp_path}/many.shp"), readers.read_shapes(spark, f"{tmp_path}/many.shp").join(readers.read_dbf(spark, f"{tmp_path}/many.dbf"), "feature_id"), readers.read_shapefile(spark, f"{tmp_path}/many.shp")):
        found = sorted((r["feature_id"], r["code"], r["name"], r["geometry"]["type"], sorted({p["x"] for q in r["geometry"]["parts"] for p in q})) for r in got.collect())
        assert found == [(k, k, f"n{k}" if k % 2 == 0 else "", *(("polygon", [float(k), k + 1.0]) if k % 5 else ("null", []))) for k in range(40)]
    cells = spark.range(4 * 100).where("id div 4 < 20 or id div 4 > 60").selectExpr("int(id div 4) as r", "int(id % 4) as c", "double(id) / 4 as value")
    want = [(k // 4, k % 4, k / 4 if k // 4 < 20 or k // 4 > 60 else None) for k in range(400)]
    sinks.write_tiff(cells, f"{tmp_path}/g.tif", {"width": 4, "height": 100, "cell": (1.0, 1.0), "extent": [0.0, 0.0, 4.0, 100.0], "epsg": 32650})
    sinks.write_ascii_grid(cells, f"{tmp_path}/g.asc", 4, 100, {"xllcorner": 0, "yllcorner": 0, "cellsize": 1})
    for got in (ranges.read_tiff(spark, f"{tmp_path}/g.tif"), readers.read_ascii_grid(spark, f"{tmp_path}/g.asc")):
        assert sorted((r["r"], r["c"], r["value"]) for r in got.collect()) == want
