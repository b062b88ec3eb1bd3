"""Registered queries over files: each writes its files from the test tables, reads them back and reports what was read."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from geoaccord.fixtures import fixture, fixture_sql
from geoaccord.functions import geometry, projection
from geoaccord.operators import layers, raster
from geoaccord.plans import compare, preprocess
from geoaccord.scratch import scratch_path
from geoaccord.sources import pyramid, ranges, readers, sinks, tiff

#: Moves means of few decimals off a tie, below the last digit that is reported.
TIE = 1.2345e-7
#: Cells of the test grid that go into a raster file.
GRID_COLUMNS = 100
#: Overviews of the pyramid that is written of the test grid.
PYRAMID = (2, 4, 16)


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    rows = _read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "quoted",\nsecond line')).alias("c_name"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    sinks.write_csv(rows, path)
    got = readers.read_csv(spark, path)
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.round(F.col("c_acctbal").try_cast("double"), 2).alias("c_acctbal"), (F.col("c_acctbal") == "").alias("blank"))


def csv_metadata(spark, d):
    """Rows, fields and extent of a table of points, by its file alone."""
    path = f"{scratch_path(spark, 'points')}.csv"
    sinks.write_csv(fixture(spark, d, "sites").select("feature_id", F.col("px").alias("Lon"), F.col("py").alias("LAT")), path)
    got = readers.read_metadata(spark, path)
    return got.select("reader", "data_type", "records", F.concat_ws(",", "fields").alias("fields"), "geometry_type", *(F.col("extent")[k].alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))))


def geojson_scan(spark, d):
    """Properties and boxes of points, polygons and collections."""
    features = []
    for r in _read(spark, d, "nation").collect():
        x, y = 2.0 * r["n_nationkey"], 3.0 * r["n_nationkey"]
        ring = {"type": "Polygon", "coordinates": [[[x, y], [x + 4, y], [x + 4, y + 1], [x, y]]]}
        point = {"type": "Point", "coordinates": [x, y, 7.0]}
        shape = (point, ring, {"type": "GeometryCollection", "geometries": [point, ring]})[r["n_nationkey"] % 3]
        features.append({"type": "Feature", "geometry": shape, "properties": {"key": r["n_nationkey"], "name": r["n_name"], "none": None}})
    path = f"{scratch_path(spark, 'geo')}.geojson"
    sinks.write_bytes(spark, path, json.dumps({"type": "FeatureCollection", "features": features}).encode())
    v = F.flatten("geometry.parts")
    box = [F.array_min(v["x"]).alias("xmin"), F.array_min(v["y"]).alias("ymin"), F.array_max(v["x"]).alias("xmax"), F.array_max(v["y"]).alias("ymax")]
    return readers.read_geojson(spark, path).select(F.col("properties")["key"].cast("long").alias("n_nationkey"), F.col("properties")["name"].alias("n_name"), F.col("properties")["none"].isNull().alias("no_value"), "geometry_type", F.size("geometry.parts").alias("parts"), *box)


def shapefile_layer(spark, d):
    """A shapefile of L-shapes, written, read and measured."""
    path = f"{scratch_path(spark, 'layer')}.shp"
    shape = geometry.l_shape(F.col("minx"), F.col("miny"), F.col("w"), F.col("h"))
    rows = fixture(spark, d, "poly_a").select(F.col("feature_id").alias("part_number"), F.col("category").alias("category_code"), shape.alias("rings"))
    sinks.write_shapefile(rows, path, ["part_number", "category_code"], projection='PROJCS["Test plane"]')
    measured = layers.measured(readers.read_shapefile(spark, path), "category_c", keep=["part_numbe"])
    return measured.select(F.col("part_numbe").alias("p_partkey"), "category", "state", *(F.round(c, 4).alias(c) for c in ("minx", "miny", "maxx", "maxy", "area", "perimeter", "cx", "cy")))


def shapefile_categories(spark, d):
    """Two categories of a shapefile within a window, measured: no other record is read."""
    path = f"{scratch_path(spark, 'layer')}.shp"
    shape = geometry.l_shape(F.col("minx"), F.col("miny"), F.col("w"), F.col("h"))
    rows = fixture(spark, d, "poly_a").select("feature_id", F.col("category").cast("int").alias("code"), F.when(F.col("feature_id") % 10 > 0, shape).alias("rings"))
    sinks.write_shapefile(rows, path, ["feature_id", "code"])
    got = ranges.read_shapefile(spark, path, ["feature_id", "geometry", "feature_id_", "code"], [ranges.category_condition("code", "bigint", ["1", "4.0"]), ("xmin", "<=", 300), ("xmax", ">=", 120)], records=256)
    measured = layers.measured(got.drop("feature_id").withColumnRenamed("feature_id_", "feature_id"), "code")
    return measured.select(F.col("feature_id").alias("p_partkey"), "category", F.round("area", 4).alias("area"), F.round("minx", 4).alias("minx"))


def tiff_window(spark, d):
    """A window of a raster: only its strips are read."""
    path = f"{scratch_path(spark, 'grid')}.tif"
    sinks.write_tiff(*_grid(spark, d, path))
    return ranges.read_tiff(spark, path, where=[("r", ">=", 3), ("r", "<", 40), ("c", ">", 20), ("c", "<=", 60)]).select("r", "c", F.round("value", 2).alias("value"))


def shapefile_check(spark, d):
    """Counts and candidate category fields of a shapefile before its analysis."""
    path = f"{scratch_path(spark, 'layer')}.shp"
    shape = F.when(F.col("feature_id") % 10 > 0, geometry.rectangle(F.col("minx"), F.col("miny"), F.col("minx") + F.col("w"), F.col("miny") + F.col("h")))
    sinks.write_shapefile(fixture(spark, d, "poly_a").select("feature_id", "category", shape.alias("rings")), path, ["feature_id", "category"])
    found = readers.check_shapefile(spark, path)
    return spark.createDataFrame([(found["records"], found["null"], found["empty"], found["invalid"], found["polygons"], ",".join(found["missing_files"]), ",".join(found["categories"]), len(found["values"]))], "records long, null_shapes long, empty_shapes long, invalid_shapes long, polygons boolean, missing_files string, category_fields string, category_values int")


def _grid(spark, d, path, shift=0.0):
    """The test grid, the path of its raster file, and the place of that."""
    cells = fixture(spark, d, "grid").select("r", "c", F.col("left_v").alias("value"))
    height = cells.agg(F.max("r")).first()[0] + 1
    return cells, path, {"width": GRID_COLUMNS, "height": height, "cell": (10.0, 10.0), "extent": [100.0 + shift, 50.0 - 10.0 * height, 1100.0 + shift, 50.0], "epsg": 32650}


def ascii_grid_scan(spark, d):
    cells, path, info = _grid(spark, d, f"{scratch_path(spark, 'grid')}.asc")
    sinks.write_ascii_grid(cells, path, info["width"], info["height"], {"xllcenter": 10, "yllcenter": 20, "cellsize": 2})
    return readers.read_ascii_grid(spark, path).select("r", "c", F.round("value", 4).alias("value"))


def tiff_scan(spark, d):
    """The pixels of a deflated GeoTIFF in strips."""
    path = f"{scratch_path(spark, 'grid')}.tif"
    sinks.write_tiff(*_grid(spark, d, path))
    return tiff.read_tiff(spark, path).select("r", "c", F.round("value", 2).alias("value"))


def raster_file_overlay(spark, d):
    """Two rasters on grids half a cell apart, read, aligned to the first and laid over each other."""
    paths = [f"{scratch_path(spark, 'grid')}.tif" for _ in range(2)]
    for path, shift in zip(paths, (0.0, 5.0)):
        sinks.write_tiff(*_grid(spark, d, path, shift))
    infos = [tiff.read_info(spark, path) for path in paths]
    raster.preflight(infos)
    one, two = (tiff.read_tiff(spark, path) for path in paths)
    return raster.overlay({"left_v": one, "right_v": raster.align(two, infos[1], infos[0], "bilinear")}).select("r", "c", F.round("left_v", 2).alias("left_v"), F.round("right_v", 2).alias("right_v"))


def raster_alignment(spark, d):
    """Two rasters on grids half a cell apart, prepared as files on one grid, and read from those."""
    cells = fixture(spark, d, "grid").select("r", "c", F.col("left_v").alias("value"))
    height, folder = cells.agg(F.max("r")).first()[0] + 1, scratch_path(spark, "aligned")
    sources = []
    for name, shift in (("left_v", 0.0), ("right_v", 5.0)):
        sources.append({"name": name, "path": f"{scratch_path(spark, name)}.tif"})
        info = {"width": GRID_COLUMNS, "height": height, "cell": (10.0, 10.0), "extent": [100.0 + shift, 50.0 - 10.0 * height, 1100.0 + shift, 50.0], "epsg": 32650}
        pyramid.write_pyramid(cells, sources[-1]["path"], info, factors=())
    made = preprocess.run("raster_align", spark, sources, folder, factors=(4,))
    if made["status"] != "success":
        raise ValueError(made["message"])
    both = raster.overlay({p["name"]: ranges.read_tiff(spark, p["aligned_path"]) for p in made["processed"]})
    return both.select("r", "c", F.round("left_v", 2).alias("left_v"), F.round("right_v", 2).alias("right_v"))


def raster_reprojection(spark, d):
    """The cells of the grid as a raster in UTM, on a grid of degrees: its values are linear in the eastings and northings,
    so are those it gets."""
    cells = fixture(spark, d, "grid").select("r", "c", (F.col("c") * 2.0 + F.col("r") * 3.0).alias("value"))
    height = cells.agg(F.max("r")).first()[0] + 1
    top = 3_303_000.0
    info = {"width": GRID_COLUMNS, "height": height, "bands": 1, "nodata": None, "cell": (100.0, 100.0), "extent": [500_000.0, top - 100.0 * height, 500_000.0 + 100.0 * GRID_COLUMNS, top], "epsg": 32650}
    path = f"{scratch_path(spark, 'plane')}.tif"
    sinks.write_tiff(cells, path, info)
    own, rows = tiff.read_info(spark, path), max(0, (height * 100 - 700) // 111)
    target = {"width": 80, "height": rows, "cell": (0.001, 0.001), "extent": [117.003, 29.853 - 0.001 * rows, 117.083, 29.853], "epsg": 4326}
    found = raster.align(tiff.read_tiff(spark, path), own, target)
    x, y = projection.utm(117.003 + (F.col("c") + 0.5) * 0.001, 29.853 - (F.col("r") + 0.5) * 0.001, 50)
    want = ((x - 500_000.0) / 100 - 0.5) * 2 + ((top - y) / 100 - 0.5) * 3
    return found.where("value is not null").select("r", "c", (F.abs(F.col("value") - want) < 1e-3).alias("equal"))


def comparison_sides(spark, d):
    """Bounds and rows of a shapefile beside a raster."""
    stem = scratch_path(spark, "side")
    shape = geometry.rectangle(F.col("minx"), F.col("miny"), F.col("minx") + F.col("w"), F.col("miny") + F.col("h"))
    sinks.write_shapefile(fixture(spark, d, "poly_a").select("category", shape.alias("rings")), f"{stem}.shp", ["category"])
    sinks.write_tiff(*_grid(spark, d, f"{stem}.tif"))
    made = compare.sides(spark, {"path": f"{stem}.shp", "field": "category", "method": "unique"}, {"path": f"{stem}.tif"})
    rows = [(k, s.kind, s.rows.count(), s.legend.count() if s.legend else 0, *(round(float(v), 4) for v in s.bounds)) for k, s in enumerate(made)]
    return spark.createDataFrame(rows, "side int, kind string, n long, classes long, xmin double, ymin double, xmax double, ymax double")


def geopackage_scan(spark, d):
    db = sqlite3.connect(":memory:")
    db.executescript(
        "create table gpkg_contents (table_name text, data_type text, min_x double, min_y double, max_x double, max_y double, srs_id int);"
        "create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text); create table gpkg_spatial_ref_sys (srs_id int, organization text, organization_coordsys_id int);"
        "create table places (fid integer primary key, geom blob, n_name text, n_regionkey int); insert into gpkg_contents values ('places', 'features', 0, 0, 50, 75, 7);"
        "insert into gpkg_geometry_columns values ('places', 'geom', 'POINT'); insert into gpkg_spatial_ref_sys values (7, 'EPSG', 4326);"
    )
    db.executemany("insert into places values (?, x'00', ?, ?)", [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _read(spark, d, "nation").collect()])
    path = f"{scratch_path(spark, 'places')}.gpkg"
    sinks.write_bytes(spark, path, db.serialize())
    return readers.read_geopackage(spark, path).select(F.col("fid").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def xlsx_scan(spark, d):
    rows = [["n_nationkey", "n_name"], *([str(r["n_nationkey"]), r["n_name"]] for r in _read(spark, d, "nation").collect())]
    cell = lambda at, row, v: f'<c r="{"AB"[at]}{row}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f'<row r="{k}">{"".join(cell(at, k, v) for at, v in enumerate(row))}</row>' for k, row in enumerate(rows, 1))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><dimension ref="A1:B{len(rows)}"/><sheetData>{sheet}</sheetData></worksheet>')
    path = f"{scratch_path(spark, 'book')}.xlsx"
    sinks.write_bytes(spark, path, held.getvalue())
    return readers.read_xlsx(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def catalog_export(spark, d):
    """The catalog's CSV, its commas full-width, read as text lines without the header."""
    path = scratch_path(spark, "catalog")
    rows = fixture(spark, d, "catalog").select(F.concat("name", F.lit(", x")).alias("name"), "data_type", F.lit("/p").alias("path"), F.lit("1,2").alias("extent"), "crs", F.lit(3).alias("records"), F.lit("ok").alias("status"))
    sinks.export_catalog(rows, path)
    return spark.read.text(path).where(~F.col("value").contains("data_type"))


def raster_overviews(spark, d):
    path = scratch_path(spark, "overviews")
    sinks.overviews(fixture(spark, d, "grid").select("r", "c", F.col("left_v").alias("value")), path, factors=(2, 4, 8))
    return spark.read.parquet(path).select("factor", "r", "c", F.round(F.col("value") + TIE, 4).alias("value"))


def raster_pyramid(spark, d):
    """The grid in one tiled file with its overviews, each level read back."""
    cells = fixture(spark, d, "grid").select("r", "c", F.col("left_v").alias("value"))
    height = cells.agg(F.max("r")).first()[0] + 1
    path = f"{scratch_path(spark, 'pyramid')}.tif"
    info = {"width": GRID_COLUMNS, "height": height, "cell": (10.0, 20.0), "extent": [100.0, 50.0 - 20.0 * height, 100.0 + 10.0 * GRID_COLUMNS, 50.0], "epsg": 32650}
    pyramid.write_pyramid(cells, path, info, factors=PYRAMID, tile=32, packing="lzw", part_tiles=16)
    got = None
    for level, factor in enumerate((1, *PYRAMID)):
        one = ranges.read_tiff(spark, path, level=level).select(F.lit(factor).alias("factor"), "r", "c", F.round("value", 2).alias("value"))
        got = one if got is None else got.union(one)
    return got


def project_registry(spark, d):
    """The catalog of a project after sources were added, replaced and removed, and its runs."""
    registry = sinks.Registry(spark, scratch_path(spark, "project"))
    nations = _read(spark, d, "nation")
    rows = nations.select("n_nationkey", F.col("n_name").alias("name"), F.concat(F.when(F.col("n_nationkey") % 5 == 0, "/tmp/").otherwise("/x/"), F.col("n_nationkey"), F.lit(".csv")).alias("path"))
    registry.add_sources(rows.drop("n_nationkey"))
    registry.add_sources(rows.where("n_nationkey % 3 = 1").select(F.concat("name", F.lit(" again")).alias("name"), "path"))
    registry.purge("/tmp/")
    registry.remove_source("/x/4.csv")
    registry.add_run("r1", "first", "attribute", {"status": "success", "sources": nations.count()}, "now")
    registry.rename_run("r1", "renamed")
    runs = registry.runs().select("title", F.get_json_object("result", "$.sources"), F.lit("run"))
    return registry.sources().select("name", "path", F.lit("source").alias("kind")).union(runs)


QUERIES = {f.__name__: f for f in (csv_scan, csv_metadata, geojson_scan, shapefile_layer, shapefile_categories, tiff_window, shapefile_check, ascii_grid_scan, tiff_scan, raster_file_overlay, raster_alignment, raster_reprojection, comparison_sides, geopackage_scan, xlsx_scan, catalog_export, raster_overviews, raster_pyramid, project_registry)}

_G, _P = fixture_sql("grid"), fixture_sql("poly_a")
ORACLE_SQL = {
    "csv_scan": "select c_custkey, c_name || ', \"quoted\",' || chr(10) || 'second line' as c_name, case when c_custkey % 5 > 0 then round(c_acctbal::double, 2) end as c_acctbal, c_custkey % 5 = 0 or c_acctbal is null as blank from customer",
    "csv_metadata": f"select 'csv' as reader, 'attribute' as data_type, count(*) as records, 'feature_id,Lon,LAT' as fields, 'point' as geometry_type, min(px) as xmin, min(py) as ymin, max(px) as xmax, max(py) as ymax from {fixture_sql('sites')}",
    "geojson_scan": "select n_nationkey::bigint as n_nationkey, n_name, true as no_value, case n_nationkey % 3 when 0 then 'Point' when 1 then 'Polygon' else 'GeometryCollection' end as geometry_type, (1 + (n_nationkey % 3 = 2)::int)::int as parts, n_nationkey * 2.0::double as xmin, n_nationkey * 3.0::double as ymin, n_nationkey * 2.0::double + case when n_nationkey % 3 > 0 then 4 else 0 end as xmax, n_nationkey * 3.0::double + case when n_nationkey % 3 > 0 then 1 else 0 end as ymax from nation",
    "shapefile_layer": f"select feature_id as p_partkey, category, 'ok' as state, round(minx, 4) as minx, round(miny, 4) as miny, round(minx + w, 4) as maxx, round(miny + h, 4) as maxy, round(w * h * 0.75, 4) as area, round(2 * (w + h), 4) as perimeter, round(minx + w * 5 / 12, 4) as cx, round(miny + h * 5 / 12, 4) as cy from {_P}",
    "shapefile_categories": f"select feature_id as p_partkey, category, round(w * h * 0.75, 4) as area, round(minx, 4) as minx from {_P} where category in ('1', '4') and minx <= 300 and minx + w >= 120 and feature_id % 10 > 0",
    "tiff_window": f"select r, c, round(left_v::float::double, 2) as value from {_G} where r between 3 and 39 and c between 21 and 60",
    "shapefile_check": f"select count(*) as records, count(*) filter (feature_id % 10 = 0) as null_shapes, 0::bigint as empty_shapes, 0::bigint as invalid_shapes, true as polygons, '.prj' as missing_files, 'category' as category_fields, count(distinct category)::int as category_values from {_P}",
    "ascii_grid_scan": f"select r, c, round(left_v, 4) as value from {_G}",
    "tiff_scan": f"select r, c, round(left_v::float::double, 2) as value from {_G}",
    "raster_file_overlay": f"""with g as (select r, c, left_v::float::double as v from {_G}) select a.r, a.c, round(a.v, 2) as left_v, round((coalesce(l.v, 0) + coalesce(a.v, 0)) / nullif((l.v is not null)::int + (a.v is not null)::int, 0), 2) as right_v
  from g a left join g l on l.r = a.r and l.c = a.c - 1""",
    "raster_alignment": f"""with g as (select r, c, left_v::float::double as v from {_G}) select a.r, a.c, round(a.v, 2) as left_v, round(((coalesce(l.v, 0) + coalesce(a.v, 0)) / nullif((l.v is not null)::int + (a.v is not null)::int, 0))::float::double, 2) as right_v
  from g a left join g l on l.r = a.r and l.c = a.c - 1""",
    "raster_reprojection": f"select r::int as r, c::int as c, true as equal from (select unnest(range((max(r)::bigint * 100 - 600) // 111)) as r from {_G}) a, range(80) b(c)",
    "comparison_sides": f"select 0 as side, 'shapes' as kind, count(*) as n, count(distinct category) as classes, round(min(minx), 4) as xmin, round(min(miny), 4) as ymin, round(max(minx + w), 4) as xmax, round(max(miny + h), 4) as ymax from {_P} union all select 1, 'raster', count(*), 0, 100, 50 - 10 * (max(r) + 1), 1100, 50 from {_G}",
    "geopackage_scan": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation",
    "xlsx_scan": "select n_nationkey::bigint as n_nationkey, n_name from nation",
    "catalog_export": f"select name || '，' || ' x,' || data_type || ',/p,1，2,' || crs || ',3,ok' as value from {fixture_sql('catalog')}",
    "project_registry": "select n_name || case when n_nationkey % 3 = 1 then ' again' else '' end as name, '/x/' || n_nationkey || '.csv' as path, 'source' as kind from nation where n_nationkey % 5 > 0 and n_nationkey <> 4 union all select 'renamed', count(*)::varchar, 'run' from nation",
    "raster_pyramid": " union all ".join(f"select {f} as factor, r // {f} as r, c // {f} as c, round(avg(left_v)::float::double, 2) as value from {_G} group by 2, 3" for f in (1, *PYRAMID)),
    "raster_overviews": " union all ".join(f"select {f} as factor, r // {f} as r, c // {f} as c, round(avg(left_v) + {TIE!r}, 4) as value from {_G} group by 2, 3" for f in (2, 4, 8)),
}
