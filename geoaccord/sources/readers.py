"""Readers of tabular and spatial files into DataFrames, each row with a ``feature_id`` (its position in the file).

Files are read by Spark (text, JSON, binary) and decoded on the executors, so any store that Spark reads will do.
Binary layouts are parsed with the standard library. :func:`read_metadata` never raises; what cannot be read comes
back with ``reader = 'fallback'`` and a warning.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
import re
import sqlite3
import struct
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaccord.functions.scalars import sheet_size
from geoaccord.sources import splitting

#: Fixed names: column names, lower-cased, that hold coordinates.
X_NAMES = ("x", "lon", "lng", "long", "longitude", "经度", "easting", "east", "coordx")
Y_NAMES = ("y", "lat", "latitude", "纬度", "northing", "north", "coordy")
#: Shape type codes of shapefiles.
SHAPE_TYPES = {0: "null", 1: "point", 3: "polyline", 5: "polygon", 8: "multipoint", 11: "point", 13: "polyline", 15: "polygon", 18: "multipoint", 21: "point", 23: "polyline", 25: "polygon", 28: "multipoint"}
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))])
METADATA = "path string, reader string, data_type string, extent array<double>, crs string, records long, fields array<string>, geometry_type string, warnings array<string>"
PREVIEW_ROWS = 5
#: Spark's names of the encodings that its CSV reader knows.
SPARK_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "latin-1": "ISO-8859-1"}
#: Records of shapes and tables that are decoded in one task.
RECORDS = 4096


def content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def present(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, by the file system of its path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _in_pieces(files: DataFrame, cut, decode, schema: T.StructType) -> DataFrame:
    """Rows of files whose records are cut apart in one task a file and decoded in many: ``cut`` makes (first number,
    bytes) of a file, ``decode`` rows of those."""

    def pieces(batches):
        for batch in batches:
            for raw in batch["content"]:
                for first, data in cut(bytes(raw)):
                    yield pd.DataFrame({"first": [first], "data": [data]})

    def rows(batches):
        for batch in batches:
            for first, data in zip(batch["first"], batch["data"]):
                yield pd.DataFrame(decode(int(first), bytes(data)), columns=schema.names, dtype=object)

    apart = files.select("content").mapInPandas(pieces, "first long, data binary").repartition(files.sparkSession.sparkContext.defaultParallelism)
    return apart.mapInPandas(rows, schema)


def part_of(spark: SparkSession, path: str, offset: int, n: int) -> bytes:
    """Up to ``n`` bytes of a file (of a folder: of its first file with content) from an offset, by the file system of its
    path; the rest is not read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.getFileStatus(target)
    if found.isDirectory():
        inside = [f for f in store.listStatus(target) if f.isFile() and f.getLen() and f.getPath().getName()[:1] not in "._"]
        if not inside:
            return b""
        found = min(inside, key=lambda f: f.getPath().getName())
        target = found.getPath()
    n = min(n, found.getLen() - offset)
    if n <= 0:
        return b""
    held = store.open(target)
    try:
        held.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(held, int(n)))
    finally:
        held.close()


def first_bytes(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    return part_of(spark, path, 0, n)


def decodes(raw: bytes, encoding: str) -> bool:
    """Whether bytes that may end inside a character decode."""
    try:
        codecs.getincrementaldecoder(encoding)().decode(raw)
        return True
    except UnicodeDecodeError:
        return False


def detect_encoding(head: bytes) -> str:
    """By byte-order mark, else the first of UTF-8 and GB 18030 that decodes, else Latin-1."""
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return "utf-16"
    return next((name for name in ("utf-8", "gb18030") if decodes(head, name)), "latin-1")


def file_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a text file by all of its bytes: by its byte-order mark, else the first of UTF-8 and GB 18030 that
    every line decodes as, else Latin-1. Lines are checked where they lie: no character of either holds a line feed."""
    named = detect_encoding(first_bytes(spark, path, 4))
    if named in ("utf-8-sig", "utf-16"):
        return named
    lines = spark.read.option("lineSep", "\n").text(path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return "utf-8"

    def wrong(batches):
        for batch in batches:
            yield batch[[not decodes(bytes(v), "gb18030") for v in batch["value"]]]

    bytes_of = lines.where(~F.is_valid_utf8("value")).select(F.col("value").cast("binary").alias("value"))
    return "gb18030" if bytes_of.mapInPandas(wrong, "value binary").isEmpty() else "latin-1"


def coordinate_columns(names: list[str]) -> tuple[str, str] | None:
    """The first x and the first y column by name."""
    pick = lambda known: next((n for n in names if n.strip().lower() in known), None)
    x, y = pick(X_NAMES), pick(Y_NAMES)
    return (x, y) if x is not None and y is not None else None


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """Text columns of a CSV with a header, in the encoding that all its lines have; short rows are padded with the empty
    text, blank lines are skipped. Quoted values may span lines (:func:`splitting.quoted_records` cuts a file in many tasks);
    without ``multi_line`` Spark's own reader takes the lines. A file in UTF-16 is one task."""
    encoding = encoding or file_encoding(spark, path)
    if multi_line and encoding != "utf-16":
        return _read_quoted(spark, path, encoding)
    if encoding not in SPARK_NAMES:
        return _read_decoded(spark, path, encoding)
    rows = spark.read.option("header", True).option("encoding", SPARK_NAMES[encoding]).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
    names = [n.lstrip("\ufeff").strip() for n in rows.columns]
    rows = rows.toDF(*names)
    some = F.lit(False)
    for n in names:
        some = some | (F.trim(F.col(f"`{n}`")) != "")
    return with_id(rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]).where(some))


def _csv_rows(text: str):
    return (row for row in csv.reader(io.StringIO(text, newline="")) if any(map(str.strip, row)))


#: Bytes of which a record without any value consists.
_BLANK = re.compile(rb'[\s,"]*')


def _read_quoted(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The rows of :func:`read_csv`; the first record of each file is its header."""
    blank = lambda raw: bool(_BLANK.fullmatch(raw)) and not any(True for _ in _csv_rows(raw.decode("ascii", "replace")))
    records = splitting.quoted_records(spark, path, blank)
    head, size = [], 1 << 16
    while not head and (raw := first_bytes(spark, path, size)):  # a header may be long
        found = list(_csv_rows(raw.decode(encoding, "replace").removeprefix("\ufeff")))
        head = found[:1] if len(found) > 1 or len(raw) < size else []
        size *= 4
    names = [n.strip() for n in head[0]] if head else []
    rows = records.where("within > 0").select((F.col("feature_id") - F.col("files")).alias("feature_id"), "text")
    columns = ["k", *(f"c{k}" for k in range(len(names)))]  # names of a file may be equal, or that of the number

    def decode(batches):
        for batch in batches:
            found = [next(_csv_rows(bytes(raw).decode(encoding, "replace")), []) for raw in batch["text"]]
            wide = [(row + [""] * len(names))[: len(names)] for row in found]
            yield pd.DataFrame([(k, *row) for k, row in zip(batch["feature_id"], wide)], columns=columns)

    return rows.mapInPandas(decode, ", ".join(["k long", *(f"{c} string" for c in columns[1:])])).toDF("feature_id", *names)


def _read_decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The rows of :func:`read_csv` for an encoding that Spark's reader does not know, with the same rules."""
    names = [n.strip() for n in next(_csv_rows(first_bytes(spark, path, 1 << 16).decode(encoding, "replace").removeprefix("\ufeff")), [])]

    def decode(files):
        for file in files:
            for raw in file["content"]:
                found = _csv_rows(bytes(raw).decode(encoding, "replace").removeprefix("\ufeff"))
                next(found, None)
                yield pd.DataFrame([(row + [""] * len(names))[: len(names)] for row in found], columns=names, dtype=object)

    return with_id(content(spark, path).select("content").mapInPandas(decode, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def with_id(df: DataFrame) -> DataFrame:
    """Rows numbered from 0 in the order of their partitions."""
    fixed = df.withColumn("_m", F.monotonically_increasing_id())
    counts = fixed.groupBy(F.shiftright("_m", 33).alias("p")).count().orderBy("p").collect()  # one row a partition
    starts, at = {}, 0
    for p, n in counts:
        starts[p] = at
        at += n
    begin = df.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_p long, _at long")
    placed = fixed.join(F.broadcast(begin), F.shiftright("_m", 33) == F.col("_p"))
    return placed.select((F.col("_at") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("feature_id"), *df.columns)


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the extent of the rows where both coordinates are numbers."""
    a, b = (F.col(c).try_cast("double") for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    return df.agg(*[f(F.when(both, v)).alias(n) for f, v, n in ((F.min, a, "xmin"), (F.min, b, "ymin"), (F.max, a, "xmax"), (F.max, b, "ymax"))])


_SHAPE = "type:string,coordinates:string"
_FEATURE = f"type string, geometry struct<{_SHAPE},geometries:array<struct<{_SHAPE}>>>, properties map<string,string>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, geometry_type, geometry, properties) of a FeatureCollection, cut at its features in many tasks, or of
    a single Feature."""
    found = splitting.features(spark, path).select("feature_id", F.col("text").cast("string").alias("value"))
    if found.isEmpty():
        whole = spark.read.option("wholetext", True).text(path).select(F.lit(0).cast("long").alias("feature_id"), "value")
        found = whole.where(F.get_json_object(F.regexp_replace("value", "^\ufeff", ""), "$.type") == "Feature").withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    rows = found.select("feature_id", F.from_json("value", _FEATURE).alias("f")).select("feature_id", "f.geometry", "f.properties")
    shape = F.col("geometry")
    inner = F.flatten(F.transform(F.coalesce(shape["geometries"], F.array()), _parts))
    parts = F.when(shape["type"] == "GeometryCollection", inner).otherwise(_parts(shape))
    return rows.select("feature_id", shape["type"].alias("geometry_type"), F.struct(F.lower(shape["type"]).alias("type"), parts.alias("parts")).alias("geometry"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def _parts(shape: Column) -> Column:
    """Coordinates of a geometry as parts of points, closing vertices kept, third values dropped."""
    given = lambda depth: F.coalesce(F.from_json(shape["coordinates"], "array<" * depth + "double" + ">" * depth), F.array())
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    points = lambda seq: F.transform(seq, point)
    kind = shape["type"]
    return (
        F.when((kind == "Point") & (F.size(given(1)) > 1), F.array(F.array(point(given(1)))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(points(given(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(given(3), points))
        .when(kind == "MultiPolygon", F.transform(F.flatten(given(4)), points))
        .otherwise(F.array())
    )


def geojson_fields(features: DataFrame) -> list[str]:
    """Property names in order of first appearance."""
    named = features.select("feature_id", F.posexplode(F.map_keys("properties")).alias("at", "name"))
    first = named.groupBy("name").agg(F.min(F.struct("feature_id", "at")).alias("o")).orderBy("o")
    return [r["name"] for r in first.collect()]


def geometry_types(features: DataFrame) -> list[str]:
    """Distinct geometry types in order of first appearance."""
    first = features.where("geometry_type is not null").groupBy("geometry_type").agg(F.min("feature_id").alias("o")).orderBy("o")
    return [r[0] for r in first.collect()]


def geometry_extent(features: DataFrame) -> DataFrame:
    """One row: the extent over the vertices of all features."""
    v = features.select(F.explode(F.flatten("geometry.parts")).alias("v"))
    return v.agg(F.min("v.x").alias("xmin"), F.min("v.y").alias("ymin"), F.max("v.x").alias("xmax"), F.max("v.y").alias("ymax"))


def shapefile_header(raw: bytes) -> dict:
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    return {"type": SHAPE_TYPES.get(struct.unpack("<i", raw[32:36])[0], "unknown"), "extent": list(struct.unpack("<4d", raw[36:68]))}


def shape_records(raw: bytes):
    """(number, record bytes) of a shapefile, RECORDS records at a time with their headers."""
    at, number, begin, first = 100, 0, 100, 0
    while at + 12 <= len(raw):
        at += 8 + struct.unpack(">i", raw[at + 4 : at + 8])[0] * 2
        number += 1
        if number - first == RECORDS:
            yield first, raw[begin:at]
            begin, first = at, number
    if number > first:
        yield first, raw[begin:at]


def shapes(records: bytes, number: int = 0):
    """(number, type, parts) of every record; null shapes keep their place."""
    at = 0
    points = lambda body, start, n: np.frombuffer(body, "<f8", 2 * n, start).reshape(-1, 2).tolist()
    while at + 12 <= len(records):
        size = struct.unpack(">i", records[at + 4 : at + 8])[0] * 2
        body = records[at + 8 : at + 8 + size]
        kind = SHAPE_TYPES.get(struct.unpack("<i", body[:4])[0], "unknown")
        parts: list = []
        if kind == "point":
            parts = [points(body, 4, 1)]
        elif kind == "multipoint":
            parts = [points(body, 40, struct.unpack("<i", body[36:40])[0])]
        elif kind in ("polyline", "polygon"):
            m, n = struct.unpack("<2i", body[36:44])
            begin = [*struct.unpack_from(f"<{m}i", body, 44), n]
            found = points(body, 44 + 4 * m, n)
            parts = [found[a:b] for a, b in zip(begin, begin[1:])]
        yield number, kind, [[{"x": x, "y": y} for x, y in p] for p in parts]
        at, number = at + 8 + size, number + 1


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, geometry) of a .shp file."""
    schema = T.StructType([T.StructField("feature_id", T.LongType()), T.StructField("geometry", GEOMETRY)])
    return _in_pieces(content(spark, path), shape_records, lambda first, data: [(n, {"type": k, "parts": p}) for n, k, p in shapes(data, first)], schema)


def dbf_header(raw: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header size, record size, fields) of a table."""
    records, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while at + 32 <= len(raw) and raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1").strip()
        fields.append((name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return records, head, size, fields


def dbf_value(kind: str, decimals: int, raw: bytes, encoding: str):
    if kind == "I":
        return struct.unpack("<i", raw[:4])[0]
    if kind == "B":
        return struct.unpack("<d", raw[:8])[0]
    text = raw.decode(encoding, "replace").strip().strip("\0")
    if kind in ("N", "F"):
        if not text or "*" in text or text == ".":
            return None
        try:
            return int(text) if decimals == 0 and kind == "N" else float(text)
        except ValueError:
            return None
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if re.fullmatch(r"\d{8}", text) else None
    if kind == "L":
        return text.upper() if text.upper() in ("T", "F", "Y", "N") else None
    return text


def dbf_type(kind: str, decimals: int) -> T.DataType:
    if kind == "N" and decimals == 0:
        return T.LongType()
    return {"N": T.DoubleType(), "F": T.DoubleType(), "B": T.DoubleType(), "I": T.IntegerType()}.get(kind, T.StringType())


def read_dbf(spark: SparkSession, path: str, encoding: str | None = None, keep_deleted: bool = True) -> DataFrame:
    """Typed rows of a .dbf table; the encoding is that of a .cpg file beside it, or is detected. A field that is called
    feature_id becomes feature_id_."""
    head = first_bytes(spark, path, 32 + 32 * 256)
    _, _, _, fields = dbf_header(head)
    if encoding is None:
        encoding = _code_page(spark, path) or _table_encoding(spark, path, dbf_header(head)[1])
    schema = T.StructType([T.StructField("feature_id", T.LongType()), *[T.StructField(n if n != "feature_id" else "feature_id_", dbf_type(k, d)) for n, k, _, d in fields]])

    def cut(raw: bytes):
        records, begin, size, _ = dbf_header(raw)
        for k in range(0, records, RECORDS):
            yield k, raw[begin + k * size : begin + min(records, k + RECORDS) * size]

    def decode(first: int, data: bytes) -> list[tuple]:
        size, rows = 1 + sum(width for _, _, width, _ in fields), []
        for k in range(len(data) // size):
            row = data[k * size : (k + 1) * size]
            if row[:1] == b"*" and not keep_deleted:
                continue
            at, values = 1, []
            for _, kind, width, decimals in fields:
                values.append(dbf_value(kind, decimals, row[at : at + width], encoding))
                at += width
            rows.append((first + k, *values))
        return rows

    return _in_pieces(content(spark, path), cut, decode, schema)


def _table_encoding(spark: SparkSession, path: str, begin: int) -> str:
    """The encoding that all records of a table have, told where the file is read."""

    def told(batches):
        for batch in batches:
            yield pd.DataFrame({"encoding": [detect_encoding(bytes(raw)[begin:]) for raw in batch["content"]]})

    return content(spark, path).select("content").mapInPandas(told, "encoding string").first()[0]


def _code_page(spark: SparkSession, path: str) -> str | None:
    try:
        text = first_bytes(spark, re.sub(r"\.\w+$", ".cpg", path), 64).decode("ascii", "ignore").strip().lower()
        return codecs.lookup({"65001": "utf-8", "936": "gbk"}.get(text, text)).name if text else None
    except Exception:
        return None


def read_shapefile(spark: SparkSession, path: str, **options) -> DataFrame:
    """Geometry and attributes of a shapefile, joined by record number: null shapes and rows stay aligned. Many tasks read
    ranges of the file where its index is there and pyarrow knows its store."""
    if not set(options) - {"encoding"} and _by_ranges(spark, path):
        return _ranges_of(spark, path, True, **options)
    table = read_dbf(spark, re.sub(r"\.shp$", ".dbf", path, flags=re.I), **options)
    return read_shapes(spark, path).join(table, "feature_id", "left")


def _by_ranges(spark: SparkSession, path: str) -> bool:
    from geoaccord.sources import ranges

    stem = re.sub(r"\.shp$", "", path, flags=re.I)
    try:
        if not all(present(spark, stem + s) for s in (".shx", ".dbf")):
            return False
        for name in (path, f"{stem}.shx", f"{stem}.dbf"):
            ranges.opened(name).close()
        return True
    except Exception:  # a store that only Spark knows
        return False


def _ranges_of(spark: SparkSession, path: str, geometry: bool, encoding: str | None = None) -> DataFrame:
    """(feature_id, geometry if asked for, fields) of a shapefile by ranges; columns are called as in :func:`read_dbf`."""
    from geoaccord.sources import ranges

    fields = dbf_header(first_bytes(spark, re.sub(r"\.shp$", ".dbf", path, flags=re.I), 32 + 32 * 256))[3]
    first = ["feature_id", "geometry"] if geometry else ["feature_id"]
    got = ranges.read_shapefile(spark, path, [*first, *ranges.named_fields(fields)], encoding=encoding)
    return got.toDF(*first, *[n if n != "feature_id" else "feature_id_" for n, *_ in fields])


#: Fixed names: fields that may hold categories, whole or in part.
CATEGORY_NAMES = ("gridcode", "class", "class_id", "category", "category_id", "type", "code", "landcover")
CATEGORY_PARTS = ("class", "categor", "gridcode", "landcover")
LISTED_VALUES = 100


def check_shapefile(spark: SparkSession, path: str) -> dict:
    """What a geometry analysis asks of a shapefile: its files, counts over all shapes (null, empty, invalid), whether all
    are polygons, category fields by name, and the first LISTED_VALUES values of each with their number."""
    from geoaccord.operators import layers

    stem = re.sub(r"\.shp$", "", path, flags=re.I)
    missing = [s for s in (".shp", ".shx", ".dbf", ".prj") if not present(spark, stem + s)]
    out = {"missing_files": missing, "records": 0, "null": 0, "empty": 0, "invalid": 0, "polygons": False, "categories": [], "values": [], "counts": {}, "warnings": [f"no {s} file" for s in missing]}
    if ".shp" in missing or ".dbf" in missing:
        return out
    if _by_ranges(spark, path):
        shapes_of, table = _ranges_of(spark, path, True).select("feature_id", "geometry"), _ranges_of(spark, path, False)
    else:
        shapes_of, table = read_shapes(spark, path), read_dbf(spark, f"{stem}.dbf")
    measured = layers.measured(shapes_of.withColumn("category", F.lit("")), "category")
    counts = layers.quality(measured).first()
    kinds = {r[0] for r in shapes_of.select("geometry.type").distinct().collect()} - {"null"}
    out |= {"records": counts["input"], "null": counts["null_shapes"], "empty": counts["empty_shapes"], "invalid": counts["invalid_shapes"], "polygons": kinds == {"polygon"}}
    out["categories"] = [n for n in table.columns[1:] if n.lower() in CATEGORY_NAMES or any(p in n.lower() for p in CATEGORY_PARTS)]
    for name in out["categories"]:
        found = table.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).agg(F.min("feature_id").alias("at"))
        out["counts"][name] = found.count()
        out["values"] += [(name, r["v"]) for r in found.orderBy("at").limit(LISTED_VALUES).collect()]
    out["warnings"] += [] if out["polygons"] else ["not all shapes are polygons"]
    out["warnings"] += [f"{counts[f'{s}_shapes']} {s} shapes" for s in ("null", "empty", "invalid") if counts[f"{s}_shapes"]]
    return out


def projection_name(text: str) -> str | None:
    """The name of the first reference system of a .prj text."""
    m = re.search(r'(?:PROJCS|GEOGCS|GEOCCS)\s*\[\s*"([^"]+)"', text or "")
    return m.group(1) if m else None


def read_geopackage(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Attribute rows of a feature table (the first by default), all columns but the geometry as text."""
    meta = _geopackage(bytes(content(spark, path).first()["content"]), table)
    names, name = meta["fields"], meta["table"]

    def parse(batches):
        for batch in batches:
            for raw in batch["content"]:
                with _sqlite(bytes(raw)) as db:
                    found = db.execute(f"select {', '.join(_quoted(n) for n in names)} from {_quoted(name)}")
                    while rows := found.fetchmany(10_000):
                        parse.at = getattr(parse, "at", 0)
                        yield pd.DataFrame([(parse.at + k, *(None if v is None else str(v) for v in r)) for k, r in enumerate(rows)], columns=["feature_id", *names])
                        parse.at += len(rows)

    schema = T.StructType([T.StructField("feature_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    return content(spark, path).select("content").mapInPandas(parse, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _sqlite:
    """A database opened from bytes."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __enter__(self):
        self.db = sqlite3.connect(":memory:")
        self.db.deserialize(self.raw)
        return self.db

    def __exit__(self, *_):
        self.db.close()


def _geopackage(raw: bytes, table: str | None = None) -> dict:
    with _sqlite(raw) as db:
        rows = db.execute("select table_name, min_x, min_y, max_x, max_y, srs_id from gpkg_contents where data_type = 'features' order by rowid").fetchall()
        row = next((r for r in rows if table in (None, r[0])), None)
        if row is None:
            raise ValueError("no feature table")
        column, kind = db.execute("select column_name, geometry_type_name from gpkg_geometry_columns where table_name = ?", (row[0],)).fetchone()
        srs = db.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (row[5],)).fetchone()
        fields = [r[1] for r in db.execute(f"pragma table_info({_quoted(row[0])})") if r[1] != column]
        count = db.execute(f"select count(*) from {_quoted(row[0])}").fetchone()[0]
    return {"table": row[0], "extent": list(row[1:5]), "crs": f"{srs[0]}:{srs[1]}" if srs else None, "geometry_type": kind, "fields": fields, "records": count}


def ascii_header(text: str) -> dict:
    """Header of an ASCII grid; centre registration is moved to the corner."""
    fields = {}
    for line in text.splitlines()[:6]:
        parts = line.split()
        if len(parts) == 2 and not re.match(r"^[-+\d.]", parts[0]):
            fields[parts[0].lower()] = float(parts[1])
    size = fields["cellsize"]
    x = fields["xllcorner"] if "xllcorner" in fields else fields["xllcenter"] - size / 2
    y = fields["yllcorner"] if "yllcorner" in fields else fields["yllcenter"] - size / 2
    cols, rows = int(fields["ncols"]), int(fields["nrows"])
    return {"cols": cols, "rows": rows, "cellsize": size, "nodata": fields.get("nodata_value"), "lines": len(fields), "extent": [x, y, x + cols * size, y + rows * size]}


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, value) of an ASCII grid, row 0 at the top, no-data cells null."""
    head = ascii_header(first_bytes(spark, path, 1 << 16).decode("ascii", "replace"))
    lines = with_id(spark.read.text(path)).where(F.col("feature_id") >= head["lines"])
    cells = lines.select((F.col("feature_id") - head["lines"]).cast("int").alias("r"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "v"))
    value = F.col("v").try_cast("double")
    return cells.select("r", "c", (F.when(value == head["nodata"], None).otherwise(value) if head["nodata"] is not None else value).alias("value"))


def sheet_dimension(raw: bytes) -> tuple[int, int] | None:
    """Rows and columns of the first sheet of a workbook, from its dimension tag."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        name = sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        m = re.search(rb'<dimension[^>]*ref="([^"]+)"', book.read(name))
    return sheet_size(m.group(1).decode()) if m else None


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Text rows of the first sheet of a workbook; its first row holds the names."""
    names = [n for n in next(_sheet_rows(bytes(content(spark, path).first()["content"])), [])]

    def parse(batches):
        for batch in batches:
            for raw in batch["content"]:
                rows = list(_sheet_rows(bytes(raw)))[1:]
                yield pd.DataFrame([(k, *(r[i] if i < len(r) else None for i in range(len(names)))) for k, r in enumerate(rows)], columns=["feature_id", *names])

    schema = T.StructType([T.StructField("feature_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    return content(spark, path).select("content").mapInPandas(parse, schema)


def _sheet_rows(raw: bytes):
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        name = sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        for row in ElementTree.fromstring(book.read(name)).iter(f"{space}row"):
            out: list = []
            for cell in row.iter(f"{space}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", "A")).group()
                at = sheet_size(f"A1:{letters}1")[1] - 1
                value = cell.find(f"{space}v")
                text = "".join(t.text or "" for t in cell.iter(f"{space}t")) if cell.get("t") == "inlineStr" else (value.text if value is not None else None)
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                out += [None] * (at + 1 - len(out))
                out[at] = text
            yield out


READERS = {".csv": "csv", ".geojson": "geojson", ".json": "geojson", ".xlsx": "xlsx", ".shp": "shapefile", ".gpkg": "geopackage", ".tif": "tiff", ".tiff": "tiff", ".asc": "ascii"}
#: Formats that are known but cannot be read here.
REFUSED = {".xls": "old workbooks", ".img": "image rasters"}


def load(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Attribute rows of a file by its suffix; ``limit`` keeps the first rows."""
    kind = READERS.get(os.path.splitext(path)[1].lower())
    readers = {"csv": read_csv, "geojson": read_geojson, "xlsx": read_xlsx, "shapefile": read_shapefile, "geopackage": read_geopackage, "ascii": read_ascii_grid}
    if kind not in readers:
        raise ValueError(f"no reader for {path}")
    rows = readers[kind](spark, path)
    return rows.limit(limit) if limit else rows


def _named_crs(head: str) -> str | None:
    """The name in a collection's member ``crs``, which stands before its features."""
    m = re.search(r'"crs"\s*:\s*(?=\{)', head)
    try:
        return (json.JSONDecoder().raw_decode(head, m.end())[0].get("properties") or {}).get("name") if m else None
    except ValueError:
        return None


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata of a file; failures become a fallback row with a warning."""
    suffix = os.path.splitext(path)[1].lower()
    row = {"path": path, "reader": "fallback", "data_type": None, "extent": None, "crs": None, "records": None, "fields": [], "geometry_type": None, "warnings": []}
    try:
        if suffix in REFUSED:
            row["warnings"] = [f"{REFUSED[suffix]} need another program"]
        elif suffix not in READERS:
            row["warnings"] = [f"unknown format {suffix}"]
        else:
            row |= {"reader": READERS[suffix]} | _metadata(spark, path, READERS[suffix])
    except Exception as e:
        row |= {"reader": "fallback", "warnings": [f"{type(e).__name__}: {str(e)[:200]}"]}
    row["extent"] = None if row["extent"] is None else [float(v) for v in row["extent"]]
    return spark.createDataFrame([tuple(row.values())], METADATA)


def _metadata(spark: SparkSession, path: str, kind: str) -> dict:
    listed = lambda box: list(box) if box and box[0] is not None else None
    if kind == "csv":
        rows = read_csv(spark, path)
        names = rows.columns[1:]
        at = coordinate_columns(names)
        out = {"data_type": "attribute", "records": rows.count(), "fields": names}
        return out | ({"extent": listed(extent(rows, *at).first()), "crs": "WGS 84 (inferred)", "geometry_type": "point"} if at else {})
    if kind == "geojson":
        rows = read_geojson(spark, path)
        crs = _named_crs(first_bytes(spark, path, 1 << 16).decode("utf-8", "replace"))
        return {"data_type": "geometry", "records": rows.count(), "fields": geojson_fields(rows), "geometry_type": ", ".join(geometry_types(rows)), "extent": listed(geometry_extent(rows).first()), "crs": crs or "WGS 84"}
    if kind == "xlsx":
        size = sheet_dimension(bytes(content(spark, path).first()["content"]))
        names = read_xlsx(spark, path).columns[1:]
        return {"data_type": "attribute", "records": size[0] - 1 if size else None, "fields": names}
    if kind == "shapefile":
        head = shapefile_header(first_bytes(spark, path, 100))
        table = dbf_header(first_bytes(spark, re.sub(r"\.shp$", ".dbf", path, flags=re.I), 32 + 32 * 256))
        try:
            crs = projection_name(first_bytes(spark, re.sub(r"\.shp$", ".prj", path, flags=re.I), 1 << 14).decode("utf-8", "replace"))
        except Exception:
            crs = None
        return {"data_type": "geometry", "records": table[0], "fields": [f[0] for f in table[3]], "geometry_type": head["type"], "extent": head["extent"], "crs": crs}
    if kind == "geopackage":
        found = _geopackage(bytes(content(spark, path).first()["content"]))
        return {k: found[k] for k in ("records", "fields", "geometry_type", "extent", "crs")} | {"data_type": "geometry"}
    if kind == "tiff":
        from geoaccord.sources import tiff

        head = tiff.read_info(spark, path)
        return {"data_type": "raster", "records": head["width"] * head["height"], "fields": [f"band_{k + 1}" for k in range(head["bands"])], "extent": head["extent"], "crs": f"EPSG:{head['epsg']}" if head["epsg"] else None}
    head = ascii_header(first_bytes(spark, path, 1 << 16).decode("ascii", "replace"))
    return {"data_type": "raster", "records": head["cols"] * head["rows"], "fields": ["band_1"], "extent": head["extent"]}
