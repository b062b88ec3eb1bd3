"""Shapefiles and TIFF rasters as data sources that Spark splits and prunes.

A file is cut by its own index: a partition is a range of records of a shapefile (places from its .shx, rows of its table by
their fixed size) or some strips or tiles of a raster. Conditions are met before the costly part is read: those on record
numbers, rows and columns drop partitions, those on attributes drop records before their shapes are read, those on boxes
before their vertices are decoded. Only named columns are decoded. Files are opened by pyarrow's file systems, from each
executor, a range at a time; for a store that only Spark knows there are :func:`readers.read_shapefile` and
:func:`tiff.read_tiff`.

Conditions are arguments of the read. Spark 4.1 keeps the filters that a Python source took with the loaded table, so a
DataFrame used under two filters would give the rows of one for both; ``pushFilters`` is left alone for that reason, and
filters above the scan are Spark's.

Cases: null shapes have no box; records without a row in the table have null attributes, rows without a record are ignored;
a field whose name is taken gets underscores behind it; an empty file gives no row; a shapefile without .shx raises.
"""

from __future__ import annotations

import json
import operator
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoaccord.sources import readers, tiff

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Bytes between two wanted records that are read along, and the most that are read at once (but for a larger record).
GAP, SPAN = 1 << 16, 1 << 24
#: Bytes of the blocks of a raster that are a partition.
BLOCKS = 1 << 22
_ORDER = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
NULLS = ("is null", "is not null")
OPERATORS = (*_ORDER, "in", *NULLS)
_POINTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def opened(path: str):
    """A file of random access; plain paths are local ones."""
    where = re.sub(r"^file:/+", "/", path)
    store, inside = pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), where)
    return store.open_input_file(inside)


def _key(value):
    """Orders values as Spark does: NaN equals itself and is the greatest number."""
    return (value != value, 0 if value != value else value)


class Condition:
    """A condition (column, one of OPERATORS, value) on one column; one with null, on either side, does not hold."""

    def __init__(self, column: str, sign: str, value=None):
        if sign not in OPERATORS:
            raise ValueError(f"{sign} is none of {OPERATORS}")
        self.column, self.sign, self.value = column, sign, value
        self.keys = {_key(v) for v in value if v is not None} if sign == "in" else None

    def values(self) -> list:
        return [] if self.sign in NULLS else [v for v in (self.value if self.sign == "in" else [self.value]) if v is not None]

    def holds(self, value) -> bool:
        if self.sign in NULLS:
            return (value is None) == (self.sign == NULLS[0])
        if value is None or self.value is None:
            return False
        return _key(value) in self.keys if self.sign == "in" else _ORDER[self.sign](_key(value), _key(self.value))

    def meets(self, low: int, high: int) -> bool:
        """Whether a whole number from ``low`` up to ``high`` may fulfil the condition."""
        if self.sign == "in":
            return any(low <= v <= high for _, v in self.keys)
        if self.sign == "=" and self.value is not None:
            return low <= self.value <= high
        return self.holds(high if self.sign in (">", ">=") else low)


def conditions(given, kinds: dict[str, str]) -> list[Condition]:
    """Conditions on columns of ``kinds`` (column: simple type); unknown columns and values of another kind raise."""
    out = [Condition(*c) for c in given]
    for c in out:
        if c.column not in kinds:
            raise ValueError(f"no column {c.column} for a condition")
        if any(isinstance(v, bool) or isinstance(v, str) != (kinds[c.column] == "string") for v in c.values()):
            raise ValueError(f"{c.column} is {kinds[c.column]}, not what its condition holds")
    return out


@dataclass
class Range(InputPartition):
    first: int
    behind: int


class _Pruned(DataSourceReader):
    conditions: list[Condition]

    def meets(self, column: str, low: int, high: int) -> bool:
        return all(c.meets(low, high) for c in self.conditions if c.column == column)


class Shapefile(DataSource):
    """Records of a shapefile. Options: ``path`` of the .shp, ``encoding`` of its table, ``columns`` (JSON, those to read, in
    order; without it all), ``where`` (JSON, conditions on any column but the geometry), ``records`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_ranges"

    def _whole(self) -> dict[str, T.DataType]:
        with opened(table_path(self.options["path"])) as file:
            fields = named_fields(readers.dbf_header(file.read(32 + 32 * 256))[3])
        return {"feature_id": T.LongType(), "geometry": readers.GEOMETRY, **{b: T.DoubleType() for b in BOX}, **{n: readers.dbf_type(k, d) for n, (_, _, k, d) in fields.items()}}

    def schema(self) -> T.StructType:
        whole = self._whole()
        asked = json.loads(self.options["columns"]) if "columns" in self.options else list(whole)
        if unknown := [n for n in asked if n not in whole]:
            raise ValueError(f"no columns {unknown}")
        return T.StructType([T.StructField(n, whole[n]) for n in asked])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kinds = {n: t.simpleString() for n, t in self._whole().items() if n != "geometry"}
        return ShapefileReader(schema, dict(self.options), conditions(json.loads(self.options.get("where", "[]")), kinds))


def table_path(path: str) -> str:
    return re.sub(r"\.shp$", ".dbf", path, flags=re.I)


def named_fields(fields) -> dict:
    """Column: (place in the row, width, kind, decimals) of the fields of a table."""
    out, taken, at = {}, {"feature_id", "geometry", *BOX}, 1
    for name, kind, width, decimals in fields:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out[name] = (at, width, kind, decimals)
        at += width
    return out


def spans(places: np.ndarray, sizes: np.ndarray):
    """(a, b): runs of wanted records, by their order in the file, that are read at once."""
    a = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or not 0 <= places[k] - places[k - 1] - sizes[k - 1] <= GAP or places[k] + sizes[k] - places[a] > SPAN:
            if k > a:
                yield a, k
            a = k


def record_box(body: bytes) -> tuple | None:
    """The box that a record states: four numbers, twice those of a point; none of a null shape."""
    kind = readers.SHAPE_TYPES.get(struct.unpack_from("<i", body)[0])
    if kind == "point":
        return struct.unpack_from("<2d", body, 4) * 2
    return struct.unpack_from("<4d", body, 4) if kind in ("multipoint", "polyline", "polygon") else None


class ShapefileReader(_Pruned):
    def __init__(self, schema: T.StructType, options: dict, where: list[Condition]):
        self.fields, self.options, self.conditions = [(f.name, f.dataType.simpleString()) for f in schema.fields], options, where

    def partitions(self) -> list[Range]:
        with opened(re.sub(r"\.shp$", ".shx", self.options["path"], flags=re.I)) as file:
            many = max(0, (file.size() - 100) // 8)
        step = int(self.options.get("records", readers.RECORDS))
        kept = [Range(k, min(many, k + step)) for k in range(0, many, step) if self.meets("feature_id", k, min(many, k + step) - 1)]
        return kept or [Range(0, 0)]  # Spark asks for one partition at least

    def _rows(self, part: Range) -> tuple[dict, np.ndarray]:
        """(attributes by column, numbers) of the records of a range whose numbers and attributes fulfil the conditions."""
        with opened(table_path(self.options["path"])) as file:
            records, head, size, fields = readers.dbf_header(file.read(32 + 32 * 256))
            behind = max(part.first, min(part.behind, records))
            file.seek(head + part.first * size)
            raw = file.read((behind - part.first) * size)
        of, encoding = named_fields(fields), self.options.get("encoding", "utf-8")

        def value(name: str, number: int):
            at, width, kind, decimals = of[name]
            start = (number - part.first) * size + at
            return readers.dbf_value(kind, decimals, raw[start : start + width], encoding) if start + width <= len(raw) else None

        kept = range(part.first, part.behind)
        for c in self.conditions:
            if c.column == "feature_id":
                kept = [n for n in kept if c.holds(n)]
            elif c.column not in BOX:
                kept = [n for n in kept if c.holds(value(c.column, n))]
        return {n: [value(n, k) for k in kept] for n, _ in self.fields if n in of}, np.array(kept, np.int64)

    def _shapes(self, part: Range, numbers: np.ndarray):
        """(places among ``numbers``, boxes, geometries) of those whose boxes fulfil the conditions, a span at a time."""
        path, tests = self.options["path"], [(BOX.index(c.column), c) for c in self.conditions if c.column in BOX]
        wanted = any(n == "geometry" for n, _ in self.fields)
        with opened(re.sub(r"\.shp$", ".shx", path, flags=re.I)) as file:
            file.seek(100 + 8 * part.first)
            index = np.frombuffer(file.read(8 * (part.behind - part.first)), ">i4").reshape(-1, 2)[numbers - part.first].astype(np.int64) * 2
        places, sizes = index[:, 0], index[:, 1] + 8
        with opened(path) as file:
            for a, b in spans(places, sizes):
                file.seek(int(places[a]))
                raw, held, boxes, shapes = file.read(int(places[b - 1] + sizes[b - 1] - places[a])), [], [], []
                for k in range(a, b):
                    start = int(places[k] - places[a])
                    record = raw[start : start + int(sizes[k])]
                    box = record_box(record[8:])
                    if all(c.holds(box[at] if box else None) for at, c in tests):
                        held.append(k)
                        boxes.append(box or (None,) * 4)
                        if wanted:
                            shapes += [{"type": kind, "parts": parts} for _, kind, parts in readers.shapes(record)]
                yield held, boxes, shapes

    def read(self, part: Range):
        attributes, numbers = self._rows(part)
        if not len(numbers):
            return
        needs = any(n == "geometry" or n in BOX for n in [*(n for n, _ in self.fields), *(c.column for c in self.conditions)])
        for held, boxes, shapes in self._shapes(part, numbers) if needs else [(range(len(numbers)), [], [])]:
            columns = []
            for name, kind in self.fields:
                if name == "geometry":
                    columns.append(pa.array(shapes, pa.struct([("type", pa.string()), ("parts", _POINTS)])))
                else:
                    cells = [b[BOX.index(name)] for b in boxes] if name in BOX else [int(numbers[k]) if name == "feature_id" else attributes[name][k] for k in held]
                    columns.append(pa.array(cells, _ARROW[kind]))
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in self.fields])


class Raster(DataSource):
    """Cells (r, c, value) of a band of a TIFF. Options: ``path``, ``band``, ``level`` (an overview), ``where`` (JSON,
    conditions on r and c)."""

    @classmethod
    def name(cls) -> str:
        return "tiff_ranges"

    def schema(self) -> str:
        return "r int, c int, value double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        where = conditions(json.loads(self.options.get("where", "[]")), {"r": "int", "c": "int"})
        return RasterReader(self.options["path"], int(self.options.get("band", 1)), where, int(self.options.get("level", 0)))


@dataclass
class Blocks(InputPartition):
    numbers: list


class RasterReader(_Pruned):
    def __init__(self, path: str, band: int, where: list[Condition], level: int = 0):
        self.path, self.band, self.conditions, self.level = path, band, where, level

    def _layout(self, file):
        def read(offset: int, n: int) -> bytes:
            file.seek(offset)
            return file.read(n)

        return tiff.layout(tiff.directory(read, self.level), self.band), tiff.info(read)["nodata"], read

    def partitions(self) -> list[Blocks]:
        with opened(self.path) as file:
            plan, _, _ = self._layout(file)
        out, room = [], 0
        for k, (_, size) in enumerate(plan.places):
            r, c, rows, columns = plan.window(k)
            if self.meets("r", r, r + rows - 1) and self.meets("c", c, c + columns - 1):
                if not out or room + size > BLOCKS:
                    out.append(Blocks([]))
                    room = 0
                out[-1].numbers.append(k)
                room += size
        return out or [Blocks([])]

    def read(self, part: Blocks):
        with opened(self.path) as file:
            plan, nodata, read = self._layout(file)
            for k in part.numbers:
                r, c, rows, columns = plan.window(k)
                cells = plan.cells(k, read(*plan.places[k])).astype(float)
                row, column = np.arange(r, r + rows), np.arange(c, c + columns)
                on = [np.array([all(t.holds(int(v)) for t in self.conditions if t.column == name) for v in axis], bool) for name, axis in (("r", row), ("c", column))]
                value = cells[np.ix_(*on)].ravel()
                row, column = np.repeat(row[on[0]], on[1].sum()), np.tile(column[on[1]], on[0].sum())
                none = ~np.isfinite(value) | (value == (np.nan if nodata is None else nodata))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(value, pa.float64(), mask=none)], names=["r", "c", "value"])


def _session(spark: SparkSession) -> SparkSession:
    for source in (Shapefile, Raster):
        spark.dataSource.register(source)
    return spark


def read_shapefile(spark: SparkSession, path: str, columns: list[str] | None = None, where: list[tuple] = (), encoding: str | None = None, records: int | None = None) -> DataFrame:
    """(feature_id, geometry, box, fields), or the named columns, of the records of a shapefile that fulfil all conditions
    ``where`` (column, operator, value), ``records`` of the file a partition. The encoding of its table is that of its .cpg,
    else it is told by the whole table."""
    stem = re.sub(r"\.shp$", "", path, flags=re.I)
    if not readers.present(spark, f"{stem}.shx"):
        raise ValueError(f"{stem}.shx is missing; readers.read_shapefile reads the file without it")
    table = f"{stem}.dbf"
    encoding = encoding or readers._code_page(spark, table) or readers._table_encoding(spark, table, readers.dbf_header(readers.first_bytes(spark, table, 32 + 32 * 256))[1])
    scan = _session(spark).read.format("shapefile_ranges").option("encoding", encoding).option("where", json.dumps([list(c) for c in where])).option("records", records or readers.RECORDS)
    return (scan.option("columns", json.dumps(columns)) if columns else scan).load(path)


def category_condition(field: str, kind: str, values: list) -> tuple:
    """The condition that a field of a simple type holds one of some categories: numbers for fields of numbers, whatever
    way they are written; what is no number is in none of these."""
    if kind == "string":
        return field, "in", [str(v) for v in values]
    numbers = []
    for v in values:
        try:
            numbers.append(float(v))
        except (TypeError, ValueError):
            pass
    return field, "in", numbers


def read_categories(spark: SparkSession, path: str, field: str, values: list, limit: int | None = None, **options) -> DataFrame:
    """(feature_id, geometry, category) of the records of a shapefile in some categories, or of the first ``limit`` of
    them; no other record's shape is read."""
    kinds = dict(read_shapefile(spark, path, **options).dtypes)
    if field not in kinds or field in ("geometry", *BOX):
        raise ValueError(f"there is no category field {field}")
    found = read_shapefile(spark, path, ["feature_id", "geometry", field], [category_condition(field, kinds[field], values)], **options).withColumnRenamed(field, "category")
    return found.orderBy("feature_id").limit(limit) if limit else found


def read_tiff(spark: SparkSession, path: str, band: int = 1, where: list[tuple] = (), level: int = 0) -> DataFrame:
    """(r, c, value) of a band, or of its overview ``level``, row 0 at the top, no-data and non-finite cells null; only the
    strips or tiles that meet the conditions ``where`` on r and c are read."""
    return _session(spark).read.format("tiff_ranges").option("band", band).option("level", level).option("where", json.dumps([list(c) for c in where])).load(path)
