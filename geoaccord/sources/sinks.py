"""Sinks: tables, JSON results, reports, and the catalog and run registry of a project."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaccord.functions.scalars import full_width_commas
from geoaccord.scratch import discard, drop, scratch_path, spread, written

CATALOG = "name string, data_type string, path string, extent string, crs string, status string, records string, fields array<string>, geometry_type string, warnings array<string>, reader string"
RUNS = "run_id string, title string, analysis string, result string, created string"


#: The mark that spreadsheets look for at the head of UTF-8 text.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV parts with a header, each with a byte-order mark before it; Spark writes them in parallel."""
    named = df.toDF(*[BYTE_ORDER_MARK + c if mark and k == 0 else c for k, c in enumerate(df.columns)])
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_bytes(spark: SparkSession, path: str, data: bytes, block: int = 1 << 22) -> None:
    """One file of the driver's bytes, by the file system of its path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for k in range(0, len(data), block):
            out.write(bytearray(data[k : k + block]))
    finally:
        out.close()


def write_joined(pieces: DataFrame, path: str, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of pieces (piece, data) in the order of their numbers, between ``head`` and ``tail``. Executors write the
    pieces of a task to a file; the driver has a row a piece and copies bytes from stream to stream. The part files need a
    store that pyarrow knows."""
    spark, folder = pieces.sparkSession, scratch_path(pieces.sparkSession, "pieces")

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        out, at, rows, name = None, 0, [], f"{folder}/{uuid.uuid4().hex}"
        for batch in batches:
            for number, data in zip(batch["piece"].to_pylist(), batch["data"]):
                if out is None:  # a name of its own, so that a task that runs twice harms nothing
                    store, place = pafs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(place)
                held = data.as_buffer()
                out.write(held)
                rows.append((number, name, at, held.size))
                at += held.size
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["piece", "file", "at", "size"])

    found = pieces.select(F.col("piece").cast("long").alias("piece"), "data").mapInArrow(write, "piece long, file string, at long, size long").collect()  # a row a piece
    runs: list[list] = []
    for row in sorted(found):
        if runs and runs[-1][0] == row["file"] and runs[-1][1] + runs[-1][2] == row["at"]:
            runs[-1][2] += row["size"]
        else:
            runs.append([row["file"], row["at"], row["size"]])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(head))
        for file, at, size in runs:
            place = jvm.org.apache.hadoop.fs.Path(file)
            part = place.getFileSystem(conf).open(place)
            try:
                part.seek(at)
                jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, size)
            finally:
                part.close()
        if tail:
            out.write(bytearray(tail))
    finally:
        out.close()
    discard(folder)


#: Records of a shapefile, and cells of a raster, that a piece has (a raster's piece has 16 rows at least).
RECORDS, CELLS = 4096, 1 << 16


def write_shapefile(df: DataFrame, path: str, fields: list[str], rings: str = "rings", projection: str | None = None) -> None:
    """One shapefile of polygons with its index, table, code page and projection, rows as they come. The format holds
    2 GB at most; executors encode its records in pieces (:func:`write_joined`). Layers of any size go to
    :func:`write_table`."""
    import pyarrow as pa

    from geoaccord.sources import shapefile

    spark, stem = df.sparkSession, path.removesuffix(".shp")
    names = [f"f{k}" for k in range(len(fields))]
    rows = written(df.select(F.col(rings).alias("rings"), *[F.col(f).alias(n) for f, n in zip(fields, names)], F.monotonically_increasing_id().alias("m")), "records")
    part = F.shiftright("m", 33)
    starts, many = {}, 0
    for p, n in rows.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a partition
        starts[p], many = many, many + n
    begin = spark.createDataFrame(list(starts.items()) or [(0, 0)], "p long, b long")
    rows = rows.join(F.broadcast(begin), part == F.col("p")).withColumn("n", F.col("b") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("piece", F.floor(F.col("n") / RECORDS))

    def shapes(table: pa.Table) -> pa.Table:
        held = table.sort_by("n")
        body, lengths, box = shapefile.encode_records(held["rings"].to_pylist(), held["n"][0].as_py() + 1)
        kinds = [shapefile.column_kind(held[c].to_pylist()) for c in names]
        return pa.table({"piece": [held["piece"][0].as_py()], "data": [body], "lengths": pa.array([lengths], pa.list_(pa.int32())), "box": [box], "kinds": [json.dumps(kinds)]})

    made = written(spread(rows, "piece").groupBy("piece").applyInArrow(shapes, "piece long, data binary, lengths array<int>, box array<double>, kinds string"), "shapes")
    told = made.select("piece", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, v: s + v + 4).alias("words"), "box", "kinds").orderBy("piece").collect()  # a row a piece
    places, words = {}, 50
    for t in told:
        places[t["piece"]] = words
        words += t["words"]
    box = [f([t["box"][k] for t in told], default=d) for k, (f, d) in enumerate(((min, math.inf), (min, math.inf), (max, -math.inf), (max, -math.inf)))]
    of = shapefile.table_fields(fields, [shapefile.joined_kinds(list(k)) for k in zip(*(json.loads(t["kinds"]) for t in told))] if told else [shapefile.column_kind([])] * len(fields))

    def index(batches):
        for batch in batches:
            numbers = batch["piece"].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([shapefile.encode_index(v, places[k]) for k, v in zip(numbers, batch["lengths"].to_pylist())], pa.binary())], names=["piece", "data"])

    def table(given: pa.Table) -> pa.Table:
        held = given.sort_by("n")
        data = shapefile.table_rows(of, list(zip(*(held[c].to_pylist() for c in names))) if names else [()] * len(held))
        return pa.table({"piece": [held["piece"][0].as_py()], "data": [data]})

    write_joined(made.select("piece", "data"), f"{stem}.shp", shapefile.head(words, box))
    write_joined(made.select("piece", "lengths").mapInArrow(index, "piece long, data binary"), f"{stem}.shx", shapefile.head(50 + 4 * many, box))
    write_joined(spread(rows.select("piece", "n", *names), "piece").groupBy("piece").applyInArrow(table, "piece long, data binary"), f"{stem}.dbf", shapefile.table_head(of, many), shapefile.TABLE_END)
    for suffix, data in ({".cpg": b"UTF-8"} | ({".prj": projection.encode()} if projection else {})).items():
        write_bytes(spark, stem + suffix, data)
    drop(made, rows)


def _strips(cells: DataFrame, value: str, width: int, height: int, high: int, encode) -> DataFrame:
    """(piece, data): ``encode`` of the grid of each ``high`` rows of a raster (r, c, ``value``), written; cells that it lacks
    are NaN, those outside raise."""
    import numpy as np
    import pandas as pd

    v = F.col(value).cast("double")
    inside = F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)
    piece = F.when(inside, F.floor(F.col("r") / high)).otherwise(F.raise_error(F.lit("a cell lies outside the grid")).cast("long"))
    placed = cells.where(v.isNotNull()).select(piece.alias("piece"), (F.col("r") % high).cast("int").alias("r"), F.col("c").cast("int").alias("c"), v.alias("v"))

    def encoded(number: int, frame) -> pd.DataFrame:
        grid = np.full((min(high, height - number * high), width), np.nan)
        if frame is not None:
            grid[frame["r"], frame["c"]] = frame["v"]
        return pd.DataFrame({"piece": [number], "data": [encode(grid)]})

    def blank(frames):
        for frame in frames:
            for number in frame["piece"]:
                yield encoded(int(number), None)

    kind = "piece long, data binary"
    some = written(spread(placed, "piece").groupBy("piece").applyInPandas(lambda frame: encoded(int(frame["piece"].iloc[0]), frame), kind), "strips")
    rest = cells.sparkSession.range(-(-height // high)).select(F.col("id").alias("piece")).join(some.select("piece"), "piece", "left_anti")
    made = written(some.union(rest.mapInPandas(blank, kind)), "strips")
    drop(some)
    return made


def write_tiff(cells: DataFrame, path: str, info: dict, value: str = "value") -> None:
    """One GeoTIFF of a raster (r, c, value) on the grid of ``info``, cells that it lacks as no-data. Executors encode its
    strips (:func:`write_joined`). A file over 4 GB goes to :func:`geoaccord.sources.pyramid.write_pyramid`."""
    from geoaccord.sources import tiff

    shape = info["height"], info["width"]
    high = max(16, -(-CELLS // shape[1]))
    made = _strips(cells, value, shape[1], shape[0], high, tiff.strip)
    sizes = [r[0] for r in made.select(F.length("data"), "piece").orderBy("piece").collect()]  # a row a strip
    write_joined(made, path, tiff.head(shape, sizes, (info["extent"][0], info["extent"][3]), tuple(info["cell"]), info["epsg"], rows_per_strip=high))
    drop(made)


def write_ascii_grid(cells: DataFrame, path: str, width: int, height: int, place: dict, value: str = "value", nodata: float = -9999) -> None:
    """One ASCII grid of a raster (r, c, value); ``place`` has the lines of its head that tell where it lies. Executors write
    its lines (:func:`write_joined`)."""

    def lines(grid) -> bytes:
        return "".join(" ".join(f"{nodata}" if v != v else repr(v) for v in row) + "\n" for row in grid.tolist()).encode()

    made = _strips(cells, value, width, height, max(16, -(-CELLS // width)), lines)
    head = "".join(f"{k} {v}\n" for k, v in ({"ncols": width, "nrows": height} | place | {"NODATA_value": nodata}).items())
    write_joined(made, path, head.encode())
    drop(made)


def write_geometry_run(result, config: dict, path: str, seconds: float) -> dict[str, str]:
    """The tables, the metadata and the report of a geometry analysis below ``path``; the paths by name."""
    out = {}
    for name in ("category_summary", "overall_summary", "matches", "smoothed"):
        out[name] = f"{path}/tables/{name}"
        write_csv(result.tables[name], out[name])
    spark = result.tables["matches"].sparkSession
    metadata = clean({"config": config, "metrics": result.envelope["metrics"], "quality": result.envelope["quality"], "elapsed_seconds": seconds})
    out["run_metadata"] = f"{path}/tables/run_metadata.json"
    write_bytes(spark, out["run_metadata"], json.dumps(metadata, ensure_ascii=False, indent=2).encode())
    out["report"] = f"{path}/report.md"
    write_bytes(spark, out["report"], geometry_report(config, result.envelope, out).encode())
    return out


def geometry_report(config: dict, envelope: dict, files: dict[str, str]) -> str:
    """A Markdown report of a geometry analysis: configuration, quality, result, method, files and mapping."""
    best = envelope["metrics"]["recommended_threshold"]
    chosen = next(r for r in envelope["thresholds"] if r["threshold"] == best)
    table = lambda rows: ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *["| " + " | ".join(number(v) for v in r.values()) + " |" for r in rows]]
    sections = {
        "Input and configuration": [f"- {k}: {v}" for k, v in config.items() if k != "category_mappings"],
        "Data quality": table(envelope["quality"]),
        "Result": [f"The recommended threshold is {number(best)}, with {chosen['matched']} matches, a balanced rate of {number(chosen['balanced_rate'])} and a median IoU of {number(chosen['median_iou'])}.", "", *table(envelope["thresholds"])],
        "Method": ["Boxes make candidates and one-to-one matches; areas, overlaps, perimeters and centroids are those of the polygons."],
        "Files": [f"- {k}: {v}" for k, v in files.items()],
        "Categories": [f"- {m[2]}: {m[0]} and {m[1]}" for m in config["category_mappings"]],
    }
    return "\n".join(["# Agreement of two polygon layers", "", *(line for k, (name, lines) in enumerate(sections.items(), 1) for line in (f"## {k}. {name}", "", *lines, ""))])


def write_table(df: DataFrame, path: str, by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def overviews(cells: DataFrame, path: str, value: str = "value", factors=(2, 4, 8, 16, 32, 64)) -> None:
    """Block means of a raster at rising factors, one partition a level. A level is made from the sums and counts of the
    one before it where its factor is a multiple, so the cells are read once."""
    sums, before = cells.select("r", "c", F.col(value).cast("double").alias("s"), F.col(value).isNotNull().cast("long").alias("n")), 1
    for k, f in enumerate(factors):
        if f % before:
            raise ValueError("each factor must be a multiple of the one before it")
        block = lambda c, step=f // before: F.floor(F.col(c) / step).cast("int").alias(c)
        level = sums.groupBy(block("r"), block("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        level = level.withColumn("factor", F.lit(f)).withColumn("value", F.when(F.col("n") > 0, F.col("s") / F.col("n")))
        level.write.mode("overwrite" if k == 0 else "append").partitionBy("factor").parquet(path)
        kind = cells.sparkSession.read.parquet(path).where(F.col("factor") == f)
        sums, before = kind.select("r", "c", "s", "n"), f


def export_catalog(catalog: DataFrame, path: str) -> None:
    """The catalog as CSV of seven columns; commas inside values become full-width ones."""
    columns = ["name", "data_type", "path", "extent", "crs", "records", "status"]
    write_csv(catalog.select(*[full_width_commas(F.col(c).cast("string")).alias(c) for c in columns]), path)


def clean(value):
    """JSON value with NaN and infinities as null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return value


def success(engine: str, metrics: dict, **more) -> dict:
    return clean({"status": "success", "engine": engine, "metrics": metrics, "message": more.pop("message", ""), **more})


def failure(engine: str, error: Exception) -> dict:
    return {"status": "error", "engine": engine, "metrics": {}, "message": f"{type(error).__name__}: {error}"}


def result_json(result: dict) -> str:
    return json.dumps(clean(result), ensure_ascii=False, indent=2)


def flatten_artifacts(artifacts: dict) -> dict[str, str]:
    """Nested artifact paths under keys joined by ``__``."""
    out: dict[str, str] = {}
    for key, value in artifacts.items():
        if isinstance(value, dict):
            out |= {f"{key}__{k}": v for k, v in flatten_artifacts(value).items()}
        elif value:
            out[str(key)] = str(value)
    return out


def number(value) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "-"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def report(title: str, result: dict) -> str:
    """A Markdown report; sections without content are left out."""
    lines = [f"# {title}", "", f"Status: {result.get('status', '-')}. Engine: {result.get('engine', '-')}.", ""]
    if metrics := {k: v for k, v in result.get("metrics", {}).items() if v is not None}:
        lines += ["## Metrics", "", "| metric | value |", "|---|---|", *[f"| {k} | {number(v)} |" for k, v in metrics.items()], ""]
    for name, key in (("Pairs", "pairwise_metrics"), ("Local statistics", "local_statistics"), ("Thresholds", "thresholds"), ("Bandwidths", "curve")):
        rows = result.get(key) or []
        rows = [r for r in rows if r.get("n", 1) or "n" not in r]
        if rows:
            names = list(rows[0])
            lines += [f"## {name}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(number(r.get(c)) for c in names) + " |" for r in rows], ""]
    if artifacts := flatten_artifacts(result.get("artifacts", {})):
        lines += ["## Files", "", *[f"- {k}: {v}" for k, v in artifacts.items()], ""]
    return "\n".join(lines)


class Registry:
    """Catalog of sources and registry of runs of a project: two logs of JSON events below one path. A change appends a
    file and rewrites none, so a failure between loses nothing; what holds is the last event of each key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"at long, gone boolean, {schema}").json(f"{self.path}/{name}")
        except AnalysisException:  # nothing was logged yet
            return self.spark.createDataFrame([], f"at long, gone boolean, {schema}")

    def _current(self, name: str, schema: str, key: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        last = self._log(name, schema).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("gone", *names), "at").alias("e"))
        return last.where(~F.col("e.gone")).select("e.*").select(*names)

    def _append(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        event = rows.select(F.lit(time.time_ns()).alias("at"), F.lit(gone).alias("gone"), "*")
        event.coalesce(1).write.mode("append").json(f"{self.path}/{name}")

    def sources(self) -> DataFrame:
        return self._current("sources", CATALOG, "path")

    def add_source(self, row: dict) -> None:
        """Add or replace the source of a path."""
        names = [c.split()[0] for c in CATALOG.split(", ")]
        self._append("sources", self.spark.createDataFrame([tuple(row.get(n) for n in names)], CATALOG))

    def add_sources(self, rows: DataFrame) -> None:
        """Add or replace the sources of many rows (name, path, ...), one a path; what they lack is null."""
        given = [F.col(n) if n in rows.columns else F.lit(None) for n in (c.split()[0] for c in CATALOG.split(", "))]
        self._append("sources", rows.select(*[g.cast(c.split(" ", 1)[1]).alias(c.split()[0]) for g, c in zip(given, CATALOG.split(", "))]))

    def remove_source(self, path: str) -> None:
        self._append("sources", self.sources().where(F.col("path") == path), gone=True)

    def purge(self, prefix: str) -> None:
        """Remove the sources below a temporary folder."""
        self._append("sources", self.sources().where(F.col("path").startswith(prefix)), gone=True)

    def runs(self) -> DataFrame:
        return self._current("runs", RUNS, "run_id")

    def add_run(self, run_id: str, title: str, analysis: str, result: dict, created: str) -> None:
        self._append("runs", self.spark.createDataFrame([(run_id, title, analysis, result_json(result), created)], RUNS))

    def rename_run(self, run_id: str, title: str) -> None:
        self._append("runs", self.runs().where(F.col("run_id") == run_id).withColumn("title", F.lit(title)))

    def delete_run(self, run_id: str) -> None:
        self._append("runs", self.runs().where(F.col("run_id") == run_id), gone=True)


def copy_files(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Copies of files, with the other files of a shapefile, in another folder; by the file systems of the paths."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        stem = path.removesuffix(".shp")
        for one in [stem + s for s in (".shp", ".shx", ".dbf", ".prj", ".cpg")] if path != stem else [path]:
            source = jvm.org.apache.hadoop.fs.Path(one)
            store = source.getFileSystem(conf)
            if store.exists(source):
                target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{source.getName()}")
                jvm.org.apache.hadoop.fs.FileUtil.copy(store, source, target.getFileSystem(conf), target, False, conf)
                out.append(target.toString())
    return out
