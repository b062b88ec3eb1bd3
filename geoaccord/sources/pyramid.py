"""One tiled GeoTIFF with its overviews, of a raster of any size.

Tiles of the raster are gathered and encoded by the executors; each also gives the sums and counts of its blocks, from which
the tiles of the next level are made, so an overview is the mean of all cells below it and cells move once. Tiles are put
into part files of a bounded number of tiles; sizes of parts give their offsets, and the file is its directories (chained,
a level each), the offsets and sizes of tiles, one empty tile for all places without a value, and the parts one after
another. The driver keeps a row a part and copies bytes from stream to stream; it never holds a tile.

Layouts follow the TIFF 6.0, BigTIFF and GeoTIFF specifications.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaccord.scratch import drop, scratch_path, written
from geoaccord.sources import tiff

#: Cells along a side of a tile, and tiles of a part file.
TILE, PART_TILES = 256, 256
FACTORS = (2, 4, 8, 16, 32, 64)
#: The number of each compression in a file, and its function.
PACKINGS = {"none": (1, bytes), "lzw": (5, tiff.pack_lzw), "deflate": (8, zlib.compress)}
#: Classic files end here; longer ones are big TIFFs.
CLASSIC_BYTES = 1 << 32
_TILE_ROW = "k long, data binary, s binary, n binary"


class _Tiles:
    """Makes the row of a tile: its bytes, and the sums and counts of its blocks of ``ratio`` x ``ratio`` cells."""

    def __init__(self, side: int, ratio: int, packing: str, nodata: float):
        self.side, self.ratio, self.packing, self.nodata = side, ratio, packing, nodata

    def encoded(self, sums: np.ndarray, counts: np.ndarray) -> bytes:
        mean = np.where(counts > 0, sums / np.maximum(counts, 1), self.nodata)
        return PACKINGS[self.packing][1](mean.astype("<f4").tobytes())

    def row(self, k: int, sums: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        few = self.side // self.ratio
        s, n = (a.reshape(few, self.ratio, few, self.ratio).sum((1, 3)) for a in (sums, counts))
        return pd.DataFrame({"k": [k], "data": [self.encoded(sums, counts)], "s": [s.tobytes()], "n": [n.tobytes()]})

    def of_cells(self, frame: pd.DataFrame) -> pd.DataFrame:
        """A tile of cells (k, r, c, v), places inside the tile; of cells that stand twice the greatest counts."""
        grid = np.full((self.side, self.side), np.nan)
        np.fmax.at(grid, (frame["r"].to_numpy(), frame["c"].to_numpy()), frame["v"].to_numpy(float))
        known = ~np.isnan(grid)
        return self.row(int(frame["k"].iloc[0]), np.where(known, grid, 0.0), known.astype(np.int64))


def _parents(before: DataFrame, across: int, above: int, ratio: int, tiles: _Tiles) -> DataFrame:
    """The tiles of the next level, whose side holds ``ratio`` tiles of ``before``; both levels' tiles in a row are given."""
    few = tiles.side // ratio
    row, column = F.floor(F.col("k") / across), F.col("k") % across

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        sums, counts = np.zeros((tiles.side, tiles.side)), np.zeros((tiles.side, tiles.side), np.int64)
        for r, c, s, n in zip(frame["r"], frame["c"], frame["s"], frame["n"]):
            at = slice(r * few, (r + 1) * few), slice(c * few, (c + 1) * few)
            sums[at] = np.frombuffer(s, float).reshape(few, few)
            counts[at] = np.frombuffer(n, np.int64).reshape(few, few)
        return tiles.row(int(frame["k"].iloc[0]), sums, counts)

    placed = before.select((F.floor(row / ratio) * above + F.floor(column / ratio)).alias("k"), (row % ratio).alias("r"), (column % ratio).alias("c"), "s", "n")
    return placed.groupBy("k").applyInPandas(joined, _TILE_ROW)


def _part_writer(folder: str, part_tiles: int):
    """Writes the tiles of a part, in their order, to a file of its own name, so that a task that runs twice harms nothing."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        name = f"{folder}/{uuid.uuid4().hex}"
        store, place = pafs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        sizes = np.zeros(part_tiles, "<u4")
        with store.open_output_stream(place) as out:
            for k, data in zip(frame["k"], frame["data"]):
                sizes[k % part_tiles] = len(data)
                out.write(data)
        return pd.DataFrame({"level": frame["level"].iloc[:1], "part": frame["part"].iloc[:1], "file": [name], "sizes": [sizes.tobytes()], "total": [int(sizes.sum(dtype=np.int64))]})

    return write


def _directories(levels: list[list[tuple]], big: bool) -> tuple[bytes, int]:
    """The head of a file: chained directories of (tag, code, values); a number instead of values stands for an array of as
    many, which follows the head, arrays in the order of their entries. Also the end of the last array."""
    word, count, size, room = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    kinds = {code: kind for kind, code in sorted(tiff.TYPES.items(), reverse=True)}
    start = 16 if big else 8
    width = lambda code, values: struct.calcsize("<" + code) * (values if isinstance(values, int) else len(values))
    begins, at = [], start
    for entries in levels:
        begins.append(at)
        at += struct.calcsize("<" + count) + size * len(entries) + room + sum(width(c, v) for _, c, v in entries if not isinstance(v, int) and width(c, v) > room)
    arrays = at
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, begins[0]) if big else struct.pack("<2sHI", b"II", 42, begins[0])
    for k, entries in enumerate(levels):
        table, tail = struct.pack("<" + count, len(entries)), b""
        behind = begins[k] + len(table) + size * len(entries) + room
        for tag, code, values in entries:
            many = values if isinstance(values, int) else len(values)
            if isinstance(values, int):
                place = struct.pack("<" + word, arrays)
                arrays += width(code, values)
            else:
                packed = struct.pack("<" + code * many, *values)
                place = packed.ljust(room, b"\0") if len(packed) <= room else struct.pack("<" + word, behind + len(tail))
                tail += packed if len(packed) > room else b""
            table += struct.pack("<HH" + word, tag, kinds[code], many) + place
        head += table + struct.pack("<" + word, begins[k + 1] if k + 1 < len(levels) else 0) + tail
    return head, arrays


def write_pyramid(cells: DataFrame, path: str, info: dict, value: str = "value", factors=FACTORS, tile: int = TILE, packing: str = "deflate", nodata: float = -9999.0, part_tiles: int = PART_TILES, big: bool | None = None) -> None:
    """A GeoTIFF of 32-bit floats of the raster (r, c, ``value``) on the grid of ``info`` (width, height, cell, extent, epsg),
    with its overviews at ``factors``. Cells that are missing, null or not finite are no-data; cells outside the grid raise.
    ``big`` forces a big TIFF, or a classic one; without it the size decides."""
    if part_tiles < 2:
        raise ValueError("a part holds two tiles or more")
    if tile % 16 or any(b % a or tile % (b // a) for a, b in zip((1, *factors), factors)):
        raise ValueError("a tile's side is a multiple of 16, and each factor one of the factor before it, as is the side of their ratio")
    spark, scales = cells.sparkSession, (1, *factors)
    shapes = [(-(-info["height"] // f), -(-info["width"] // f)) for f in scales]
    across = [-(-w // tile) for _, w in shapes]
    numbers = [a * -(-h // tile) for a, (h, _) in zip(across, shapes)]
    ratios = [b // a for a, b in zip(scales, scales[1:])] + [1]
    inside = F.col("r").between(0, info["height"] - 1) & F.col("c").between(0, info["width"] - 1)
    v = F.col(value).cast("double")
    whole = cells.select("r", "c", v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    k = F.when(inside, F.floor(F.col("r") / tile) * across[0] + F.floor(F.col("c") / tile)).otherwise(F.raise_error(F.lit("a cell lies outside the grid")))
    placed = whole.select(k.cast("long").alias("k"), (F.col("r") % tile).alias("r"), (F.col("c") % tile).alias("c"), "v")
    base = _Tiles(tile, ratios[0], packing, nodata)
    made = [written(placed.groupBy("k").applyInPandas(lambda frame: base.of_cells(frame), _TILE_ROW), "tiles")]
    for at in range(1, len(scales)):
        made.append(written(_parents(made[-1], across[at - 1], across[at], ratios[at - 1], _Tiles(tile, ratios[at], packing, nodata)), "tiles"))
    rows = None
    for at, level in enumerate(made):
        one = level.select(F.lit(at).alias("level"), F.floor(F.col("k") / part_tiles).alias("part"), "k", "data")
        rows = one if rows is None else rows.union(one)
    folder = scratch_path(spark, "tile_parts")
    parts = written(rows.groupBy("level", "part").applyInPandas(_part_writer(folder, part_tiles), "level int, part long, file string, sizes binary, total long"), "parts")
    files = parts.select("level", "part", "file", "total").orderBy("level", "part").collect()  # a row for each part_tiles tiles
    blank = _Tiles(tile, 1, packing, nodata).encoded(np.zeros((tile, tile)), np.zeros((tile, tile)))
    _assemble(spark, path, info, shapes, numbers, files, parts, blank, tile, packing, nodata, part_tiles, big)
    drop(*made, parts)


def _entries(info: dict, level: int, shape: tuple[int, int], tiles: int | tuple[list, list], tile: int, packing: str, nodata: float, word: str) -> list[tuple]:
    offsets, sizes = (tiles, tiles) if isinstance(tiles, int) else tiles
    mark = f"{nodata:g}".encode() + b"\0"
    out = [
        (254, "I", [int(level > 0)]), (256, "I", [shape[1]]), (257, "I", [shape[0]]), (258, "H", [32]), (259, "H", [PACKINGS[packing][0]]), (262, "H", [1]), (277, "H", [1]),
        (322, "I", [tile]), (323, "I", [tile]), (324, word, offsets), (325, "I", sizes), (339, "H", [3]), (42113, "c", [mark[k : k + 1] for k in range(len(mark))]),
    ]
    if level == 0:
        out += [(33550, "d", [*info["cell"], 0.0]), (33922, "d", [0.0, 0.0, 0.0, info["extent"][0], info["extent"][3], 0.0])]
        if epsg := info.get("epsg"):
            plane = not 4000 <= epsg < 5000
            out.append((34735, "H", [1, 1, 0, 3, 1024, 0, 1, 1 if plane else 2, 1025, 0, 1, 1, 3072 if plane else 2048, 0, 1, epsg]))
    return sorted(out)


def _assemble(spark, path, info, shapes, numbers, files, parts, blank, tile, packing, nodata, part_tiles, big) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def plan(big: bool, near: dict):
        # the places of up to two tiles may fit into their entries, so they are listed there, those of more in arrays behind the head
        levels = [_entries(info, k, s, n if n > 2 else near.get(k, ([0] * n, [0] * n)), tile, packing, nodata, "Q" if big else "I") for k, (s, n) in enumerate(zip(shapes, numbers))]
        return _directories(levels, big)

    length = len(blank) + sum(f["total"] for f in files)
    if big is None:
        big = plan(False, {})[1] + length >= CLASSIC_BYTES
    empty = plan(big, {})[1]
    if not big and empty + length >= CLASSIC_BYTES:
        raise ValueError("the raster needs a big TIFF")
    starts, at = {}, empty + len(blank)
    for f in files:
        starts[f["level"], f["part"]] = at
        at += f["total"]
    near = {}
    few = {k: n for k, n in enumerate(numbers) if n <= 2}
    held = {row["level"]: row["sizes"] for row in parts.where(F.col("level").isin(list(few))).collect()}  # a row a level
    for k, n in few.items():
        sizes = [int(v) for v in np.frombuffer(held[k], "<u4")[:n]] if k in held else [0] * n
        near[k] = ([starts[k, 0] + sum(sizes[:j]) if v else empty for j, v in enumerate(sizes)], [v or len(blank) for v in sizes])
    head, _ = plan(big, near)
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(head))
        for level, many in ((k, n) for k, n in enumerate(numbers) if n > 2):
            for what in ("offsets", "sizes"):
                done = 0
                known = parts.where(F.col("level") == level).select("part", "sizes").orderBy("part").toLocalIterator()
                for row in known:
                    done = _blank_numbers(out, what, done, row["part"] * part_tiles, empty, len(blank), big)
                    sizes = np.frombuffer(row["sizes"], "<u4")[: many - done]
                    shown = np.where(sizes > 0, sizes, len(blank))
                    if what == "offsets":
                        shown = np.where(sizes > 0, starts[level, row["part"]] + np.cumsum(sizes, dtype=np.int64) - sizes, empty)
                    out.write(bytearray(shown.astype("<u8" if big and what == "offsets" else "<u4").tobytes()))
                    done += len(sizes)
                _blank_numbers(out, what, done, many, empty, len(blank), big)
        out.write(bytearray(blank))
        for f in files:
            place = jvm.org.apache.hadoop.fs.Path(f["file"])
            piece = place.getFileSystem(conf).open(place)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
            finally:
                piece.close()
    finally:
        out.close()


def _blank_numbers(out, what: str, done: int, until: int, empty: int, size: int, big: bool) -> int:
    """Numbers of tiles without a value, in runs of a bounded length."""
    while done < until:
        n = min(until - done, 1 << 16)
        kind, number = ("<u8" if big else "<u4", empty) if what == "offsets" else ("<u4", size)
        out.write(bytearray(np.full(n, number, kind).tobytes()))
        done += n
    return done
