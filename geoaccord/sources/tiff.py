"""Pixels of TIFF rasters: strips or tiles, uncompressed, LZW or deflated, with the place on the ground of a GeoTIFF.

Layouts follow the TIFF 6.0 and GeoTIFF specifications.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from geoaccord.sources.readers import content, first_bytes, part_of

#: Struct codes of the field types, and the names of tags that are used here.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 266: "fill_order", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_sizes", 339: "format", 33550: "scale", 33922: "tie", 34264: "transform", 34735: "geo_keys", 42113: "nodata"}
#: Bytes that are read of a directory at first.
HEAD_BYTES = 1 << 16


def directory(read, level: int = 0) -> dict:
    """Tags of a directory by name (the first, or the one so many links behind it: an overview), values as lists; ``order``
    is the byte order. ``read`` gives bytes by (offset, size), so that a directory anywhere in a large file needs no more
    of it. Both classic and big TIFF."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else None
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    word, count, size, room = ("Q", "Q", 20, 8) if version == 43 else ("I", "H", 12, 4)
    at = struct.unpack_from(order + word, head, 8 if version == 43 else 4)[0]
    first = struct.calcsize(count)
    n = struct.unpack(order + count, read(at, first))[0]
    for _ in range(level):
        at = struct.unpack(order + word, read(at + first + n * size, struct.calcsize(word)))[0]
        if not at:
            raise ValueError(f"the TIFF has no level {level}")
        n = struct.unpack(order + count, read(at, first))[0]
    table, found = read(at + first, n * size), {"order": order}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", table, size * k)
        values = struct.unpack_from(order + word, table, size * k + 4)[0]
        if tag not in TAGS or kind not in TYPES:
            continue
        code = order + TYPES[kind] * values
        long = struct.calcsize(code)
        place = size * k + 4 + room
        raw = table[place : place + long] if long <= room else read(struct.unpack_from(order + word, table, place)[0], long)
        found[TAGS[tag]] = list(struct.unpack(code, raw))
    return found


def _within(raw: bytes):
    return lambda offset, n: raw[offset : offset + n]


def info(read) -> dict:
    """Size, bands, no-data value, cell size, extent and EPSG code (None where the file has none). A place that refers to
    the middle of a pixel is moved to its corner; a turned grid raises."""
    tags = directory(read)
    width, height = tags["width"][0], tags["height"][0]
    nodata = b"".join(tags["nodata"]).split(b"\0")[0].strip() if "nodata" in tags else b""
    out = {"width": width, "height": height, "bands": tags.get("samples", [1])[0], "nodata": float(nodata) if nodata else None, "cell": None, "extent": None, "epsg": None}
    keys, middle = tags.get("geo_keys", []), False
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0:  # geographic and projected reference systems
            out["epsg"] = keys[k + 3]
        middle |= keys[k] == 1025 and keys[k + 3] == 2
    corner = None
    if "scale" in tags and "tie" in tags:
        (dx, dy), (i, j, _, x, y) = tags["scale"][:2], tags["tie"][:5]
        corner = x - i * dx, y + j * dy
    elif "transform" in tags:
        dx, turn, _, x, other, dy, _, y = tags["transform"][:8]
        if turn or other:
            raise ValueError("a turned grid is not read")
        dy, corner = -dy, (x, y)
    if corner:
        left, top = (corner[0] - dx / 2, corner[1] + dy / 2) if middle else corner
        out |= {"cell": (dx, dy), "extent": [left, top - height * dy, left + width * dx, top]}
    return out


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, 256 clears the table and 257 ends."""
    out, table, size, bits, held, last = [], [], 9, 0, 0, None
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, size, last = list(fresh), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        size = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """The codes of TIFF's LZW for bytes: the longest known piece each, the table cleared before its codes outgrow 12 bits."""
    codes, widths = [256], [9]
    table, free, size, held = {}, 258, 9, None
    for byte in data:
        if held is None:
            held = byte
            continue
        longer = table.get(held << 8 | byte)
        if longer is not None:
            held = longer
            continue
        codes.append(held)
        widths.append(size)
        table[held << 8 | byte] = free
        free, held = free + 1, byte
        if free == 4094:
            codes.append(256)
            widths.append(size)
            table, free, size = {}, 258, 9
        elif free == 1 << size:
            size += 1
    if held is not None:
        codes.append(held)
        widths.append(size)
        size += free + 1 == 1 << size
    codes, widths = np.array(codes + [257]), np.array(widths + [min(size, 12)])
    bits = codes[:, None] >> np.arange(11, -1, -1) & 1
    return np.packbits(bits[np.arange(12) >= 12 - widths[:, None]].astype(np.uint8)).tobytes()


def _undone(data: bytes, predictor: int, dtype: np.dtype, shape: tuple[int, int, int]) -> np.ndarray:
    """The samples of a block (rows, columns, bands) from the differences that a predictor left of each row: of whole
    samples (2, floats as whole numbers of their size), or of the bytes of floats, most significant ones first (3)."""
    rows, columns, bands = shape
    if predictor == 3:
        size = dtype.itemsize
        flat = np.frombuffer(data, np.uint8, rows * columns * bands * size).reshape(rows, columns * size, bands)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, columns * bands)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    cells = np.frombuffer(data, dtype, rows * columns * bands).reshape(shape)
    if predictor == 2:
        whole = cells.view(f"{dtype.byteorder if dtype.itemsize > 1 else '|'}u{dtype.itemsize}")
        plain = np.cumsum(whole, axis=1, dtype=f"u{dtype.itemsize}")
        return plain.view(dtype.newbyteorder("="))
    return cells


@dataclass
class Layout:
    """The strips or tiles of a band: their (offset, size) in the file, and what their samples are."""

    places: list
    width: int
    height: int
    wide: int
    high: int
    tiled: bool
    packing: int
    predictor: int
    dtype: np.dtype
    bands: int
    band: int

    def window(self, k: int) -> tuple[int, int, int, int]:
        """(first row, first column, rows, columns) of a block inside the raster."""
        across = -(-self.width // self.wide)
        r, c = k // across * self.high, k % across * self.wide
        return r, c, min(self.high, self.height - r), min(self.wide, self.width - c)

    def cells(self, k: int, data: bytes) -> np.ndarray:
        """The samples (rows, columns) of a block from its bytes."""
        data = data if self.packing == 1 else unpack_lzw(data) if self.packing == 5 else zlib.decompress(data)
        _, _, rows, columns = self.window(k)
        full = _undone(data, self.predictor, self.dtype, (self.high if self.tiled else rows, self.wide, self.bands))
        return full[:rows, :columns, self.band]


def layout(tags: dict, band: int = 1) -> Layout:
    """The blocks of a band. What is not undone here raises."""
    width, height, bands = tags["width"][0], tags["height"][0], tags.get("samples", [1])[0]
    bits, kind, packing, predictor = (tags.get(n, [d])[0] for n, d in (("bits", 8), ("format", 1), ("compression", 1), ("predictor", 1)))
    if packing not in (1, 5, 8, 32946) or bits not in (8, 16, 32, 64) or len(set(tags.get("bits", [8]))) > 1:
        raise ValueError(f"TIFF compression {packing} with {tags.get('bits')} bits is not read")
    if kind not in (1, 2, 3) or predictor not in (1, 2, 3) or tags.get("fill_order", [1])[0] != 1 or predictor == 3 and kind != 3:
        raise ValueError(f"TIFF samples of format {kind} with predictor {predictor} are not read")
    if not 1 <= band <= bands:
        raise ValueError(f"there are {bands} bands")
    dtype = np.dtype(f"{tags['order']}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    tiled, apart = "tile_offsets" in tags, tags.get("planar", [1])[0] == 2 and bands > 1
    wide, high = (tags["tile_width"][0], tags["tile_height"][0]) if tiled else (width, min(height, tags.get("rows_per_strip", [height])[0]))
    places = list(zip(tags["tile_offsets" if tiled else "strip_offsets"], tags["tile_sizes" if tiled else "strip_sizes"]))
    if apart:  # a band has blocks of its own
        of = len(places) // bands
        places = places[(band - 1) * of : band * of]
    return Layout(places, width, height, wide, high, tiled, packing, predictor, dtype, 1 if apart else bands, 0 if apart else band - 1)


def blocks(raw: bytes, band: int = 1, level: int = 0):
    """(first row, first column, array (rows, columns)) of every strip or tile of a band, or of one of its overviews."""
    plan = layout(directory(_within(raw), level), band)
    for k, (offset, size) in enumerate(plan.places):
        r, c, _, _ = plan.window(k)
        yield r, c, plan.cells(k, raw[offset : offset + size])


def read_tiff(spark: SparkSession, path: str, band: int = 1, level: int = 0) -> DataFrame:
    """(path, r, c, value) of a band, row 0 at the top, no-data and non-finite cells null; ``level`` counts overviews. A file
    is a task; its blocks are decoded one after another."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                raw = bytes(data)
                nodata = info(_within(raw))["nodata"]
                for r, c, cells in blocks(raw, band, level):
                    value = cells.astype(float)
                    value = np.where(np.isfinite(value) & (value != (np.nan if nodata is None else nodata)), value, np.nan)
                    row, column = np.indices(value.shape)
                    frame = pd.DataFrame({"path": name, "r": (row + r).ravel().astype(np.int32), "c": (column + c).ravel().astype(np.int32)})
                    flat = value.ravel()
                    yield frame.assign(value=pd.Series(pd.arrays.FloatingArray(np.nan_to_num(flat), np.isnan(flat))))

    return content(spark, path).mapInPandas(parse, "path string, r int, c int, value double")


def read_info(spark: SparkSession, path: str) -> dict:
    head = first_bytes(spark, path, HEAD_BYTES)
    return info(lambda offset, n: head[offset : offset + n] if offset + n <= len(head) else part_of(spark, path, offset, n))


def strip(cells: np.ndarray, nodata: float = -9999.0) -> bytes:
    """A deflated strip of 32-bit floats; NaN is written as no-data."""
    return zlib.compress(np.where(np.isnan(cells), nodata, cells).astype("<f4").tobytes())


def head(shape: tuple[int, int], sizes: list[int], origin: tuple[float, float], cell: float | tuple[float, float], epsg: int, nodata: float = -9999.0, rows_per_strip: int = 16) -> bytes:
    """What stands before the strips, of these sizes, of a deflated single-band GeoTIFF of 32-bit floats."""
    across, down = cell if isinstance(cell, tuple) else (cell, cell)
    height, width = shape
    geographic = 4000 <= epsg < 5000
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    mark = f"{nodata:g}".encode() + b"\0"
    entries = [
        (256, "I", [width]), (257, "I", [height]), (258, "H", [32]), (259, "H", [8]), (262, "H", [1]), (273, "I", [0] * len(sizes)), (277, "H", [1]), (278, "I", [rows_per_strip]), (279, "I", list(sizes)),
        (339, "H", [3]), (33550, "d", [across, down, 0.0]), (33922, "d", [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]), (34735, "H", keys), (42113, "c", [mark[k : k + 1] for k in range(len(mark))]),
    ]
    kinds = {code: kind for kind, code in TYPES.items()}
    begin = 8 + 2 + 12 * len(entries) + 4
    extra = sum(size for _, code, v in entries if (size := struct.calcsize("<" + code * len(v))) > 4)
    at = begin + extra
    if at + sum(sizes) >= 1 << 32:
        raise ValueError("the raster needs a big TIFF; pyramid.write_pyramid writes it")
    offsets = []
    for size in sizes:
        offsets.append(at)
        at += size
    first, tail = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, code, values in entries:
        packed = struct.pack("<" + code * len(values), *(offsets if tag == 273 else values))
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", begin + len(tail))
        tail += packed if len(packed) > 4 else b""
        first += struct.pack("<HHI", tag, kinds[code], len(values)) + place
    return first + struct.pack("<I", 0) + tail


def encode(cells: np.ndarray, origin: tuple[float, float], cell: float | tuple[float, float], epsg: int, nodata: float = -9999.0, rows_per_strip: int = 16) -> bytes:
    """A deflated single-band GeoTIFF of 32-bit floats, its upper left corner at ``origin``, its cells as wide and
    high as ``cell`` (one number: square ones); NaN is written as no-data."""
    strips = [strip(cells[k : k + rows_per_strip], nodata) for k in range(0, cells.shape[0], rows_per_strip)]
    return head(cells.shape, [len(s) for s in strips], origin, cell, epsg, nodata, rows_per_strip) + b"".join(strips)
