"""TIFF files as other programs write them, tables whose values do not fit, and encodings that show late in a file."""

import struct
import zlib

import numpy as np
import pytest

from geoaccord.sources import readers, shapefile, sinks, tiff


def made(cells, order="<", predictor=1, planar=1, packing=8, tile=None, rows=3, big=False, keys=(), extra=(), at_end=False):
    """A TIFF of an array (rows, columns, bands), by the specification."""
    height, width, bands = cells.shape
    dtype = cells.dtype.newbyteorder(order)
    size, kind = dtype.itemsize, {"u": 1, "i": 2, "f": 3}[dtype.kind]
    wide, high = tile or (width, rows)
    planes = [cells[:, :, k : k + 1] for k in range(bands)] if planar == 2 else [cells]

    def block(part):
        if tile:
            part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
        if predictor == 2:
            whole = np.ascontiguousarray(part).view(f"u{size}")
            part = np.diff(whole, axis=1, prepend=np.zeros_like(whole[:, :1])).astype(f"{order}u{size}")
        if predictor == 3:
            raw = np.ascontiguousarray(part.astype(dtype.newbyteorder(">"))).view(np.uint8).reshape(part.shape[0], -1, size).transpose(0, 2, 1)
            raw = raw.reshape(part.shape[0], part.shape[1] * size, part.shape[2])
            return np.diff(raw, axis=1, prepend=np.zeros_like(raw[:, :1])).tobytes()
        return (part if predictor == 2 else part.astype(dtype)).tobytes()

    data = [block(p[r : r + high, c : c + wide]) for p in planes for r in range(0, height, high) for c in range(0, width, wide)]
    data = [zlib.compress(d) if packing == 8 else d for d in data]
    first = 16 if big else 8
    offsets = [first + sum(map(len, data[:k])) for k in range(len(data))]
    word = "Q" if big else "I"
    entries = [(256, 3, [width]), (257, 3, [height]), (258, 3, [size * 8] * bands), (259, 3, [packing]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * bands)]
    entries += [(322, 3, [wide]), (323, 3, [high]), (324, 16 if big else 4, offsets), (325, 4, [len(d) for d in data])] if tile else [(273, 16 if big else 4, offsets), (278, 3, [rows]), (279, 4, [len(d) for d in data])]
    entries += [(34735, 3, [1, 1, 0, len(keys), *(v for k in keys for v in (k[0], 0, 1, k[1]))])] if keys else []
    entries = sorted(entries + list(extra))
    room, at = (8 if big else 4), first + sum(map(len, data))
    table, tail, behind = b"", b"", at + (8 if big else 2) + len(entries) * (20 if big else 12) + room
    for tag, code, values in entries:
        raw = struct.pack(order + tiff.TYPES[code] * len(values), *values)
        place = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + word, behind + len(tail))
        tail += raw if len(raw) > room else b""
        table += struct.pack(order + "HH" + word, tag, code, len(values)) + place
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + b"".join(data) + struct.pack(order + ("Q" if big else "H"), len(entries)) + table + struct.pack(order + word, 0) + tail


CELLS = np.random.default_rng(2).normal(0, 1000, (8, 7, 2))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind,predictor", [("f4", 1), ("f4", 2), ("f4", 3), ("f8", 3), ("i2", 2), ("u1", 2), ("u4", 2)])
@pytest.mark.parametrize("layout", [{}, {"planar": 2}, {"tile": (16, 16)}, {"planar": 2, "tile": (4, 4), "big": True}])
def test_layouts(order, kind, predictor, layout):
    cells = np.abs(CELLS).astype(kind) if kind[0] == "u" else CELLS.astype(kind)
    raw = made(cells, order, predictor, **layout)
    for band in (1, 2):
        got = np.zeros(cells.shape[:2])
        for r, c, part in tiff.blocks(raw, band):
            got[r : r + part.shape[0], c : c + part.shape[1]] = part
        assert (got == cells[:, :, band - 1]).all()


def test_places(spark, tmp_path):
    """A place in the middle of a pixel, a matrix, cells that are not square, and a directory far behind the head."""
    cells = np.ones((6, 5, 1), "f4")
    scale = [(33550, 12, [10.0, 20.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 500.0, 0.0])]
    within = lambda raw: (lambda offset, n: raw[offset : offset + n])
    assert tiff.info(within(made(cells, extra=scale)))["extent"] == [100.0, 380.0, 150.0, 500.0]
    assert tiff.info(within(made(cells, extra=scale, keys=[(1025, 2), (3072, 32650)]))) == {"width": 5, "height": 6, "bands": 1, "nodata": None, "cell": (10.0, 20.0), "extent": [95.0, 390.0, 145.0, 510.0], "epsg": 32650}
    matrix = lambda turn: [(34264, 12, [10.0, turn, 0.0, 100.0, turn, -20.0, 0.0, 500.0, *[0.0] * 8])]
    assert tiff.info(within(made(cells, extra=matrix(0.0))))["extent"] == [100.0, 380.0, 150.0, 500.0]
    with pytest.raises(ValueError, match="turned"):
        tiff.info(within(made(cells, extra=matrix(1.0))))
    wide = np.random.default_rng(1).random((300, 200, 1))
    (tmp_path / "far.tif").write_bytes(made(wide, extra=scale, packing=1))
    own = tiff.read_info(spark, str(tmp_path / "far.tif"))
    assert own["cell"] == (10.0, 20.0) and readers.read_metadata(spark, str(tmp_path / "far.tif")).first()["records"] == 60_000
    rows = spark.createDataFrame([(r, c, float(r * 5 + c)) for r in range(3) for c in range(5)], "r int, c int, value double")
    sinks.write_tiff(rows, str(tmp_path / "made.tif"), own | {"width": 5, "height": 3, "extent": [0.0, 0.0, 50.0, 60.0]} | {"epsg": 32650})
    again = tiff.read_info(spark, str(tmp_path / "made.tif"))
    assert again["cell"] == (10.0, 20.0) and again["extent"] == [0.0, 0.0, 50.0, 60.0] and tiff.read_tiff(spark, str(tmp_path / "made.tif")).count() == 15


def test_what_is_not_read_raises():
    cells = np.ones((2, 2, 1), "f4")
    for extra in ([(266, 3, [2])],):
        with pytest.raises(ValueError, match="not read"):
            list(tiff.blocks(made(cells, extra=extra)))
    with pytest.raises(ValueError, match="bands"):
        list(tiff.blocks(made(cells), 2))
    with pytest.raises(ValueError, match="not read"):
        list(tiff.blocks(made(cells.astype("i4"), predictor=1).replace(struct.pack("<HHIHH", 317, 3, 1, 1, 0), struct.pack("<HHIHH", 317, 3, 1, 3, 0))))


def test_tables_hold_whole_values():
    with pytest.raises(ValueError, match="400 bytes"):
        shapefile.encode_table(["name"], [("é" * 200,)])
    with pytest.raises(ValueError, match="finite"):
        shapefile.encode_table(["v"], [(float("nan"),)])
    raw = shapefile.encode_table(["name", "n", "x"], [("é" * 120, 10**19, -123456789012.5), (None, None, None)])
    records, begin, size, fields = readers.dbf_header(raw)
    row, at, values = raw[begin : begin + size], 1, []
    for _, kind, width, decimals in fields:
        values.append(readers.dbf_value(kind, decimals, row[at : at + width], "utf-8"))
        at += width
    assert records == 2 and values == ["é" * 120, 10**19, -123456789012.5]


def test_encodings_that_show_late(spark, tmp_path):
    """The rows that tell the encoding stand behind thousands of plain ones."""
    plain = "id,name\n" + "".join(f"{k},plain row\n" for k in range(3000))
    for encoding, name, text in (("gb18030", "gb18030", "北京"), ("utf-8", "utf-8", "北京"), ("latin-1", "latin-1", "caf\xe9,\xff")):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes((plain + f'9999,"{text}"\n').encode(encoding))
        assert readers.file_encoding(spark, str(path)) == name
        last = readers.read_csv(spark, str(path)).where("id = '9999'").first()
        assert last["name"] == text
