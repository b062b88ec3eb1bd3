"""Tiled rasters with overviews, written by executors: cells, levels and places read back."""

import math

import numpy as np
import pytest

from geoaccord.sources import pyramid, ranges, tiff

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 3, bytes(5000), RNG.integers(0, 256, 60_000, np.uint8).tobytes(), RNG.integers(0, 3, 90_000, np.uint8).tobytes(), *(RNG.integers(0, 256, n, np.uint8).tobytes() for n in (253, 254, 255, 256, 3836, 3837, 3838))])
def test_lzw_round_trip(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def _means(cells, factor):
    """Plain block means of an array with NaN for no value."""
    height, width = cells.shape
    out = np.full((-(-height // factor), -(-width // factor)), np.nan)
    for r in range(out.shape[0]):
        for c in range(out.shape[1]):
            part = cells[r * factor : (r + 1) * factor, c * factor : (c + 1) * factor]
            if np.isfinite(part).any():
                out[r, c] = part[np.isfinite(part)].mean()
    return out


def _equal(rows, want):
    got = np.full(want.shape, np.nan)
    seen = 0
    for row in rows.collect():
        seen += 1
        got[row["r"], row["c"]] = math.nan if row["value"] is None else row["value"]
    return seen == want.size and np.allclose(got, want.astype("f4"), rtol=1e-6, equal_nan=True)


@pytest.mark.parametrize("packing,big,part_tiles", [("deflate", None, 2), ("lzw", True, 256), ("none", False, 3)])
def test_levels(spark, tmp_path, packing, big, part_tiles):
    cells = np.round(RNG.normal(0, 100, (70, 41)), 3)
    cells[RNG.random(cells.shape) < 0.2] = np.nan
    cells[16:48, 16:32] = np.nan  # two tiles without a value
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(cells)] + [(0, 0, float("inf"))]
    path = str(tmp_path / "made.tif")
    own = {"width": 41, "height": 70, "cell": (10.0, 20.0), "extent": [100.0, -900.0, 510.0, 500.0], "epsg": 32650}
    pyramid.write_pyramid(spark.createDataFrame(rows, "r int, c int, value double"), path, own, factors=(2, 4, 8), tile=16, packing=packing, big=big, part_tiles=part_tiles)
    info = tiff.read_info(spark, path)
    assert {k: info[k] for k in own} == own and info["nodata"] == -9999.0
    assert open(path, "rb").read(4) == (b"II+\0" if big else b"II*\0")
    for level, factor in enumerate((1, 2, 4, 8)):
        want = _means(cells, factor)
        assert _equal(tiff.read_tiff(spark, path, level=level), want)
        assert _equal(ranges.read_tiff(spark, path, level=level), want)
    with pytest.raises(ValueError, match="no level 4"):
        list(tiff.blocks(open(path, "rb").read(), level=4))


def test_odd_rasters(spark, tmp_path):
    """No cells, repeated cells, cells outside the grid, tiles that do not fit."""
    own = {"width": 20, "height": 5, "cell": (1.0, 1.0), "extent": [0.0, 0.0, 20.0, 5.0], "epsg": None}
    make = lambda rows: spark.createDataFrame(rows, "r int, c int, value double, k long")
    path = str(tmp_path / "odd.tif")
    pyramid.write_pyramid(make([]), path, own, factors=(2,), tile=16)
    assert tiff.read_tiff(spark, path).where("value is not null").count() == 0 and tiff.read_tiff(spark, path, level=1).count() == 30
    pyramid.write_pyramid(make([(1, 2, 5.0, 1), (1, 2, 7.0, 1), (1, 3, float("nan"), 1)]), path, own, factors=(2,), tile=16)
    assert [tuple(r)[1:] for r in tiff.read_tiff(spark, path).where("value is not null").collect()] == [(1, 2, 7.0)]
    assert [tuple(r)[1:] for r in tiff.read_tiff(spark, path, level=1).where("value is not null").collect()] == [(0, 1, 7.0)]
    with pytest.raises(Exception, match="outside the grid"):
        pyramid.write_pyramid(make([(5, 0, 1.0, 1)]), path, own, factors=(2,), tile=16)
    for options in ({"tile": 20}, {"factors": (2, 3)}, {"factors": (32,), "tile": 16}):
        with pytest.raises(ValueError, match="multiple"):
            pyramid.write_pyramid(make([]), path, own, **({"tile": 16} | options))
