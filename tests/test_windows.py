"""Windows of many sizes and medians against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaccord.operators import raster
from geoaccord.operators.ranks import medians
from geoaccord.operators.windows import STATISTICS, focal_tiles, slid


@pytest.mark.parametrize("size", [1, 2, 3, 5, 9, 10])
def test_running_sums(size):
    values = np.random.default_rng(size).integers(-9, 9, (2, 10)).astype(float)
    want = np.stack([values[:, k : k + size].sum(1) for k in range(11 - size)], 1)
    assert np.array_equal(slid(values, size), want)


def test_windows_across_tiles(spark):
    """Several tiles, also fewer cells in one than in half a window; the same as windows by frames."""
    rng = np.random.default_rng(5)
    rows = [(r - 7, c - 3, None if (r * c) % 11 == 4 else float(round(rng.normal(0, 50), 2)), float("nan") if (r + c) % 13 == 0 else float(round(rng.normal(0, 50), 2))) for r in range(23) for c in range(19)]
    cells = spark.createDataFrame(rows, "r int, c int, left_v double, right_v double")
    tiles = {(r["r"], r["c"], r["size"]): r for r in focal_tiles(cells, [3, 5, 17], side=4).collect()}
    frames = raster.focal_sizes(cells, [3, 5, 17]).collect()
    assert len(tiles) == len(frames) == 23 * 19 * 3
    for f in frames:
        t = tiles[f["r"], f["c"], f["size"]]
        assert t["n"] == f["n"]
        for k in STATISTICS:
            assert (t[k] is None) == (f[k] is None) and (t[k] is None or math.isclose(t[k], f[k], rel_tol=1e-9, abs_tol=1e-9)), (f, k)


def test_flat_regions_and_gaps(spark):
    """A flat region beside large values has no correlation; cells that have no row count as empty."""
    rows = [(r, c, 0.1 if c < 20 else 1e6 * r * c, 0.3 if c < 20 else 1e6 * r + c) for r in range(12) for c in range(40) if (r, c) != (5, 5)]
    cells = spark.createDataFrame(rows, "r int, c int, left_v double, right_v double")
    got = {(r["r"], r["c"]): r for r in focal_tiles(cells, [5]).collect()}
    assert all(got[r, c]["local_corr"] is None and got[r, c]["n"] <= 25 for r in range(2, 10) for c in range(2, 17) if (r, c) != (5, 5))
    assert got[5, 6]["n"] == 24 and (5, 5) not in got and math.isclose(got[5, 6]["local_mae"], 0.2, rel_tol=1e-12)
    assert focal_tiles(cells.where("r < 0"), [3]).count() == 0
    with pytest.raises(ValueError, match="odd"):
        focal_tiles(cells, [4])


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_medians(spark, few):
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(0, 1, 501), "even": rng.normal(5, 1, 400), "ties": np.repeat([1.0, 2.0, 3.0], [100, 50, 150]), "halves": np.repeat([1.0, 9.0], 40), "far": np.append(rng.normal(0, 1, 300), [1e300, -1e300]),
        "one": np.array([4.0]), "two": np.array([4.0, 7.0]), "ends": np.array([-math.inf, 1.0, 2.0, 3.0, math.inf, math.inf]),
    }
    rows = [(g, float(v), float(v) * 2) for g, values in groups.items() for v in values] + [("normal", None, float("nan"))] * 50 + [("none", None, None), (None, 3.0, None)]
    got = {r["g"]: (r["a"], r["b"]) for r in medians(spark.createDataFrame(rows, "g string, a double, b double"), "g", ["a", "b"], bins=16, few=few).collect()}
    assert got.pop("none") == (None, None) and got.pop(None) == (3.0, None)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert math.isclose(got[g][0], np.median(values), rel_tol=1e-12) and math.isclose(got[g][1], 2 * np.median(values), rel_tol=1e-12), g


def test_sweep(spark):
    cells = spark.range(900).select(F.floor(F.col("id") / 30).cast("int").alias("r"), (F.col("id") % 30).cast("int").alias("c"), F.rand(1).alias("left_v"), F.rand(2).alias("right_v"))
    got = {r["window_size"]: r for r in raster.window_sweep(cells, [3, 29, 3]).collect()}
    assert set(got) == {3, 29}
    for size, row in got.items():
        want = raster.focal(cells, size).agg(F.median("local_mae"), F.median("local_corr"), F.median("local_r2")).first()
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((row["local_mae_median"], row["local_corr_median"], row["local_r2_median"]), want))
