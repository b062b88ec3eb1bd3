"""Sums by blocks and by moments against neighbour rows and dense matrices."""

import math

import numpy as np
import pyarrow as pa
import pytest

from geoaccord.operators import kernels, weighted

FIELDS = ["y", "x", "z"]


@pytest.fixture(scope="module")
def crowd(spark):
    """Points in a strip, some of them on one another, one far off, with values of 0."""
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform([0, 0], [40, 900], (700, 2)), np.full((40, 2), 20.0), [[400.0, 1000.0]]])
    x = rng.normal(10, 3, len(xy)) + xy[:, 1] / 100
    y, z = 0.7 * x + rng.normal(0, 1, len(xy)), np.where(np.arange(len(xy)) % 9 == 0, 0.0, x + 1)
    rows = [(k, *map(float, r)) for k, r in enumerate(np.column_stack([xy, y, x, z]))] + [(9999, None, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "feature_id long, px double, py double, y double, x double, z double"), xy, y, x


@pytest.mark.parametrize("kernel, bandwidth", [("bisquare", 60.0), ("gaussian", 9.0), ("exponential", 2.0), ("bisquare", 5e3)])
def test_sums_by_blocks(spark, crowd, kernel, bandwidth, monkeypatch):
    df = crowd[0]
    want = {(r["i"], r["pair_key"]): r.asDict() for r in weighted.local_sums(weighted.weighted_pairs(df, FIELDS, kernel, bandwidth), FIELDS).collect()}
    for piece, chunk in ((kernels.PIECE, kernels.CHUNK), (30, 64)):
        monkeypatch.setattr(kernels, "PIECE", piece)
        monkeypatch.setattr(kernels, "CHUNK", chunk)
        got = weighted.fixed_sums(df, FIELDS, kernel, [bandwidth]).drop("bandwidth")
        rows = got.collect()
        assert len(rows) == len(want) and "neighbours" not in got.columns
        for r in rows:
            for name, value in want[r["i"], r["pair_key"]].items():
                assert r[name] == (pytest.approx(value, rel=1e-9, abs=1e-7) if isinstance(value, float) else value), name


def test_no_row_a_pair(spark, crowd):
    """Fixed sums join no neighbours; the search takes no pair rows either."""
    plan = weighted.fixed_sums(crowd[0], FIELDS, "exponential", [2.0])._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Join" not in plan


def test_repeated_ids_are_summed_as_one(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0), (1, 1.0, 0.0, 3.0, 4.0), (2, 0.5, 0.0, 5.0, 7.0)], "feature_id long, px double, py double, y double, x double")
    want = weighted.local_sums(weighted.weighted_pairs(df, ["y", "x"], "bisquare", 5.0), ["y", "x"]).orderBy("i").collect()
    assert weighted.fixed_sums(df, ["y", "x"], "bisquare", [5.0]).drop("bandwidth").orderBy("i").collect() == want


@pytest.mark.parametrize("bandwidth", [3.0, 40.0, 90.0, 300.0, 700.0, 5000.0])
def test_sums_by_moments(spark, crowd, bandwidth, monkeypatch):
    df, xy, y, x = crowd
    monkeypatch.setattr(kernels, "LEAST", 40)
    for piece in (kernels.PIECE, 30):
        monkeypatch.setattr(kernels, "PIECE", piece)
        table = kernels.Moments(df, "y", "x")
        got = sorted(tuple(r) for r in table.sums(bandwidth).collect())
        d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
        w = np.where(d < bandwidth, (1 - (d / bandwidth) ** 2) ** 2, 0.0)
        q = w * w
        want = sorted(zip(y, x, w.sum(1), w @ x, w @ y, w @ (x * x), w @ (x * y), q.sum(1), q @ x, q @ (x * x)))
        assert np.allclose(np.array(got), np.array(want), rtol=1e-10, atol=0)


def test_squares_met_grow_with_edges():
    """A block of a long strip meets a bounded number of squares, whatever the bandwidth, and each place once."""
    for blocks in (64, 1024):
        grid = (0.0, 0.0, 1.0, 1, blocks)
        for b in (0.6, 3.3, blocks / 3, blocks * 0.9):
            kind, level, cx, cy = (np.concatenate(c) for c in zip(*kernels.squares_met(0, blocks // 2, grid, int(math.log2(blocks)), b)))
            assert len(kind) <= 8 * math.log2(blocks)
            covered = np.concatenate([np.arange(y * 2**k, (y + 1) * 2**k) for y, k in zip(cy, level)])
            assert len(np.unique(covered)) == len(covered)
            assert set(range(max(0, blocks // 2 - int(b)), min(blocks, blocks // 2 + int(b) + 1))) <= set(covered.tolist())


def test_points_far_off_widen_no_block(spark, monkeypatch):
    """One point far off, or points without a finite coordinate, leave the blocks and the sums of the others as they are."""
    monkeypatch.setattr(kernels, "LEAST", 40)
    schema = "feature_id long, px double, py double, y double, x double"
    rows = [(k, float(k % 40), float(k // 40), 1.0 + k % 7, 2.0 + k % 5) for k in range(2000)]
    odd = [(9000, math.nan, 1.0, 1.0, 1.0), (9001, 1.0, math.inf, 1.0, 1.0), (9002, None, 1.0, 1.0, 1.0), (9003, -math.inf, 1.0, 1.0, 1.0)]
    sums = lambda df: {r["i"]: tuple(r[c] for c in ("s0", "q0", "wii", "sxy", "e3", "yi")) for r in weighted.fixed_sums(df, ["y", "x"], "exponential", [0.1]).collect()}
    plain = spark.createDataFrame(rows, schema)
    most = lambda df: kernels.placed(df, ["y", "x"], 3.7)[0].groupBy("bx", "by").count().agg({"count": "max"}).first()[0]
    want, some = sums(plain), most(plain)
    for far in (1e9, -1e15, 1e300):
        df = spark.createDataFrame([*rows, (5000, far, far, 3.0, 4.0), (5001, far, 0.0, 3.0, 4.0), *odd], schema)
        assert most(df) <= 2 * some < 400
        got = sums(df)
        assert set(got) - set(want) == {5000, 5001} and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
        assert got[5000] == got[5001] == (1.0, 1.0, 1.0, 12.0, 1.0, 3.0)


def test_few_weights_in_vain():
    """Weights are taken for less than three times the pairs inside the reach."""
    at = np.arange(10_000)
    xy = [pa.array(v.astype(float)) for v in (at % 100, at // 100)]
    batch = pa.RecordBatch.from_arrays([pa.array(at), pa.array(at), *xy, *xy], names=["i", "h", "px", "py", "y", "x"])
    taken = [0]

    def weigh(q):
        taken[0] += q.size
        return kernels.WEIGHTS["gaussian"](q)

    near = kernels._Near([batch], ["y", "x"], weigh, [1.2], 8.5, lambda f: np.stack([np.ones_like(f[0]), f[0]], axis=1), lambda f: np.stack([f[1]], axis=1))
    near.add([batch])
    x, y = at % 100, at // 100
    d = np.hypot(x[5050] - x, y[5050] - y)
    w = np.where(d <= 1.2 * 8.5, np.exp(-0.5 * (d / 1.2) ** 2), 0.0)
    assert near.s[0][5050] == pytest.approx([w.sum(), w @ x]) and near.q[0][5050] == pytest.approx([(w * w) @ y]) and near.n[0][5050] == (w > 0).sum()
    assert near.n[0].sum() + len(at) < taken[0] < 3 * near.n[0].sum()
