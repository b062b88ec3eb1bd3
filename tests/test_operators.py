"""Operators against brute force and against properties."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaccord.functions import geometry, scalars
from geoaccord.operators import catalog, classify, matching, metrics, raster, weighted
from geoaccord.pairs import Pair, pairs
from geoaccord.plans import engine


def test_pairs():
    assert [p.key for p in pairs(["a", "b", "a", "c"])] == ["a__vs__b", "a__vs__c", "b__vs__c"]
    assert Pair.parse("x__vs__y__vs__z") == Pair("x", "y__vs__z")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    xy, a = rng.uniform(0, 100, (60, 2)), rng.normal(10, 3, 60)
    b = 0.7 * a + rng.normal(0, 1, 60) + xy[:, 0] / 40
    rows = [(i, float(xy[i, 0]), float(xy[i, 1]), float(b[i]), float(a[i])) for i in range(60)]
    return spark.createDataFrame(rows, "feature_id long, px double, py double, y double, x double"), xy, b, a


def test_regression_is_the_dense_one(points):
    df, xy, y, x = points
    fields = ["y", "x"]
    fit = weighted.regression(weighted.local_sums(weighted.weighted_pairs(df, fields, "gaussian", 30.0), fields))
    got = {r["i"]: r for r in fit.collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    w, design = np.exp(-0.5 * (d / 30) ** 2), np.column_stack([np.ones(60), x])
    hat = np.array([design[i] @ np.linalg.solve(design.T @ (w[i][:, None] * design), design.T * w[i]) for i in range(60)])
    for i in range(60):
        assert got[i]["yhat"] == pytest.approx(hat[i] @ y, abs=1e-8)
        assert got[i]["s_ii"] == pytest.approx(hat[i, i], abs=1e-9)
        assert got[i]["s_sq"] == pytest.approx((hat[i] ** 2).sum(), abs=1e-9)


def test_wide_kernel_is_global(points):
    df, *_ = points
    sums = weighted.local_sums(weighted.weighted_pairs(df, ["y", "x"], "gaussian", 1e5), ["y", "x"])
    local = weighted.local_errors(sums, {"y__vs__x": False}).first()
    whole = metrics.attribute_metrics(df, ["y", "x"]).first()
    assert local["lmae"] == pytest.approx(whole["mae"], rel=1e-5)
    assert local["lrmse"] == pytest.approx(whole["rmse"], rel=1e-5)


@pytest.mark.parametrize("k", [1, 5, 20, 80])
def test_nearest_distances(points, k):
    df, xy, *_ = points
    got = {r["i"]: r["b"] for r in weighted.nearest_distances(df, k, 5.0).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for i in range(60):
        want = np.sort(d[i])[k - 1] if k < 60 else d[i].max() * k / 60
        assert got[i] == pytest.approx(want, rel=1e-6)


def test_kernel_labels():
    assert weighted.kernel_name("高斯核") == "gaussian" and weighted.kernel_name("?") == "bisquare"
    assert weighted.bandwidth_value("x") == 25.0 and weighted.bandwidth_value("7") == 7.0
    assert weighted.percent_plan([5, 10, 50], 100, "raster") == [(5, 5), (10, 11), (50, 51)]


def test_greedy_is_sequential(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(160)})
    rows = [("k", a, b, float(rng.randrange(1, 6)), rng.randrange(1, 6) / 6) for a, b in edges]
    got = matching.greedy(spark.createDataFrame(rows, "label string, a_id long, b_id long, rect_intersection double, rect_iou double"))
    used_a, used_b, want = set(), set(), set()
    for _, a, b, inter, iou in sorted(rows, key=lambda r: (-r[4], -r[3], r[1], r[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b))
    assert {(r["a_id"], r["b_id"]) for r in got.collect()} == want


def test_mapping_checks():
    with pytest.raises(ValueError):
        matching.check_mapping([("a", "x", "l"), ("a", "y", "m")], matching.THRESHOLDS)
    with pytest.raises(ValueError):
        matching.check_mapping([("a", "x", "l")], [0.1, 0.2])


def test_focal_against_loops(spark):
    rng = np.random.default_rng(1)
    left, right = rng.normal(5, 2, (9, 11)), rng.normal(5, 2, (9, 11))
    left[2, 3] = np.nan
    rows = [(r, c, None if np.isnan(left[r, c]) else float(left[r, c]), float(right[r, c])) for r in range(9) for c in range(11)]
    got = {(r["r"], r["c"]): r for r in raster.focal(spark.createDataFrame(rows, "r int, c int, left_v double, right_v double"), 5).collect()}
    for r in range(9):
        for c in range(11):
            a, b = (m[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].ravel() for m in (left, right))
            ok = ~np.isnan(a)
            a, b = a[ok], b[ok]
            row = got[r, c]
            assert row["n"] == len(a)
            assert row["local_mae"] == pytest.approx(np.abs(a - b).mean())
            assert row["local_corr"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
            assert row["coefficient"] == pytest.approx((a * b).sum() / (b * b).sum())
    with pytest.raises(ValueError):
        raster.check_window(4)


def test_natural_breaks_are_optimal():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.sort(rng.choice(60, 9, replace=False).astype(float))
        k = 3
        ssd = lambda v: ((v - v.mean()) ** 2).sum() if len(v) else 0.0
        best = min(sum(ssd(x[a:b]) for a, b in zip((0, *cut), (*cut, len(x)))) for cut in itertools.combinations(range(1, len(x)), k - 1))
        breaks = classify.natural_breaks(x, k)
        upper = breaks if len(breaks) == k else breaks[1:]  # a first class of one value has no break of its own
        at = np.searchsorted(upper, x)
        assert sum(ssd(x[at == c]) for c in range(k)) == pytest.approx(best)


def test_classes(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None), (3, 9.0), (4, float("nan"))], "id int, v double")
    out = {r["id"]: r["class_id"] for r in classify.assign(df, "v", classify.equal_breaks(df, "v", 4), ["id"]).collect()}
    assert out == {0: 0, 1: 2, 2: None, 3: 3, 4: None}
    flat = spark.createDataFrame([(0, 2.0), (1, 2.0)], "id int, v double")
    assert classify.equal_breaks(flat, "v", 4).first()[0] == [2.0, 2.0]
    assert classify.stride_sample(spark.range(1000).select(F.col("id").cast("double").alias("v"), "id"), "v", "id", 50).count() == 50


def test_colours():
    assert classify.ramp(["#000000", "#ffffff"], 3) == ["#000000", "#808080", "#ffffff"]
    assert len(set(classify.category_colours(40, ["#111111"] * 12))) == 40
    assert classify.legend_label(1.0, 2.5) == "1–2.5" and classify.grey_legend(2) == ["#3c3c3c", "#ebebeb"]


def test_polygon_measures(spark):
    ring = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    square, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (3, 3), (3, 1))
    df = spark.createDataFrame([([square, hole],)], f"g {geometry.RINGS}")
    cx, cy = geometry.centroid(F.col("g"))
    row = df.select(geometry.area(F.col("g")), geometry.perimeter(F.col("g")), cx, cy, geometry.contains(F.col("g"), F.lit(2.0), F.lit(2.0)), geometry.contains(F.col("g"), F.lit(0.5), F.lit(2.0)), geometry.valid(F.col("g"))).first()
    assert tuple(row) == (12.0, 24.0, 2.0, 2.0, False, True, True)
    assert geometry.overlap_area(geometry.edge_arrays([square, hole]), geometry.edge_arrays([ring((2, 0), (6, 0), (6, 4), (2, 4))])) == pytest.approx(6.0)
    assert geometry.overlap_area(*[geometry.edge_arrays([square])] * 2) == pytest.approx(16.0)


def test_overlap_by_chance():
    """Overlap areas of random polygons against a fine grid of points; of shapes that only touch; of turned rings."""
    rng = random.Random(12)
    star = lambda x, y: [{"x": x + r * math.cos(k), "y": y + r * math.sin(k)} for k, r in ((2 * math.pi * k / 9, rng.uniform(1, 3)) for k in range(9))]

    def inside(ring, x, y):
        hit = np.zeros(x.shape, bool)
        for a, b in zip(ring, [*ring[1:], ring[0]]):
            with np.errstate(divide="ignore", invalid="ignore"):
                hit ^= ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return hit

    x, y = np.meshgrid(np.arange(-4, 7, 0.02), np.arange(-4, 7, 0.02))
    for _ in range(12):
        one, two = star(0, 0), star(rng.uniform(0, 3), rng.uniform(0, 3))
        want = (inside(one, x, y) & inside(two, x, y)).sum() * 0.0004
        for p, q in ((one, two), (one[::-1], two), (two, one[::-1])):
            assert geometry.overlap_area(geometry.edge_arrays([p]), geometry.edge_arrays([q])) == pytest.approx(want, abs=0.03)
    box = lambda x: [{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    assert geometry.overlap_area(geometry.edge_arrays([box(0)]), geometry.edge_arrays([box(1)])) == 0


def test_polygons_that_do_not_fill_their_boxes(spark):
    """Equal triangles have an IoU of 1, though they fill half of their boxes; the analysis takes features of a reader."""
    triangle = lambda x, y: [[{"x": x, "y": y}, {"x": x + 10, "y": y}, {"x": x, "y": y + 10}, {"x": x, "y": y}]]
    rows = [(k, (("polygon", triangle(20.0 * k, 0.0)) if k < 9 else ("null", None)), "c") for k in range(10)]
    kind = "feature_id long, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>, kind string"
    layer = spark.createDataFrame(rows, kind)
    config = {"category_mappings": [("c", "c", "all")], "category_fields": ["kind", "kind"], "cell": 16.0, "bandwidth": 50.0}
    result = engine.run("geometry", config, a=layer, b=layer)
    assert result.ok, result.envelope
    assert {(r["polygon_iou"], r["area_error"]) for r in result.tables["matches"].collect()} == {(1.0, 0.0)}
    assert result.envelope["quality"][0] == {"input": 10, "null_shapes": 1, "empty_shapes": 0, "invalid_shapes": 0, "repaired": 0, "too_small": 0, "processed": 9}


def test_checks(spark):
    df = spark.createDataFrame([("a", " "), (None, "x"), ("", "y")], "p string, q string")
    assert {r["field"]: r["missing"] for r in catalog.missing_report(df, ["p", "q"]).collect()} == {"p": 2, "q": 1}
    assert catalog.field_union([df.withColumn("n", F.lit(1)), df.withColumn("m", F.lit(1.0)).withColumn("n", F.lit(2))]) == ["n", "m"]
    manifest = spark.createDataFrame([("a", "z")], "source_path string, aligned_path string")
    assert sorted(r[0] for r in catalog.path_map(spark.createDataFrame([("a",), ("b",)], "path string"), manifest).collect()) == ["b", "z"]
    assert scalars.letter_label(0) == "A" and scalars.letter_label(27) == "AB" and scalars.sheet_size("A1:F100") == (100, 6)


def test_resampling_reproduces_planes(spark):
    grid = spark.createDataFrame([(r, c, 2.0 * r + 3.0 * c) for r in range(8) for c in range(8)], "r int, c int, v double")
    for method in ("bilinear", "cubic"):
        out = {(x["r"], x["c"]): x["value"] for x in raster.resample(grid, grid, "v", F.col("r") + 0.5, F.col("c") + 0.25, method).collect()}
        assert out[3, 3] == pytest.approx(2 * 3.5 + 3 * 3.25)
    assert math.isclose(raster.preview_factor(1000, 400, 512), 2)


def dense_aicc(xy, y, x, widths):
    """AICc of the bisquare regression with a bandwidth for each point."""
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    w = np.where(d < widths[:, None], (1 - (d / widths[:, None]) ** 2) ** 2, 0.0)
    s0, sx, sxx = w.sum(1), w @ x, w @ (x * x)
    det = s0 * sxx - sx * sx
    hat = w * ((sxx - sx * x)[:, None] + (s0 * x - sx)[:, None] * x[None, :]) / det[:, None]
    n, trace = len(y), np.trace(hat)
    return n * np.log(((y - hat @ y) ** 2).sum() / n) + n * np.log(2 * np.pi) + n * (n + trace) / (n - 2 - trace)


def test_auto_bandwidth_query(spark, sf):
    """The registered search ends at a least AICc of a fine sweep around it."""
    from geoaccord.plans import queries

    found = queries.gwr_auto_bandwidth(spark, sf).first()[0]
    data = np.array([tuple(r) for r in queries.sites(spark, sf).select("px", "py", "v_a", "v_c").collect()], float)
    pair = pairs(["v_a", "v_c"])[0]
    column = {"v_a": data[:, 2], "v_c": data[:, 3]}
    widths = found * np.linspace(0.96, 1.04, 161)
    curve = [dense_aicc(data[:, :2], column[pair.y], column[pair.x], np.full(len(data), b)) for b in widths]
    assert abs(widths[int(np.argmin(curve))] / found - 1) < 0.002


def test_auto_bandwidth_adaptive(points):
    """The adaptive mode searches a neighbour count and keeps its kernel."""
    from geoaccord.plans import engine

    df, xy, y, x = points
    d = np.sort(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]), axis=1)
    curve = {k: dense_aicc(xy, y, x, d[:, k - 1] if k < 60 else d[:, -1]) for k in range(20, 61)}
    config = {"variables": ["y", "x"], "bandwidth_mode": "adaptive", "start_radius": 20.0}
    found = engine.run("attribute", config | {"auto_bandwidth": True}, points=df).envelope
    assert found["status"] == "success"
    k = next(v for v in (found, *(u for u in found.values() if isinstance(u, dict))) if "bandwidth" in v)["bandwidth"]
    assert isinstance(k, int) and 20 <= k <= 60
    assert all(curve[k] <= curve[j] for j in (k - 1, k + 1) if j in curve)
    same = engine.run("attribute", config | {"bandwidth": k}, points=df).envelope
    assert json.dumps(same, sort_keys=True, default=str).count("lrmse") and [r["aicc"] for r in same["pairwise_metrics"]] == pytest.approx([r["aicc"] for r in found["pairwise_metrics"]]) == [pytest.approx(curve[k])]
def test_candidates_of_boxes_of_all_sizes(spark):
    """Boxes from points to the whole extent meet as in a double loop; a huge box adds rows by grids, not by cells."""
    import random

    from geoaccord.operators import matching

    draw = random.Random(5)

    def layer(n, odd):
        rows = []
        for k in range(n):
            size = draw.choice([0.0, 0.5, 3.0, 40.0, 900.0, 20_000.0]) * draw.random()
            x, y = draw.uniform(-9000, 9000) if size > 300 else draw.uniform(0, 90), draw.uniform(0, 90)
            rows.append((k, draw.choice("uv"), x, y, x + size, y + size * draw.random()))
        rows += [(n, "u", -1e4, -1e4, 1e4, 1e4), (n + 1, "u", 8.0, 8.0, 16.0, 16.0), (n + 2, "u", None, 0.0, 1.0, 1.0), (n + 3, "u", 0.0, 0.0, float("inf"), 1.0)][: 4 if odd else 2]
        return rows

    one, two = layer(150, True), layer(130, False)
    frames = [spark.createDataFrame(rows, "feature_id long, label string, minx double, miny double, maxx double, maxy double") for rows in (one, two)]
    wanted = {}
    for i, la, ax, ay, bx, by in one[:152]:
        for j, lb, cx, cy, dx, dy in two:
            w, h = min(bx, dx) - max(ax, cx), min(by, dy) - max(ay, cy)
            if la == lb and w > 0 and h > 0:
                wanted[la, i, j] = w * h
    got = matching.candidates(*frames, 2.0).collect()
    assert len(got) == len(wanted) and all(abs(wanted[r["label"], r["a_id"], r["b_id"]] - r["rect_intersection"]) <= 1e-9 * (1 + r["rect_intersection"]) for r in got)
    many = spark.createDataFrame([(0, "u", -1e6, -1e6, 1e6, 1e6)], frames[0].schema)
    assert matching.candidates(many, frames[1], 1e-3).count() == sum(lb == "u" and dx > cx and dy > cy for _, lb, cx, cy, dx, dy in two)
    assert matching.candidates(many.where("false"), frames[1], 1.0).count() == 0 == matching.candidates(frames[0], frames[1].where("false"), 1.0).count()


def greedy_of(edges):
    taken, out = set(), set()
    for label, a, b, _, _ in sorted(edges, key=lambda e: (-e[4], -e[3], e[1], e[2])):
        if not {(label, 0, a), (label, 1, b)} & taken:
            taken |= {(label, 0, a), (label, 1, b)}
            out.add((label, a, b))
    return out


@pytest.mark.parametrize("rounds, held", [(8, 1 << 19), (1, 1 << 19), (1, 3)])
def test_greedy_by_components(spark, monkeypatch, rounds, held):
    """Chains of ever better edges end in few jobs; components too large for a task go on with rounds."""
    import random

    from geoaccord.operators import matching

    monkeypatch.setattr(matching, "ROUNDS", rounds)
    monkeypatch.setattr(matching, "HELD", held)
    draw = random.Random(3)
    long = 1000 if held > 3 else 12
    edges = [("chain", (k + 1) // 2, k // 2, 1.0, 0.1 + k / (2 * long)) for k in range(long)]
    edges += [(draw.choice("xy"), draw.randrange(60), draw.randrange(60), float(draw.randrange(3)), draw.randrange(5) / 10) for _ in range(90)]
    edges = list(dict.fromkeys(edges))
    df = spark.createDataFrame([*edges, ("x", None, 1, 9.0, 0.9), ("x", 1, None, 9.0, 0.9)], "label string, a_id long, b_id long, rect_intersection double, rect_iou double")
    got = matching.greedy(df).collect()
    assert {(r[0], r[1], r[2]) for r in got} == greedy_of(edges) and len(got) == len(greedy_of(edges))
    assert matching.greedy(df.where("false")).count() == 0


def test_stated_box_areas_decide_the_iou(spark):
    """Far from the origin, bounds have lost digits of a box's size: areas come from widths and heights where these are known."""
    x = 1e6 + 0.1
    layer = lambda w: matching.rectangles(spark.createDataFrame([(1, "k", x, 0.0, w, 1.0)], "feature_id long, category string, minx double, miny double, w double, h double")).withColumn("label", F.lit("k"))
    inter = (x + 0.7) - x
    assert inter != 0.7
    assert [r["rect_iou"] for r in matching.candidates(layer(0.7), layer(1.4), 4.0).collect()] == [inter / (0.7 + 1.4 - inter)]


def test_points_are_never_broadcast(spark, sf):
    """Neighbours, and the residuals of a local R2, are joined by shuffles: only the means, a row, are broadcast."""
    from geoaccord.plans import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(queries.gwr_coefficients(spark, sf))
    assert "BroadcastHashJoin" not in plan(queries.gwr_local_r2(spark, sf))
    assert "BroadcastHashJoin" not in plan(queries.point_in_polygon(spark, sf))


def test_smoothing_by_blocks(spark):
    """Smoothed errors against plain loops, with nulls and an id that repeats; no row a pair of matches, and medians that
    no single task gathers."""
    rng = np.random.default_rng(5)
    at, errors = rng.uniform(0, 300, (60, 2)), rng.normal(size=(60, 5))
    rows = [(k if k else 1, *map(float, at[k]), *[None if c < 2 and k % 4 == 3 else float(e) for c, e in enumerate(errors[k])]) for k in range(60)]
    frame = spark.createDataFrame(rows, "a_id long, px double, py double, area_error double, area_abs_error double, polygon_iou double, centroid_distance double, perimeter_error double")
    smoothed = matching.smooth(frame, [20.0, 40.0])
    assert "Join" not in smoothed._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["bandwidth"], r["source_id"]): r for r in smoothed.collect()}
    assert len(got) == 2 * 59
    for b in (20.0, 40.0):
        for i in range(1, 60):
            met = [(math.exp(-0.5 * (math.dist(x[1:3], y[1:3]) / b) ** 2), y) for x in rows if x[0] == i for y in rows if math.dist(x[1:3], y[1:3]) <= 3 * b]
            mean = lambda f: (sum(w * f(y) for w, y in met if y[3] is not None) / s if (s := sum(w for w, y in met if y[3] is not None)) else None)  # noqa: B023, E731
            r = got[b, i]
            assert r["neighbours"] == len(met) and r["gw_iou"] == pytest.approx(sum(w * y[5] for w, y in met) / sum(w for w, _ in met))
            assert r["gw_area_me"] == pytest.approx(mean(lambda y: y[3])) and r["gw_area_rmse"] == pytest.approx(mean(lambda y: y[3] ** 2) ** 0.5 if mean(lambda y: y[3]) is not None else None)
    curve = matching.smooth_curve(smoothed)
    assert "median" not in curve._jdf.queryExecution().optimizedPlan().toString().lower().replace("_median", "")
    for r in curve.collect():
        assert r["gw_iou_median"] == pytest.approx(np.median([got[k]["gw_iou"] for k in got if k[0] == r["bandwidth"]]))
        assert r["neighbor_median"] == np.median([got[k]["neighbours"] for k in got if k[0] == r["bandwidth"]])
