"""The registered queries over the paired test sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaccord.fixtures import fixture
from geoaccord.functions import arrangement, crs, geometry, projection, scalars
from geoaccord.functions.spaces import Space
from geoaccord.operators import catalog, classify, layers, matching, metrics, raster, weighted
from geoaccord.plans import engine, file_queries
from geoaccord.scratch import scratch_path, spread, written
from geoaccord.sources import readers, sinks

FIELDS = ["v_a", "v_b", "v_c"]
LAYERS = ["left_v", "right_v"]
BANDWIDTH, NEIGHBOURS = 600.0, 25
SWEEP = [300.0, 450.0, 600.0]
SMOOTHING = [20.0, 40.0, 60.0]
CELL = 32.0
MAPPING = [(str(k), f"C{k}", str(k)) for k in range(6)]


def rounded(df: DataFrame, shift: float = 0.0, **digits: int) -> DataFrame:
    """Rounded columns. Means of few decimals can lie on a tie; ``shift``, below the last digit, moves them off it."""
    return df.withColumns({c: F.round(F.col(c) + shift * 10.0**-n if shift else F.col(c), n) for c, n in digits.items()})


#: Shift of the measures of repaired shapes, whose new vertices lie on a grid: above its error, below the last digit.
OFF_GRID = 0.012345
#: Shift of the columns that can lie on ties, in units of their last digit.
SHIFT = 0.0012345


def sites(spark, d):
    return metrics.complete_cases(fixture(spark, d, "sites"), FIELDS)


def polygons(spark, d):
    layers = [matching.rectangles(fixture(spark, d, n)) for n in ("poly_a", "poly_b")]
    return [matching.mapped(layer, MAPPING, side) for side, layer in enumerate(layers)]


def measured(spark, d):
    """Matches at every threshold with their errors, and the totals of the labels."""
    a, b = polygons(spark, d)
    matched = matching.greedy(matching.candidates(a, b, CELL, min(matching.THRESHOLDS)))
    return matching.by_threshold(matching.shape_errors(matched, a, b)), matching.totals(a, b)


def pairwise_global_metrics(spark, d):
    return rounded(metrics.attribute_metrics(fixture(spark, d, "sites"), FIELDS), me=4, mae=4, mre=6, rmse=4, correlation=6)


def pairwise_matrix_metrics(spark, d):
    return rounded(metrics.matrix_metrics(fixture(spark, d, "sites"), FIELDS), me=4, mae=4, mre=6, rmse=4)


def scatter_stats(spark, d):
    return rounded(metrics.scatter_stats(fixture(spark, d, "sites"), "v_a", "v_c"), me=4, mae=4, rmse=4, r=6, slope=6, intercept=4)


def scatter_matrix_metrics(spark, d):
    return rounded(metrics.scatter_matrix(fixture(spark, d, "sites"), FIELDS), r=6, rmse=4, mae=4, me=4)


def local_summary_stats(spark, d):
    return rounded(metrics.summary(fixture(spark, d, "sites"), FIELDS), min=4, q1=4, median=4, q3=4, max=4, mean=4, sd=4)


def complete_cases(spark, d):
    return rounded(sites(spark, d), v_a=4, v_b=4, v_c=4)


def missing_value_report(spark, d):
    return catalog.missing_report(fixture(spark, d, "grid"), LAYERS, top=3)


def distinct_values(spark, d):
    return catalog.distinct_values(spark.read.parquet(f"{d}/events.parquet"), "event_type", "event_id")


def systematic_sample(spark, d):
    return catalog.systematic_sample(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name"), "c_custkey", 100)


def extent_union_intersection(spark, d):
    return catalog.extents(fixture(spark, d, "catalog"))


def catalog_consistency(spark, d):
    return catalog.consistency(fixture(spark, d, "catalog"), "EPSG:32650", 10.0, "GeoTIFF")


def category_auto_mapping(spark, d):
    a, b = (fixture(spark, d, n) for n in ("poly_a", "poly_b"))
    return matching.category_mapping(spark, a, b.withColumn("category", F.when(F.col("category") < "C3", F.substring("category", 2, 9)).otherwise(F.col("category"))))


def _local(spark, d, kernel="bisquare", bandwidth=BANDWIDTH, adaptive=False):
    points = sites(spark, d)
    rows = weighted.weighted_pairs(points, FIELDS, kernel, bandwidth, adaptive, start=300.0)
    return points, rows, weighted.local_sums(rows, FIELDS) if adaptive else weighted.fixed_sums(points, FIELDS, kernel, [bandwidth]).drop("bandwidth")


def _local_error(spark, d, *args):
    points, _, sums = _local(spark, d, *args)
    out = weighted.local_errors(sums, weighted.zero_denominators(points, FIELDS))
    return rounded(out.select(F.col("i").alias("feature_id"), "pair_key", "lme", "lmae", "lmre", "lrmse"), SHIFT, lme=4, lmae=4, lmre=6, lrmse=4)


def gw_local_error_fixed_bisquare(spark, d):
    return _local_error(spark, d)


def gw_local_error_gaussian(spark, d):
    return _local_error(spark, d, "gaussian", 150.0)


def gw_local_error_exponential(spark, d):
    return _local_error(spark, d, "exponential", 60.0)


def gw_local_error_adaptive(spark, d):
    return _local_error(spark, d, "bisquare", float(NEIGHBOURS), True)


def gw_local_correlation(spark, d):
    out = weighted.local_correlation(_local(spark, d)[2])
    return rounded(out.select(F.col("i").alias("feature_id"), "pair_key", "local_corr"), local_corr=6)


def gwr_coefficients(spark, d):
    fit = weighted.regression(_local(spark, d)[2])
    return rounded(fit.select(F.col("i").alias("feature_id"), "pair_key", "intercept", "slope", "yhat", "residual", "s_ii"), intercept=3, slope=6, yhat=4, residual=4, s_ii=6)


def gwr_diagnostics(spark, d):
    out = weighted.diagnostics(weighted.regression(_local(spark, d)[2]))
    return rounded(out.select("pair_key", "n", "r2", "adj_r2", "aicc", "edf", "residual_rmse"), r2=6, adj_r2=6, aicc=2, edf=4, residual_rmse=4)


def gwr_studentised_residuals(spark, d):
    fit = weighted.regression(_local(spark, d)[2])
    out = weighted.studentised(fit, weighted.diagnostics(fit))
    return rounded(out.select(F.col("i").alias("feature_id"), "pair_key", "stud_residual"), stud_residual=5)


def gwr_local_r2(spark, d):
    _, rows, sums = _local(spark, d)
    out = weighted.local_r2(rows, weighted.regression(sums), FIELDS)
    return rounded(out.select(F.col("i").alias("feature_id"), "pair_key", "local_r2"), local_r2=6)


def _curve(spark, d):
    _, fit = weighted.sweep(sites(spark, d), FIELDS, "bisquare", SWEEP)
    return weighted.diagnostics(fit, ["bandwidth", "pair_key"])


def gwr_bandwidth_sweep(spark, d):
    return rounded(_curve(spark, d).select("bandwidth", "pair_key", "aicc", "r2", "residual_rmse"), aicc=2, r2=6, residual_rmse=4)


def gwr_best_bandwidth(spark, d):
    return weighted.best_bandwidth(_curve(spark, d), "aicc")


def gwr_auto_bandwidth(spark, d):
    found = weighted.auto_bandwidth(sites(spark, d), ["v_a", "v_c"])
    return spark.createDataFrame([(float(round(found, 2)),)], "bandwidth double")


def gwr_sweep_series(spark, d):
    """The local coefficients of every bandwidth of a sweep."""
    _, fit = weighted.sweep(sites(spark, d), FIELDS, "bisquare", SWEEP)
    return rounded(fit.select("bandwidth", F.col("i").alias("feature_id"), "pair_key", "intercept", "slope", "residual"), intercept=3, slope=6, residual=4)


def gw_match_sweep_sources(spark, d):
    """The smoothed IoU of every match at every bandwidth."""
    rows = measured(spark, d)[0].where("threshold = 0.3")
    return rounded(matching.smooth(rows, SMOOTHING).select("bandwidth", "source_id", "gw_iou"), gw_iou=6)


def neighbours_by_blocks(spark, d):
    """Neighbours by the sum of coordinate differences (p = 1)."""
    near = weighted.neighbours(sites(spark, d), 300.0, [], space=Space(p=1.0))
    return near.groupBy(F.col("i").alias("feature_id")).agg(F.count("*").alias("neighbours"), F.round(F.sum("d"), 4).alias("total"))


def _spaced_error(points, space, bandwidth):
    rows = weighted.weighted_pairs(points, ["v_a", "v_c"], "bisquare", bandwidth, space=space)
    out = weighted.local_errors(weighted.local_sums(rows, ["v_a", "v_c"]), weighted.zero_denominators(points, ["v_a", "v_c"]))
    return rounded(out.select(F.col("i").alias("feature_id"), "lme", "lmae"), SHIFT, lme=4, lmae=4)


def polar(spark, d):
    """The sites as places around the pole, across the seam of longitudes."""
    return sites(spark, d).withColumn("px", F.col("px") * 0.09 - 175.5).withColumn("py", F.lit(88.5) - F.col("py") / 10_000)


def gw_local_error_great_circle(spark, d):
    """Local errors within 60 km on the ellipsoid."""
    return _spaced_error(polar(spark, d), Space(globe="ellipsoid"), 60.0)


def gw_local_error_sphere(spark, d):
    """Local errors within 60 km on the sphere."""
    return _spaced_error(polar(spark, d), Space(globe="sphere"), 60.0)


def gw_local_error_turned(spark, d):
    """Local errors by a distance of power 3 along axes turned by half a radian."""
    return _spaced_error(sites(spark, d), Space(p=3.0, theta=0.5), 450.0)


def bandwidth_baseline(spark, d):
    return rounded(weighted.baseline(fixture(spark, d, "sites"), FIELDS), diagonal=4)


def percent_bandwidth_plan(spark, d):
    n = sites(spark, d).count()
    plans = [(mode, p, float(b)) for mode, base in (("adaptive", n), ("metric", 5590.0), ("raster", 100)) for p, b in weighted.percent_plan(list(range(5, 101, 5)), base, mode)]
    return spark.createDataFrame(plans, "mode string, percent int, bandwidth double")


def bbox_candidates(spark, d):
    a, b = polygons(spark, d)
    return rounded(matching.candidates(a, b, CELL), rect_intersection=4, rect_iou=6)


def greedy_match(spark, d):
    a, b = polygons(spark, d)
    return rounded(matching.greedy(matching.candidates(a, b, CELL, 0.1)).select("label", "a_id", "b_id", "rect_iou"), rect_iou=6)


def match_threshold_sweep(spark, d):
    a, b = polygons(spark, d)
    matched = matching.greedy(matching.candidates(a, b, CELL, 0.1))
    return matching.by_threshold(matched).groupBy("threshold").agg(F.count("*").alias("matched"), F.round(F.avg("rect_iou"), 6).alias("mean_iou"))


def match_geometry_metrics(spark, d):
    rows = measured(spark, d)[0].where("threshold = 0.1")
    return rounded(rows.select("label", "a_id", "b_id", "polygon_iou", "area_error", "area_abs_error", "centroid_distance", "perimeter_error", "px", "py"), polygon_iou=6, area_error=6, area_abs_error=6, centroid_distance=4, perimeter_error=6, px=4, py=4)


_RATES = {"mean_iou": 6, "median_iou": 6, "median_centroid_distance": 4, "median_area_error": 6, "median_perimeter_error": 6, "a_rate": 6, "b_rate": 6, "balanced_rate": 6, "tradeoff": 6}


def category_threshold_summary(spark, d):
    return rounded(matching.category_summary(*measured(spark, d)), **_RATES)


def overall_threshold_summary(spark, d):
    return rounded(matching.overall_summary(*measured(spark, d)), **_RATES)


def geometry_run_tables(spark, d):
    """A geometry analysis from its configuration to the files of its run: the summary by category as its CSV holds it."""
    one, two = (matching.rectangles(fixture(spark, d, n)) for n in ("poly_a", "poly_b"))
    config = {"category_mappings": MAPPING, "cell": CELL, "bandwidth": SMOOTHING[0]}
    result = engine.run("geometry", config, a=one, b=two)
    if not result.ok:
        raise ValueError(result.envelope["message"])
    files = sinks.write_geometry_run(result, config, scratch_path(spark, "run"), 0.0)
    got = readers.read_csv(spark, files["category_summary"])
    kinds = {"label": "string", "threshold": "double", "a_total": "long", "b_total": "long", "matched": "long"}
    return rounded(got.select(*[F.when(F.col(c) != "", F.col(c)).cast(kinds.get(c, "double")).alias(c) for c in matching.category_summary(*measured(spark, d)).columns]), **_RATES)


def recommended_threshold(spark, d):
    return matching.recommended(matching.overall_summary(*measured(spark, d)))


_SMOOTH = {"gw_area_me": 6, "gw_area_mae": 6, "gw_area_rmse": 6, "gw_iou": 6, "gw_centroid": 4, "gw_perimeter": 6}


def gw_match_smoothing(spark, d):
    rows = measured(spark, d)[0].where("threshold = 0.3")
    return rounded(matching.smooth(rows, SMOOTHING[:1]), **_SMOOTH)


def gw_match_bandwidth_sweep(spark, d):
    rows = measured(spark, d)[0].where("threshold = 0.3")
    out = matching.smooth_curve(matching.smooth(rows, SMOOTHING))
    return rounded(out, gw_iou_median=6, gw_area_mae_median=6, gw_centroid_median=4, gw_rmse_median=6, neighbor_median=2)


def l_shape_overlay(spark, d):
    """Overlay areas of L-shapes of matched rectangles, by the general polygon overlay."""
    a, b = polygons(spark, d)
    matched = matching.greedy(matching.candidates(a, b, CELL, 0.1))
    shape = lambda df, t: df.select(F.col("label").alias(f"{t}l"), F.col("feature_id").alias(f"{t}i"), geometry.l_shape(F.col("minx"), F.col("miny"), F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")).alias(f"{t}g"))
    met = matched.join(shape(a, "x"), (F.col("label") == F.col("xl")) & (F.col("a_id") == F.col("xi"))).join(shape(b, "y"), (F.col("label") == F.col("yl")) & (F.col("b_id") == F.col("yi")))
    out = met.select("a_id", "b_id", geometry.overlap("xg", "yg").alias("overlap"), geometry.area(F.col("xg")).alias("a_area"), geometry.perimeter(F.col("xg")).alias("a_perimeter"))
    return rounded(out, overlap=4, a_area=4, a_perimeter=4)


def l_layers(spark, d):
    """Measured layers of L-shapes in the rectangles of the polygon sources."""
    made = []
    for side, name in enumerate(("poly_a", "poly_b")):
        shape = geometry.l_shape(F.col("minx"), F.col("miny"), F.col("w"), F.col("h"))
        rows = fixture(spark, d, name).select("feature_id", "category", F.struct(F.lit("polygon").alias("type"), shape.alias("parts")).alias("geometry"), (F.col("w") * F.col("h")).alias("box_area"))
        made.append(written(matching.mapped(layers.measured(rows, "category", [m[side] for m in MAPPING], keep=["box_area"]), MAPPING, side), "layer"))
    return made


def l_shape_threshold_summary(spark, d):
    """Summary of shapes that do not fill their boxes: candidates by box, errors by polygon."""
    a, b = l_layers(spark, d)
    matched = matching.with_overlap(matching.greedy(matching.candidates(a, b, CELL, min(matching.THRESHOLDS))), a, b)
    errors = matching.by_threshold(matching.shape_errors(matched, a, b))
    return rounded(matching.category_summary(errors, matching.totals(a, b)), **_RATES)


def layer_measures(spark, d):
    layer = l_layers(spark, d)[0]
    return rounded(layer.select("feature_id", "label", "state", "minx", "miny", "maxx", "maxy", "area", "perimeter", "cx", "cy"), minx=4, miny=4, maxx=4, maxy=4, area=4, perimeter=4, cx=4, cy=4)


def layer_quality(spark, d):
    """Quality counts of shapes of which some are missing, without area or crossing themselves."""
    at = lambda x, y: F.struct((F.col("minx") + F.col("w") * x).alias("x"), (F.col("miny") + F.col("h") * y).alias("y"))
    shape = geometry.rectangle(F.col("minx"), F.col("miny"), F.col("minx") + F.col("w"), F.col("miny") + F.col("h"))
    bow = F.array(F.array(at(0, 0), at(1, 1), at(1, 0), at(0, 1)))
    k = F.col("feature_id") % 7
    parts = F.when(k == 1, F.array(F.array(at(0, 0), at(1, 1)))).when(k == 2, bow).otherwise(shape)
    rows = fixture(spark, d, "poly_a").select("feature_id", "category", F.struct(F.when(k == 0, "null").otherwise("polygon").alias("type"), parts.alias("parts")).alias("geometry"))
    return layers.quality(layers.measured(rows, "category"), 250.0)


def layer_repair(spark, d):
    """Measures of shapes as files hold them: rings of any turn, several shells, edges that cross, overlap or touch."""
    at = lambda x, y: F.struct((F.col("minx") + F.col("w") * x).alias("x"), (F.col("miny") + F.col("h") * y).alias("y"))
    ring = lambda *v: F.array(*(at(x, y) for x, y in v))
    box = lambda x, y, u, v: ring((x, y), (u, y), (u, v), (x, v))
    turned = lambda x, y, u, v: ring((x, y), (x, v), (u, v), (u, y))
    kinds = [
        F.array(ring((0, 0), (0, 1), (0.5, 1), (0.5, 0.5), (1, 0.5), (1, 0))),  # against the turn of a shell
        F.array(box(0, 0, 1, 1), box(0.1, 0.1, 0.3, 0.3)),  # a hole that turns like its shell
        F.array(ring((0, 0), (1, 1), (1, 0), (0, 1))),  # a bow-tie
        F.array(box(0, 0, 0.4, 1), turned(0.6, 0, 1, 1)),  # two shells of opposite turns
        F.array(ring((0, 0), (1, 0), (1, 1), (1, 1.5), (1, 1), (0, 1))),  # a spike
        F.array(box(0, 0, 0.6, 0.6), box(0.4, 0.4, 1, 1)),  # parts that overlap
        F.array(box(0, 0, 0.5, 1), turned(0.5, 0, 1, 1)),  # parts that share an edge
        F.array(turned(0, 0, 1, 1), ring((0, 0.5), (0.3, 0.3), (0.3, 0.7))),  # a hole that touches its shell
    ]
    k = F.col("feature_id") % len(kinds)
    parts = F.coalesce(*(F.when(k == j, shape) for j, shape in enumerate(kinds)))
    many = F.when(k.isin(3, 5, 6), "multipolygon").otherwise("polygon")
    rows = fixture(spark, d, "poly_a").select("feature_id", "category", F.struct(many.alias("type"), parts.alias("parts")).alias("geometry"))
    measures = layers.measured(rows, "category").select("feature_id", "state", F.size("rings").alias("parts"), "area", "perimeter", "cx", "cy", "maxy")
    return rounded(measures, shift=OFF_GRID, area=3, perimeter=3, cx=3, cy=3, maxy=3)


def overlay_shapes(spark, d):
    """What matched L-shapes share, cover together, and what the first has alone: rings, and their measures."""
    a, b = l_layers(spark, d)
    matched = matching.greedy(matching.candidates(a, b, CELL, 0.1))
    side = lambda df, t: df.select(F.col("label").alias(f"{t}l"), F.col("feature_id").alias(f"{t}i"), F.col("rings").alias(f"{t}r"))
    met = matched.join(side(a, "x"), (F.col("label") == F.col("xl")) & (F.col("a_id") == F.col("xi"))).join(side(b, "y"), (F.col("label") == F.col("yl")) & (F.col("b_id") == F.col("yi")))
    made = spread(met, "a_id").select("a_id", "b_id", arrangement.overlays(F.col("xr"), F.col("yr"), "both", "either", "first").alias("made")).select("a_id", "b_id", "made.*")
    box = geometry.bounds(F.col("either"))
    out = made.select("a_id", "b_id", *(geometry.signed_area(F.col(n)).alias(n) for n in ("both", "either", "first")), *(v.alias(n) for v, n in zip(box, ("minx", "miny", "maxx", "maxy"))))
    return rounded(out, shift=OFF_GRID, both=3, either=3, first=3, minx=3, miny=3, maxx=3, maxy=3)


def quality_stats(spark, d):
    return matching.quality(matching.rectangles(fixture(spark, d, "poly_a")), 250.0)


def point_in_polygon(spark, d):
    """The last polygon that covers each site on a scaled plane: cells first, then the exact test."""
    points = fixture(spark, d, "sites").select("feature_id", (F.col("px") / 8 + 0.37).alias("x"), (F.col("py") / 9 + 0.41).alias("y"))
    boxes = matching.rectangles(fixture(spark, d, "poly_a")).withColumnRenamed("feature_id", "fid").withColumn("rings", geometry.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL)))
    cells = boxes.withColumn("gx", steps("minx", "maxx")).withColumn("gy", steps("miny", "maxy"))
    met = points.join(cells.hint("merge"), (F.floor(F.col("x") / CELL) == F.col("gx")) & (F.floor(F.col("y") / CELL) == F.col("gy")))
    return met.where(geometry.contains(F.col("rings"), F.col("x"), F.col("y"))).groupBy("feature_id").agg(F.max("fid").alias("polygon_id"), F.count("*").alias("hits"))


def raster_pairwise_metrics(spark, d):
    return rounded(raster.pairwise(fixture(spark, d, "grid"), LAYERS), me=4, mae=4, mre=6, rmse=4, correlation=6)


def _focal(spark, d, size, *columns):
    return raster.focal(fixture(spark, d, "grid"), size).select("r", "c", *columns)


def raster_local_error(spark, d):
    return rounded(_focal(spark, d, 5, "n", "local_me", "local_mae", "local_mre", "local_rmse"), SHIFT, local_me=4, local_mae=4, local_mre=4, local_rmse=4)


def raster_local_correlation(spark, d):
    return rounded(_focal(spark, d, 5, "local_corr"), local_corr=5)


def raster_local_regression(spark, d):
    return rounded(_focal(spark, d, 9, "coefficient", "local_r2"), coefficient=5, local_r2=5)


def raster_window_sweep(spark, d):
    return rounded(raster.window_sweep(fixture(spark, d, "grid"), [3, 5, 9]), local_mae_median=4, local_rmse_median=4, local_corr_median=5, coefficient_median=5, local_r2_median=5)


def raster_block_mean(spark, d):
    return rounded(raster.block_mean(fixture(spark, d, "grid"), "left_v", 8), value=4)


def raster_percentile_stretch(spark, d):
    return raster.stretch(fixture(spark, d, "grid"), "left_v")


def _align(spark, d, method):
    grid = fixture(spark, d, "grid")
    return rounded(raster.resample(grid, grid, "right_v", F.col("r") + 0.5, F.col("c") + 0.25, method), value=8)


def raster_align_bilinear(spark, d):
    return _align(spark, d, "bilinear")


def raster_align_nearest(spark, d):
    return _align(spark, d, "near")


def raster_align_cubic(spark, d):
    return _align(spark, d, "cubic")


def _classified(spark, d, make):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return classify.assign(rows, "v", make(rows), ["p_partkey"])


def classify_equal_interval(spark, d):
    return _classified(spark, d, lambda rows: classify.equal_breaks(rows, "v", 5))


def classify_quantile(spark, d):
    return _classified(spark, d, lambda rows: classify.quantile_breaks(rows, "v", 5))


def classify_manual(spark, d):
    return _classified(spark, d, lambda rows: classify.manual_breaks(rows, "v", ["1000", "1200", "x", 99999]))


def classify_jenks(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    breaks = classify.jenks_breaks(rows, "v", 5, "p_partkey")
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(breaks)], "at int, break double")


def classify_unique_topk(spark, d):
    return classify.top_classes(spark.read.parquet(f"{d}/customer.parquet").withColumn("k", F.col("c_custkey") % 97), "k")


def classify_unique_values(spark, d):
    """Classes and colours of a few whole numbers, in the order of the numbers."""
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return classify.classify(rows, "v", "unique").select("class_id", "label", "n")


def histogram_fixed(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("value").cast("double").alias("v"))
    return rounded(classify.histogram(rows, "v", 18), bin_lo=4, bin_hi=4)


def kde_density(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_acctbal").cast("double").alias("v"))
    return rounded(classify.density(rows, "v"), x=4, density=4)


def _degrees(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (110 + (F.col("c_custkey") % 97) / 16.0).alias("lon"), (20 + (F.col("c_custkey") % 89) / 4.0).alias("lat"))


def project_albers(spark, d):
    x, y = projection.albers(F.col("lon"), F.col("lat"))
    return _degrees(spark, d).select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def project_and_back(spark, d):
    """Degrees of projected points, by either projection."""
    rows = _degrees(spark, d)
    a = projection.albers_degrees(*projection.albers(F.col("lon"), F.col("lat")))
    u = projection.utm_degrees(*projection.utm(F.col("lon"), F.col("lat"), 50), 50)
    return rows.select("c_custkey", F.round(a[0], 7).alias("albers_lon"), F.round(a[1], 7).alias("albers_lat"), F.round(u[0], 6).alias("utm_lon"), F.round(u[1], 6).alias("utm_lat"))


def project_utm(spark, d):
    x, y = projection.utm(F.col("lon"), F.col("lat"), 50)
    return _degrees(spark, d).select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


#: Systems of other datums and methods, as files name them.
LAMBERT = 'PROJCS["Lambert",GEOGCS["g",DATUM["d",SPHEROID["Clarke 1866",6378206.4,294.978698213898]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",500000],PARAMETER["False_Northing",100000],PARAMETER["Central_Meridian",112.5],PARAMETER["Standard_Parallel_1",24],PARAMETER["Standard_Parallel_2",38],PARAMETER["Latitude_Of_Origin",30],UNIT["Foot_US",0.3048006096012192]]'
MERCATOR = 'PROJCS["Mercator",GEOGCS["g",DATUM["d",SPHEROID["Krassovsky",6378245,298.3]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator_2SP"],PARAMETER["standard_parallel_1",42],PARAMETER["central_meridian",51],UNIT["metre",1]]'


def project_systems(spark, d):
    """Points in systems of three projections by their WKT or code, and back to degrees from the cone."""
    rows = _degrees(spark, d)
    at = {name: crs.project(crs.system(given), F.col("lon"), F.col("lat")) for name, given in (("lambert", LAMBERT), ("mercator", MERCATOR), ("web", 3857))}
    back = crs.transform(LAMBERT, 4326, *at["lambert"])
    names = [v.alias(f"{name}_{k}") for name, found in at.items() for v, k in zip(found, "xy")]
    return rounded(rows.select("c_custkey", *names, back[0].alias("lon"), back[1].alias("lat")), **{f"{name}_{k}": 2 for name in at for k in "xy"}, lon=8, lat=8)


def result_columns(spark, d):
    """Source rows with the local errors of one pair by feature, null where a row was incomplete."""
    points = fixture(spark, d, "sites")
    local = gw_local_error_fixed_bisquare(spark, d).where("pair_key = 'v_a__vs__v_c'").select("feature_id", "lme", "lrmse")
    return rounded(catalog.append_result(points, local).select("feature_id", "v_a", "lme", "lrmse"), v_a=4)


def nearest_percent(spark, d):
    steps = spark.range(1, 21).select((F.col("id") * 5).cast("double").alias("percent"))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") * 2.0).alias("v"))
    return catalog.nearest(rows, steps, "v", "percent")


def scalar_functions(spark, d):
    c = F.col("c_name")
    rows = spark.read.parquet(f"{d}/customer.parquet")
    return rows.select(
        "c_custkey", scalars.truncate(F.col("c_name"), 12).alias("short"), scalars.safe_tag(F.concat(F.lit("#"), c, F.lit("!"))).alias("tag"), scalars.pair_key(F.lit("a"), c).alias("pair"),
        scalars.full_width_commas(F.concat(c, F.lit(",x"))).alias("wide"), scalars.safe_number(F.substring("c_name", 10, 9)).alias("number"), scalars.iso_date(F.concat(F.lit("202401"), F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0"))).alias("day"),
    )


def pixel_sample(spark, d):
    return rounded(raster.pixel_sample(fixture(spark, d, "grid"), 500), left_v=4, right_v=4)


def histogram_auto(spark, d):
    """A histogram whose number of bins follows from the number of values."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("value").cast("double").alias("v"))
    return rounded(classify.histogram(rows, "v"), bin_lo=4, bin_hi=4)


def class_counts(spark, d):
    """Classes of a numeric field with the rows of each, by the entry that chooses breaks and colours."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return classify.classify(rows, "v", "equal", 7, order="c_custkey").select("class_id", "n")


def text_classes(spark, d):
    """A text field is classified by its values, whatever the method asked for."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("v"))
    return classify.classify(rows, "v", "quantile", 3, order="n_nationkey").select("class_id", "label", "n", "colour")


def percent_lookup(spark, d):
    """The percent of each stored value, with a default where a value has none."""
    known = spark.range(1, 26).select((F.col("id") * 2).cast("double").alias("value"), (F.col("id") * 4).cast("int").alias("percent"))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return catalog.percent_of(rows, known, "v", default=50).select("p_partkey", "percent")


def local_values(spark, d):
    """The values of a local statistic for its histogram: rounded, without missing ones."""
    return catalog.local_values(gw_local_error_fixed_bisquare(spark, d).where("pair_key = 'v_a__vs__v_c'"), "lme")


def text_filter(spark, d):
    return catalog.containing(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), ["p_name"], "AR").select("p_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        gw_local_error_fixed_bisquare, pairwise_global_metrics, pairwise_matrix_metrics, scatter_stats, scatter_matrix_metrics, local_summary_stats, complete_cases,
        missing_value_report, distinct_values, systematic_sample, extent_union_intersection, catalog_consistency, category_auto_mapping, gw_local_error_gaussian,
        gw_local_error_exponential, gw_local_error_adaptive, gw_local_correlation, gwr_coefficients, gwr_diagnostics, gwr_studentised_residuals, gwr_local_r2,
        gwr_bandwidth_sweep, gwr_best_bandwidth, gwr_auto_bandwidth, percent_bandwidth_plan, bbox_candidates, greedy_match, match_threshold_sweep,
        match_geometry_metrics, category_threshold_summary, overall_threshold_summary, geometry_run_tables, recommended_threshold, gw_match_smoothing, gw_match_bandwidth_sweep,
        l_shape_overlay, l_shape_threshold_summary, layer_measures, layer_quality, layer_repair, overlay_shapes, quality_stats, point_in_polygon, raster_pairwise_metrics, raster_local_error, raster_local_correlation, raster_local_regression,
        raster_window_sweep, raster_block_mean, raster_percentile_stretch, raster_align_bilinear, raster_align_nearest, raster_align_cubic, classify_equal_interval,
        classify_quantile, classify_manual, classify_jenks, classify_unique_topk, classify_unique_values, histogram_fixed, kde_density, project_albers, project_utm, project_and_back, project_systems, result_columns,
        nearest_percent, scalar_functions, pixel_sample, histogram_auto, class_counts, text_classes, percent_lookup, local_values, text_filter,
        gwr_sweep_series, gw_match_sweep_sources, neighbours_by_blocks, gw_local_error_great_circle, gw_local_error_sphere, gw_local_error_turned, bandwidth_baseline,
    )
} | file_queries.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gw_local_error_fixed_bisquare(spark, sf_dir)
