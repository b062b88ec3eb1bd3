"""Polygon layers: candidates by bounding box, one-to-one matching over thresholds, shape errors and smoothing.

Layers are rows (feature_id, category, minx, miny, maxx, maxy, area, perimeter, cx, cy, ...); ``box_area`` is optional.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaccord.functions import geometry
from geoaccord.operators import kernels
from geoaccord.operators.ranks import medians
from geoaccord.operators.weighted import repeated_ids
from geoaccord.scratch import drop, written

THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def rectangles(df: DataFrame) -> DataFrame:
    """Measures of axis-aligned rectangles (minx, miny, w, h)."""
    c = F.col
    return df.select(
        "feature_id", "category", "minx", "miny", (c("minx") + c("w")).alias("maxx"), (c("miny") + c("h")).alias("maxy"),
        (c("w") * c("h")).alias("area"), (2 * (c("w") + c("h"))).alias("perimeter"), (c("minx") + c("w") / 2).alias("cx"), (c("miny") + c("h") / 2).alias("cy"), (c("w") * c("h")).alias("box_area"),
    )


def normal_category(c: Column) -> Column:
    """A category as text; whole numbers lose their decimals, so 1.0 matches "1"."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def mapped(layer: DataFrame, mapping: list[tuple[str, str, str]], side: int) -> DataFrame:
    """Rows of mapped categories, with the mapping's label as ``label``; unmapped rows are dropped."""
    spark = layer.sparkSession
    names = spark.createDataFrame([(str(m[side]), m[2]) for m in mapping], "_value string, label string")
    return layer.join(F.broadcast(names), normal_category(F.col("category")) == F.col("_value")).drop("_value")


def check_mapping(mapping: list[tuple[str, str, str]], thresholds: list[float]) -> None:
    """A mapping needs unique values on either side; thresholds are nine different numbers in (0, 1]."""
    for side in (0, 1):
        values = [str(m[side]) for m in mapping]
        if not values or len(set(values)) != len(values):
            raise ValueError("each category is mapped once on either side")
    if len(thresholds) != 9 or len(set(thresholds)) != 9 or not all(0 < t <= 1 for t in thresholds):
        raise ValueError("nine different thresholds in (0, 1] are needed")


#: Cells that a box may be wide or high before it moves to a coarser grid.
SPREAD = 8


def candidates(a: DataFrame, b: DataFrame, cell: float, floor: float = 0.0) -> DataFrame:
    """(label, a_id, b_id, rect_intersection, rect_iou) of boxes that overlap, with an IoU above 0 and at least ``floor``.

    Grids of cells that double in size lie over each other. A box belongs to the finest one where it is SPREAD cells wide
    and high at most, so it lies in (SPREAD + 1)^2 cells whatever its size. Pairs meet on the coarser grid of the two: boxes
    are listed there too, but only on grids that boxes of the other layer belong to, and two boxes that were both listed
    on a coarser grid than theirs do not meet there. A pair is kept only in the cell of the lower left corner of its
    overlap, so none comes twice and no distinct is needed. Boxes with a null or an infinite bound overlap nothing.
    A layer may state the areas of its boxes as ``box_area``: far from the origin those of the bounds have lost digits, and
    an IoU on a threshold falls below it.
    """
    c, size = F.col, lambda level: F.pow(F.lit(2.0), level) * cell

    def levelled(layer: DataFrame) -> DataFrame:
        widest = F.greatest(c("maxx") - c("minx"), c("maxy") - c("miny"))
        bounded = layer.where(" and ".join(f"abs({k}) < double('inf')" for k in ("minx", "miny", "maxx", "maxy")))
        bounded = bounded if "box_area" in layer.columns else bounded.withColumn("box_area", (c("maxx") - c("minx")) * (c("maxy") - c("miny")))
        return bounded.withColumn("own", F.when(widest > cell * SPREAD, F.ceil(F.log2(widest / (cell * SPREAD)))).otherwise(0).cast("int"))

    def cells(layer: DataFrame, level: Column, tag: str) -> DataFrame:
        steps = lambda lo, hi: F.sequence(F.floor(c(lo) / size(c("level"))).cast("long"), F.floor(c(hi) / size(c("level"))).cast("long"))
        spread = layer.withColumn("level", level).withColumn("gx", F.explode(steps("minx", "maxx"))).withColumn("gy", F.explode(steps("miny", "maxy")))
        return spread.select(c("label").alias(f"{tag}_label"), c("feature_id").alias(f"{tag}_id"), *[c(k).alias(f"{tag}_{k}") for k in ("minx", "miny", "maxx", "maxy", "box_area", "level", "gx", "gy")])

    one, two = levelled(a), levelled(b)
    grids = [[r[0] for r in layer.select("own").distinct().collect()] for layer in (one, two)]  # a power of 2 each: some tens at most
    own, listed = c("own"), lambda levels, fits: F.explode(F.filter(F.array(*map(F.lit, levels)), fits))
    sides = []
    if all(grids):
        sides.append((cells(one, own, "a"), cells(two, listed(grids[0], lambda x: x >= own), "b")))
    if all(grids) and max(grids[1]) > min(grids[0]):
        sides.append((cells(one, listed(grids[1], lambda x: x > own), "a"), cells(two, own, "b")))
    met = None
    for left_side, right_side in sides or [(cells(one, own, "a"), cells(two, own, "b"))]:
        pair = left_side.join(right_side, [c(f"a_{k}") == c(f"b_{k}") for k in ("label", "level", "gx", "gy")])
        met = pair if met is None else met.union(pair)
    left, low = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
    wide, high = F.least("a_maxx", "b_maxx") - left, F.least("a_maxy", "b_maxy") - low
    met = met.where((wide >= 0) & (high >= 0) & (F.floor(left / size(c("a_level"))) == c("a_gx")) & (F.floor(low / size(c("a_level"))) == c("a_gy")))
    inter = wide * high
    both = c("a_box_area") + c("b_box_area") - inter
    iou = F.when(both > 0, inter / both).otherwise(0.0)
    return met.select(c("a_label").alias("label"), "a_id", "b_id", inter.alias("rect_intersection"), iou.alias("rect_iou")).where((c("rect_iou") > 0) & (c("rect_iou") >= floor))


#: Rounds of best edges before the rest is split into components, and the edges of a component that one task may hold.
ROUNDS, HELD = 8, 1 << 19
_EDGE = ["label", "a_id", "b_id", "rect_intersection", "rect_iou"]


def greedy(edges: DataFrame) -> DataFrame:
    """One-to-one matches in order of IoU, overlap (both falling), a_id and b_id.

    An edge that comes first at both of its ends is in the greedy result whatever the rest is, so all such edges are
    taken together, their ends leave, and the rest goes round again. Chains in which each edge is better than the one
    before it would lose one edge a round; so after ROUNDS rounds the rest falls into its components, which are matched
    whole, many in a task; components of over HELD edges go on with rounds. Edges with a null end match nothing.
    """
    c, matched = F.col, []
    rank = F.struct((-c("rect_iou")).alias("k1"), (-c("rect_intersection")).alias("k2"), "a_id", "b_id")
    left, rounds = written(edges.where("label is not null and a_id is not null and b_id is not null").select(*_EDGE), "edges"), 0
    while not left.isEmpty():
        if rounds == ROUNDS:
            won, rest = _by_component(left)
            rounds = 0
        else:
            ranked = left.withColumn("_rank", rank)
            best_a = ranked.groupBy(c("label").alias("_la"), c("a_id").alias("_a")).agg(F.min("_rank").alias("_ra"))
            best_b = ranked.groupBy(c("label").alias("_lb"), c("b_id").alias("_b")).agg(F.min("_rank").alias("_rb"))
            both = ranked.join(best_a, (c("label") == c("_la")) & (c("a_id") == c("_a"))).join(best_b, (c("label") == c("_lb")) & (c("b_id") == c("_b")))
            won = written(both.where((c("_rank") == c("_ra")) & (c("_rank") == c("_rb"))).select(*_EDGE), "matched")
            gone_a = won.select(c("label").alias("_la"), c("a_id").alias("_a"))
            gone_b = won.select(c("label").alias("_lb"), c("b_id").alias("_b"))
            rest = written(left.join(gone_a, (c("label") == c("_la")) & (c("a_id") == c("_a")), "left_anti").join(gone_b, (c("label") == c("_lb")) & (c("b_id") == c("_b")), "left_anti"), "edges")
            rounds += 1
        matched.append(won)
        drop(left)
        left = rest
    return functools.reduce(DataFrame.union, matched) if matched else left


def _by_component(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches of the components of HELD edges at most, edges of the others)."""
    c = F.col
    node = lambda side: F.struct(c("label").alias("l"), F.lit(side).alias("s"), c(("a_id", "b_id")[side]).cast("string").alias("i"))
    roots = _roots(edges.select(node(0).alias("u"), node(1).alias("v")))
    tagged = written(edges.withColumn("_u", node(0)).join(roots, c("_u") == c("node")).select(*edges.columns, F.xxhash64("root").alias("_root")), "tagged")
    drop(roots)
    large = tagged.groupBy(c("_root").alias("_r")).agg(F.count("*").alias("n")).where(c("n") > HELD)
    groups = max(1, -(-2 * tagged.count() // HELD), edges.sparkSession.sparkContext.defaultParallelism)

    def match(rows):
        rows = rows.assign(_i=-rows["rect_iou"], _o=-rows["rect_intersection"]).sort_values(["_i", "_o", "a_id", "b_id"])
        taken, kept = set(), []
        for label, one, two in zip(rows["label"], rows["a_id"], rows["b_id"]):
            ends = {(label, 0, one), (label, 1, two)}
            kept.append(not ends & taken)
            if kept[-1]:
                taken |= ends
        return rows.loc[kept, _EDGE]

    small = tagged.join(large, c("_root") == c("_r"), "left_anti").withColumn("_group", F.pmod("_root", F.lit(groups)))
    won = written(small.groupBy("_group").applyInPandas(match, edges.select(*_EDGE).schema), "matched")
    rest = written(tagged.join(large, c("_root") == c("_r"), "left_semi").select(*_EDGE), "edges")
    drop(tagged)
    return won, rest


def _roots(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of links (u, v).

    Each round a node, and the parent of a node, takes the least grandparent of the neighbours, and its own; that halves
    the depth of trees while they merge, so rounds grow with the logarithm of a component.
    """
    c = F.col
    both = written(links.union(links.select("v", "u")).select(c("u").alias("_u"), c("v").alias("_v")), "links")
    state = written(both.groupBy(c("_u").alias("node")).agg(F.min(F.least("_u", "_v")).alias("root")), "roots")
    while True:
        above = state.join(state.select(c("node").alias("_n"), c("root").alias("_g")), c("root") == c("_n")).select("node", "root", c("_g").alias("top"))
        above = written(above, "above")
        met = both.join(above.select(c("node").alias("_x"), c("top").alias("_t")), c("_v") == c("_x")).groupBy("_u").agg(F.min("_t").alias("_t"))
        hook = above.join(met, c("node") == c("_u"))
        new = above.select("node", "top").union(hook.select("node", "_t")).union(hook.select("root", "_t"))
        new = written(new.groupBy("node").agg(F.min("top").alias("root")), "roots")
        changed = new.join(state.select(c("node").alias("_n"), c("root").alias("_old")), c("node") == c("_n")).where(c("root") != c("_old"))
        done = changed.isEmpty()
        drop(state, above)
        state = new
        if done:
            drop(both)
            return state


def with_overlap(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``matches`` with ``overlap``, the intersection area of the polygons (``rings`` of the layers) of each match."""
    c = F.col
    side = lambda t, df: df.select(c("label").alias(f"_{t}l"), c("feature_id").alias(f"_{t}i"), c("rings").alias(f"_{t}r"))
    met = matches.join(side("a", a), (c("label") == c("_al")) & (c("a_id") == c("_ai"))).join(side("b", b), (c("label") == c("_bl")) & (c("b_id") == c("_bi")))
    return met.select(*matches.columns, geometry.overlap("_ar", "_br").alias("overlap"))


def by_threshold(matches: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Matches of every threshold: those of a higher threshold are a prefix of those of the lowest."""
    each = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("rect_iou") >= t))
    return matches.withColumn("threshold", each)


def shape_errors(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """IoU, signed and absolute relative area error, centroid distance, relative perimeter error and the mid-point.

    The intersection is the column ``overlap`` of :func:`with_overlap`; without it that of the boxes, for layers of
    rectangles.
    """
    c = F.col
    side = lambda t, df: df.select(*[c(k).alias(f"{t}_{k}") for k in ("label", "feature_id", "area", "perimeter", "cx", "cy")])
    met = matches.join(side("a", a), (c("label") == c("a_label")) & (c("a_id") == c("a_feature_id"))).join(side("b", b), (c("label") == c("b_label")) & (c("b_id") == c("b_feature_id")))
    inter = c("overlap" if "overlap" in matches.columns else "rect_intersection")
    both = c("a_area") + c("b_area") - inter
    return met.select(
        *matches.columns, "a_area", "b_area",
        F.when(both > 0, inter / both).otherwise(0.0).alias("polygon_iou"),
        F.when(c("a_area") > 0, (c("b_area") - c("a_area")) / c("a_area")).alias("area_error"),
        F.when(c("a_area") > 0, F.abs(c("b_area") - c("a_area")) / c("a_area")).alias("area_abs_error"),
        F.sqrt(F.pow(c("a_cx") - c("b_cx"), 2) + F.pow(c("a_cy") - c("b_cy"), 2)).alias("centroid_distance"),
        F.when(c("a_perimeter") > 0, F.abs(c("b_perimeter") - c("a_perimeter")) / c("a_perimeter")).alias("perimeter_error"),
        ((c("a_cx") + c("b_cx")) / 2).alias("px"), ((c("a_cy") + c("b_cy")) / 2).alias("py"),
    )


def totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, a_total, b_total)"""
    one = a.groupBy("label").agg(F.count("*").alias("a_total"))
    two = b.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("b_total"))
    return one.join(two, F.col("label") == F.col("_l"), "full").select(F.coalesce("label", "_l").alias("label"), F.coalesce("a_total", F.lit(0)).alias("a_total"), F.coalesce("b_total", F.lit(0)).alias("b_total"))


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    balanced = F.when(c("a_total") + c("b_total") > 0, 2 * c("matched") / (c("a_total") + c("b_total"))).otherwise(0.0)
    rates = df.withColumns({
        "a_rate": F.when(c("a_total") > 0, c("matched") / c("a_total")).otherwise(0.0),
        "b_rate": F.when(c("b_total") > 0, c("matched") / c("b_total")).otherwise(0.0),
        "balanced_rate": balanced,
    })
    mid = F.coalesce("median_iou", F.lit(0.0))
    return rates.withColumn("tradeoff", F.when(c("balanced_rate") + mid > 0, 2 * c("balanced_rate") * mid / (c("balanced_rate") + mid)).otherwise(0.0))


def _errors() -> list[Column]:
    return [
        F.count("a_id").alias("matched"), F.avg("polygon_iou").alias("mean_iou"), F.median("polygon_iou").alias("median_iou"),
        F.median("centroid_distance").alias("median_centroid_distance"), F.median("area_abs_error").alias("median_area_error"), F.median("perimeter_error").alias("median_perimeter_error"),
    ]


def category_summary(measured: DataFrame, counts: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Per label and threshold, zero-match rows included (their median IoU is 0, other measures null)."""
    every = counts.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    rows = measured.select(F.col("label").alias("_l"), F.col("threshold").alias("_t"), "a_id", "polygon_iou", "centroid_distance", "area_abs_error", "perimeter_error")
    met = every.join(rows, (F.col("label") == F.col("_l")) & (F.col("threshold") == F.col("_t")), "left")
    done = met.groupBy("label", "threshold", "a_total", "b_total").agg(*_errors())
    return _rates(done.withColumn("median_iou", F.when(F.col("matched") == 0, 0.0).otherwise(F.col("median_iou"))))


def overall_summary(measured: DataFrame, counts: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Per threshold over all labels; medians are over the pooled matches."""
    every = counts.agg(F.sum("a_total").alias("a_total"), F.sum("b_total").alias("b_total")).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    rows = measured.select(F.col("threshold").alias("_t"), "a_id", "polygon_iou", "centroid_distance", "area_abs_error", "perimeter_error")
    return _rates(every.join(rows, F.col("threshold") == F.col("_t"), "left").groupBy("threshold", "a_total", "b_total").agg(*_errors()))


def recommended(overall: DataFrame) -> DataFrame:
    """The threshold with the largest balanced rate times median IoU, the lowest on a tie."""
    score = F.col("balanced_rate") * F.coalesce("median_iou", F.lit(0.0))
    return overall.agg(F.max_by("threshold", F.struct(score.alias("s"), (-F.col("threshold")).alias("t"))).alias("recommended_threshold"))


def smooth(measured: DataFrame, bandwidths: list[float]) -> DataFrame:
    """Gaussian weighted errors of the matches around each match, cut at three bandwidths, for every bandwidth.

    Sums are taken by blocks of matches (``kernels``), without a row a pair of matches; those of an a_id that repeats are
    one. Null errors are left out of the means."""
    c = F.col
    fields = ["area_error", "area_abs_error", "polygon_iou", "centroid_distance", "perimeter_error"]
    known = [f"{f}_known" for f in fields]
    points = written(measured.select(c("a_id").alias("feature_id"), "px", "py", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in fields], *[c(f).isNotNull().cast("double").alias(k) for f, k in zip(fields, known)]), "matches")

    def values(columns):
        return np.stack([*columns, columns[0] * columns[0]], axis=1)

    sums = kernels.kernel_sums(points, [*fields, *known], kernels.WEIGHTS["gaussian"], [float(b) for b in bandwidths], 3.0, values)
    n, s = len(fields), c("s")
    if repeated_ids(points):
        sums = sums.groupBy("bandwidth", "i").agg(F.sum("n").alias("n"), F.array(*[F.sum(s[k]) for k in range(2 * n + 1)]).alias("s"))
    mean = lambda k, of: F.when(s[n + of] > 0, s[k] / s[n + of])
    return sums.select(
        "bandwidth", c("i").alias("source_id"), mean(0, 0).alias("gw_area_me"), mean(1, 1).alias("gw_area_mae"), F.sqrt(mean(2 * n, 0)).alias("gw_area_rmse"),
        mean(2, 2).alias("gw_iou"), mean(3, 3).alias("gw_centroid"), mean(4, 4).alias("gw_perimeter"), c("n").alias("neighbours"),
    )


def smooth_curve(smoothed: DataFrame) -> DataFrame:
    """Medians of the smoothed measures per bandwidth, by rounds of counts; NaN counts as the greatest number."""
    measures = {"gw_iou": "gw_iou_median", "gw_area_mae": "gw_area_mae_median", "gw_centroid": "gw_centroid_median", "gw_area_rmse": "gw_rmse_median", "neighbours": "neighbor_median"}
    each = [F.nanvl(F.col(c).cast("double"), F.lit(math.inf)).alias(name) for c, name in measures.items()]
    return medians(smoothed.select("bandwidth", *each), "bandwidth", list(measures.values()))


def quality(layer: DataFrame, min_area: float) -> DataFrame:
    """Counts of null, empty and too small shapes of a layer, and of those processed."""
    null, empty = F.col("area").isNull(), F.col("area") <= 0
    small = ~null & ~empty & (F.col("area") < min_area)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return layer.agg(F.count("*").alias("input"), count(null).alias("null_shapes"), count(empty).alias("empty_shapes"), count(small).alias("too_small"), count(~null & ~empty & ~small).alias("processed"))


def category_mapping(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_value, b_value): common values with themselves, the others of either side in order (numbers first)."""
    from pyspark.sql import Window

    one, two = (df.select(normal_category(F.col("category")).alias("v")).where("v is not null").distinct() for df in (a, b))
    common = one.join(two, "v", "left_semi").select(F.col("v").alias("a_value"), F.col("v").alias("b_value"))
    number = F.expr("try_cast(v as double)")
    order = Window.orderBy(number.isNull(), number, "v")  # distinct category values: a small dimension
    rest = lambda x, y, name: x.join(y, "v", "left_anti").select(F.row_number().over(order).alias(f"n_{name}"), F.col("v").alias(f"{name}_value"))
    left = rest(one, two, "a").join(rest(two, one, "b"), F.col("n_a") == F.col("n_b"), "full").select("a_value", "b_value")
    return common.union(left)
