"""One entry for the three analyses: a configuration and DataFrames in, a result envelope and lazy tables out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaccord.functions.fields import meaning
from geoaccord.functions.spaces import PLANE, Space
from geoaccord.operators import layers, matching, metrics, raster, weighted
from geoaccord.pairs import pairs
from geoaccord.scratch import written
from geoaccord.sources import sinks


@dataclass
class Result:
    """``envelope`` is JSON-ready; ``tables`` are lazy DataFrames that are never collected here."""

    envelope: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.envelope["status"] == "success"


ANALYSES: dict = {}


def analysis(name: str):
    def register(f):
        ANALYSES[name] = f
        return f

    return register


def run(kind: str, config: dict, **frames: DataFrame) -> Result:
    """Run an analysis; any error becomes an error envelope."""
    try:
        if kind not in ANALYSES:
            raise ValueError(f"unknown analysis {kind}")
        return ANALYSES[kind](config, **frames)
    except Exception as e:
        return Result(sinks.failure(kind, e))


def resolve(df: DataFrame, wanted: list[str]) -> list[str]:
    """Columns by name, or by the name in which other characters are dots; repeats once."""
    import re

    known = {re.sub(r"[^A-Za-z0-9_.]", ".", c): c for c in df.columns} | {c: c for c in df.columns}
    missing = [w for w in wanted if w not in known and re.sub(r"[^A-Za-z0-9_.]", ".", w) not in known]
    if missing:
        raise ValueError(f"no columns {missing}; there are {df.columns}")
    return list(dict.fromkeys(known.get(w) or known[re.sub(r"[^A-Za-z0-9_.]", ".", w)] for w in wanted))


@analysis("attribute")
def attribute(config: dict, points: DataFrame) -> Result:
    """Global and local agreement and regression of the fields of one layer (feature_id, px, py, fields)."""
    fields = resolve(points, config["variables"])
    if len(fields) < 2:
        raise ValueError("two fields or more are needed")
    whole = metrics.complete_cases(points, fields)
    kernel = weighted.kernel_name(config.get("kernel", "bisquare"))
    adaptive = config.get("bandwidth_mode") in ("adaptive", weighted.ADAPTIVE_LABEL)
    space = Space(float(config.get("p", 2)), float(config.get("theta", 0)), config.get("globe", ""))
    if config.get("auto_bandwidth") and space != PLANE:
        raise ValueError("a bandwidth is searched by Euclidean distances only")
    if not config.get("auto_bandwidth"):
        width = weighted.bandwidth_value(config.get("bandwidth"))
    elif adaptive:
        width = weighted.auto_neighbours(whole, fields, kernel, config.get("start_radius"))
    else:
        width = weighted.auto_bandwidth(whole, fields, kernel)
    rows = weighted.weighted_pairs(whole, fields, kernel, width, adaptive, start=config.get("start_radius"), space=space)
    sums = weighted.local_sums(rows, fields) if adaptive else weighted.fixed_sums(whole, fields, kernel, [width], space).drop("bandwidth")
    sums = written(sums, "sums")  # the neighbours, for the errors, the fit and its diagnostics
    fit = weighted.regression(weighted.local_correlation(weighted.local_errors(sums, weighted.zero_denominators(whole, fields))))
    diagnosed = weighted.diagnostics(fit)
    local = weighted.studentised(fit, diagnosed).join(weighted.local_r2(rows, fit, fields).withColumnRenamed("pair_key", "_p").withColumnRenamed("i", "_i"), (F.col("i") == F.col("_i")) & (F.col("pair_key") == F.col("_p"))).drop("_i", "_p")
    local = local.select(F.col("i").alias("feature_id"), "pair_key", "intercept", "slope", "yhat", "residual", "stud_residual", "local_r2", "local_corr", "lme", "lmae", "lmre", "lrmse")
    medians = local.groupBy("pair_key").agg(*[F.median(c).alias(n) for c, n in (("local_r2", "local_r2_median"), ("slope", "coefficient_median"), ("local_corr", "local_corr_median"), ("lme", "lme_median"), ("lmae", "lmae_median"), ("lmre", "lmre_median"), ("lrmse", "lrmse_median"))])
    overall = metrics.attribute_metrics(points, fields).join(diagnosed.select(F.col("pair_key").alias("_k"), "r2", "adj_r2", "aicc"), F.col("pair_key") == F.col("_k")).drop("_k").join(medians.withColumnRenamed("pair_key", "_k"), F.col("pair_key") == F.col("_k")).drop("_k")
    order = {p.key: k for k, p in enumerate(pairs(fields))}
    by_pair = sorted((r.asDict() for r in overall.collect()), key=lambda r: order[r["pair_key"]])  # one row a pair
    first = {k: v for k, v in by_pair[0].items() if k not in ("pair_key", "pair_label")} | {"bandwidth": width}
    meanings = {p.key: {c: meaning(c, p.y, p.x) for c in local.columns if meaning(c)} for p in pairs(fields)}
    return Result(sinks.success("attribute", first, pairs=[p.key for p in pairs(fields)], pairwise_metrics=by_pair, meanings=meanings), {"local": local})


@analysis("geometry")
def geometry(config: dict, a: DataFrame, b: DataFrame) -> Result:
    """Match two layers over thresholds and smooth their errors.

    A layer is measured polygons with their ``rings`` (:func:`geoaccord.operators.layers.measured`), or measured
    rectangles without; or the features of a reader, which are measured here (``category_fields``, ``crs``).
    """
    mapping, thresholds = config["category_mappings"], config.get("thresholds", matching.THRESHOLDS)
    matching.check_mapping(mapping, thresholds)
    least = config.get("min_area", 0.0)
    sides = []
    for side, layer in enumerate((a, b)):
        if "geometry" in layer.columns:
            layer = layers.measured(layer, config["category_fields"][side], [m[side] for m in mapping], config.get("crs"))
        sides.append(written(layer, "layer"))
    quality = [(layers.quality if "state" in layer.columns else matching.quality)(layer, least).first().asDict() for layer in sides]
    one, two = (matching.mapped(layer.where(F.col("area") >= least), mapping, side) for side, layer in enumerate(sides))
    matched = matching.greedy(matching.candidates(one, two, config["cell"], min(thresholds)))
    if all("rings" in layer.columns for layer in sides):
        matched = matching.with_overlap(matched, one, two)
    errors, counts = matching.by_threshold(matching.shape_errors(matched, one, two), thresholds), matching.totals(one, two)
    overall = matching.overall_summary(errors, counts, thresholds)
    best = matching.recommended(overall).first()[0]
    chosen = errors.where(F.col("threshold") == best)
    tables = {"matches": errors, "category_summary": matching.category_summary(errors, counts, thresholds), "overall_summary": overall, "smoothed": matching.smooth(chosen, [float(config.get("bandwidth", 5000.0))])}
    rows = [r.asDict() for r in overall.orderBy("threshold").collect()]  # one row a threshold
    values = {"categories": len(mapping), "recommended_threshold": best, "matched_pairs": next(r["matched"] for r in rows if r["threshold"] == best)}
    return Result(sinks.success("geometry", values, thresholds=rows, quality=quality), tables)


@analysis("raster")
def rasters(config: dict, cells: DataFrame) -> Result:
    """Pairwise and focal agreement of aligned layers (r, c, one column a layer)."""
    names = resolve(cells, config["layers"])
    if len(names) < 2:
        raise ValueError("two layers or more are needed")
    size = raster.check_window(int(config.get("window_size", 5)))
    by_pair = [r.asDict() for r in raster.pairwise(cells, names, config.get("zero_epsilon", 1e-12)).collect()]  # one row a pair
    local = {p.key: raster.focal(cells, size, p.y, p.x) for p in pairs(names)}
    first = {k: v for k, v in (by_pair[0] if by_pair else {}).items() if not k.startswith("pair_")}
    return Result(sinks.success("raster", first, pairwise_metrics=by_pair, window_size=size), local)
