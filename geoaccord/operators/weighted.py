"""Geographically weighted metrics and regression.

Kernels and statistics follow Fotheringham, Brunsdon & Charlton (2002) and Gollini et al. (2015). Neighbours come from
an equi-join on grid cells, so the pairs grow with the points inside the kernel, not with the square of all points;
kernels without an edge are cut where their weight is below 2 ** -53. One aggregation by focal point yields the sums
from which all local statistics of all pairs follow in closed form.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaccord.functions.spaces import PLANE, Space
from geoaccord.operators import kernels
from geoaccord.operators.metrics import complete_cases
from geoaccord.pairs import pairs
from geoaccord.scratch import drop, written

#: Kernel: (weight of distance over bandwidth, reach in bandwidths)
KERNELS = {
    "bisquare": (lambda q: F.when(q < 1, F.pow(1 - q * q, 2)).otherwise(0.0), 1.0),
    "gaussian": (lambda q: F.exp(-0.5 * q * q), math.sqrt(2 * 53 * math.log(2))),
    "exponential": (lambda q: F.exp(-q), 53 * math.log(2)),
}
#: Fixed names: labels of the kernels and of the adaptive mode in configurations.
KERNEL_LABELS = {"双平方核": "bisquare", "高斯核": "gaussian", "指数核": "exponential"}
ADAPTIVE_LABEL = "最近邻个数"
DEFAULT_BANDWIDTH = 25.0


def kernel_name(label: str) -> str:
    """A kernel by name or label; unknown ones are bisquare."""
    return label if label in KERNELS else KERNEL_LABELS.get(label, "bisquare")


def bandwidth_value(value) -> float:
    """A positive bandwidth, or the default."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return DEFAULT_BANDWIDTH
    return number if math.isfinite(number) and number > 0 else DEFAULT_BANDWIDTH


def neighbours(points: DataFrame, radius: float, keep: list[str], focal: list[str] = (), centres: DataFrame | None = None, carry: list[str] = (), space: Space = PLANE) -> DataFrame:
    """(i, fi_*, carry, j, *keep, d) for points within ``radius`` of each centre, each point with itself, by the distance of
    ``space``.

    Points lie in cells (squares, on a globe cubes) as wide as the radius; a centre (by default every point) meets the
    cells around its own. Points are never broadcast: a scan of few columns looks small, and its rows would go to the driver
    and into every executor.
    """
    side = space.side(radius)
    cell = lambda: [F.floor(a / side).cast("long") for a in space.axes(F.col("px"), F.col("py"))]
    names = [f"_g{k}" for k in range(len(cell()))]
    data = points.select(F.col("feature_id").alias("j"), F.col("px").alias("xj"), F.col("py").alias("yj"), *keep, *[c.alias(f"{n}j") for n, c in zip(names, cell())])
    own = (points if centres is None else centres).select(F.col("feature_id").alias("i"), F.col("px").alias("xi"), F.col("py").alias("yi"), *[F.col(f).alias(f"fi_{f}") for f in focal], *carry, *[c.alias(f"{n}o") for n, c in zip(names, cell())])
    around = F.inline(F.array(*[F.struct(*[(F.col(f"{n}o") + k).alias(n) for n, k in zip(names, step)]) for step in itertools.product((-1, 0, 1), repeat=len(names))]))
    met = own.select("i", "xi", "yi", *[f"fi_{f}" for f in focal], *carry, around).join(data.hint("merge"), [F.col(n) == F.col(f"{n}j") for n in names])
    d = space.distance(F.col("xi"), F.col("yi"), F.col("xj"), F.col("yj"))
    return met.withColumn("d", d).where(F.col("d") <= radius).select("i", "xi", "yi", *[f"fi_{f}" for f in focal], *carry, "j", *keep, "d")


def nearest_distances(points: DataFrame, k: int, start: float, space: Space = PLANE) -> DataFrame:
    """(i, b): distance to the k-th nearest point, itself counted.

    Points whose k-th neighbour is not within the radius are tried again with twice the radius, so each round lists
    only pairs inside it; with fewer than k points, b is k / n times the largest distance.
    """
    total = points.count()
    if k >= total:
        box = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
        reach = space.reach(box[1] - box[0], box[3] - box[2]) or 1.0
        far = neighbours(points, reach, [], space=space).groupBy("i").agg(F.max("d").alias("d"))
        return far.select("i", (F.col("d") * (k / total)).alias("b"))
    out, left, radius = None, points.select("feature_id", "px", "py"), start
    while True:
        near = neighbours(points, radius, [], centres=left, space=space)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") == k).select("i", F.col("d").alias("b"))
        done = written(ranked, "nearest")
        out = done if out is None else out.union(done)
        left = written(left.join(done.hint("merge"), F.col("feature_id") == F.col("i"), "left_anti"), "points")
        if left.isEmpty():
            return out
        radius *= 2


def weighted_pairs(points: DataFrame, fields: list[str], kernel: str, bandwidth: float, adaptive: bool = False, start: float | None = None, space: Space = PLANE) -> DataFrame:
    """Neighbour rows (i, fi_*, j, fields, d, w) of the complete cases under a fixed or an adaptive bandwidth."""
    weight, reach = KERNELS[kernel]
    if not adaptive:
        met = neighbours(points, bandwidth * reach, fields, fields, space=space)
        return met.withColumn("w", weight(F.col("d") / bandwidth)).where("w > 0")
    # Each point meets the points within its own reach, joined by the class of that reach: the next power of 2.
    own = nearest_distances(points, int(round(bandwidth)), start or 1.0, space)
    centres = points.join(own.withColumnRenamed("i", "_i").hint("merge"), F.col("feature_id") == F.col("_i")).drop("_i").withColumnRenamed("b", "_b")
    centres = written(centres.withColumn("_class", F.ceil(F.log2(F.greatest(F.col("_b") * reach, F.lit(1e-12)))).cast("int")), "centres")
    out = None
    for row in centres.select("_class").distinct().orderBy("_class").collect():  # a power of 2 each: some tens at most
        met = neighbours(points, 2.0 ** row[0], fields, fields, centres.where(F.col("_class") == row[0]), ["_b"], space)
        out = met if out is None else out.union(met)
    if out is None:
        out = neighbours(points, 1.0, fields, fields, centres, ["_b"], space)
    return out.withColumn("w", weight(F.col("d") / F.col("_b"))).where("w > 0").drop("_b")


def local_sums(rows: DataFrame, fields: list[str], by: list[str] = ("i",)) -> DataFrame:
    """The weighted sums of every pair for every focal point, one row a (focal point, pair)."""
    made, w, out = pairs(fields), F.col("w"), []
    out.append(F.sum(w).alias("s0"))
    out.append(F.sum(w * w).alias("q0"))
    out.append(F.sum(F.when(F.col("i") == F.col("j"), w)).alias("wii"))
    for k, p in enumerate(made):
        y, x = F.col(p.y), F.col(p.x)
        d = y - x
        for name, value in (
            ("sx", w * x), ("sy", w * y), ("sxx", w * x * x), ("sxy", w * x * y), ("syy", w * y * y), ("qx", w * w * x), ("qxx", w * w * x * x),
            ("e1", w * d), ("e2", w * F.abs(d)), ("e3", w * d * d), ("e4", w * F.abs(d) / F.nullif(x, F.lit(0.0))),
        ):
            out.append(F.sum(value).alias(f"p{k}_{name}"))
        out.append(F.max(F.when(F.col("i") == F.col("j"), y)).alias(f"p{k}_yi"))
        out.append(F.max(F.when(F.col("i") == F.col("j"), x)).alias(f"p{k}_xi"))
    names = ["sx", "sy", "sxx", "sxy", "syy", "qx", "qxx", "e1", "e2", "e3", "e4", "yi", "xi"]
    long = [F.struct(F.lit(p.key).alias("pair_key"), *[F.col(f"p{k}_{n}").alias(n) for n in names]) for k, p in enumerate(made)]
    return rows.groupBy(*by).agg(*out).select(*by, "s0", "q0", "wii", F.inline(F.array(*long)))


def repeated_ids(points: DataFrame) -> bool:
    return not points.groupBy("feature_id").count().where("count > 1").isEmpty()


def fixed_sums(points: DataFrame, fields: list[str], kernel: str, bandwidths: list[float], space: Space = PLANE) -> DataFrame:
    """(bandwidth, and the columns of :func:`local_sums`) of the complete cases under fixed bandwidths.

    In the Euclidean plane the sums are taken by blocks, without a row a pair of points; other distances, and ids that
    repeat (whose sums are one), go by neighbour rows."""
    made = pairs(fields)
    if space != PLANE or repeated_ids(points):
        out = None
        for b in bandwidths:
            rows = weighted_pairs(points, fields, kernel, b, space=space).withColumn("bandwidth", F.lit(float(b)))
            sums = local_sums(rows, fields, ["bandwidth", "i"])
            out = sums if out is None else out.union(sums)
        return out
    at = [(fields.index(p.y), fields.index(p.x)) for p in made]

    def values(columns):
        out = [np.ones_like(columns[0])]
        for a, b in at:
            y, x = columns[a], columns[b]
            d, some = y - x, x != 0
            out += [x, y, x * x, x * y, y * y, d, np.abs(d), d * d, np.abs(d) / np.where(some, x, 1.0) * some, some.astype(float)]
        return np.stack(out, axis=1)

    def squares(columns):
        return np.stack([np.ones_like(columns[0]), *[v for _, b in at for v in (columns[b], columns[b] * columns[b])]], axis=1)

    sums = kernels.kernel_sums(points, fields, kernels.WEIGHTS[kernel], [float(b) for b in bandwidths], KERNELS[kernel][1], values, squares)
    s, q, names, long = F.col("s"), F.col("q"), ["sx", "sy", "sxx", "sxy", "syy", "e1", "e2", "e3", "e4"], []
    for k, p in enumerate(made):
        got = {n: s[1 + 10 * k + m] for m, n in enumerate(names)} | {"qx": q[1 + 2 * k], "qxx": q[2 + 2 * k], "yi": F.col(f"fi_{p.y}"), "xi": F.col(f"fi_{p.x}")}
        got["e4"] = F.when(s[10 + 10 * k] > 0, got["e4"])
        long.append(F.struct(F.lit(p.key).alias("pair_key"), *[got[n].alias(n) for n in ("sx", "sy", "sxx", "sxy", "syy", "qx", "qxx", "e1", "e2", "e3", "e4", "yi", "xi")]))
    return sums.select("bandwidth", "i", s[0].alias("s0"), q[0].alias("q0"), "wii", F.inline(F.array(*long)))


def zero_denominators(points: DataFrame, fields: list[str]) -> dict[str, bool]:
    """For each pair, whether its denominator x is 0 anywhere; local relative errors are then null."""
    made = pairs(fields)
    got = points.agg(*[F.max(F.when(F.col(p.x) == 0, 1).otherwise(0)).alias(f"z{k}") for k, p in enumerate(made)]).first()
    return {p.key: got[k] == 1 for k, p in enumerate(made)}


def local_errors(sums: DataFrame, zero: dict[str, bool]) -> DataFrame:
    """Local mean, absolute, relative and squared errors."""
    null_mre = F.col("pair_key").isin([k for k, z in zero.items() if z] or [""])
    return sums.withColumns({"lme": F.col("e1") / F.col("s0"), "lmae": F.col("e2") / F.col("s0"), "lmre": F.when(~null_mre, F.col("e4") / F.col("s0")), "lrmse": F.sqrt(F.greatest(F.lit(0.0), F.col("e3") / F.col("s0")))})


def local_correlation(sums: DataFrame) -> DataFrame:
    s = {c: F.col(c) for c in ("s0", "sx", "sy", "sxx", "sxy", "syy")}
    spread = (s["s0"] * s["sxx"] - s["sx"] * s["sx"]) * (s["s0"] * s["syy"] - s["sy"] * s["sy"])
    return sums.withColumn("local_corr", F.when(spread > 0, (s["s0"] * s["sxy"] - s["sx"] * s["sy"]) / F.sqrt(spread)))


def regression(sums: DataFrame) -> DataFrame:
    """Local weighted least squares y = intercept + slope x: coefficients, fit, residual and hat-matrix terms."""
    c = F.col
    det = c("s0") * c("sxx") - c("sx") * c("sx")
    a, b = c("sxx") - c("sx") * c("xi"), c("s0") * c("xi") - c("sx")
    return (
        sums.withColumn("det", F.when(det > 0, det))
        .withColumns({"slope": (c("s0") * c("sxy") - c("sx") * c("sy")) / c("det"), "intercept": (c("sxx") * c("sy") - c("sx") * c("sxy")) / c("det"), "s_ii": c("wii") * (a + b * c("xi")) / c("det"), "s_sq": (a * a * c("q0") + 2 * a * b * c("qx") + b * b * c("qxx")) / (c("det") * c("det"))})
        .withColumn("yhat", c("intercept") + c("slope") * c("xi"))
        .withColumn("residual", c("yi") - c("yhat"))
    )


def diagnostics(fitted: DataFrame, by: list[str] = ("pair_key",)) -> DataFrame:
    """R2, adjusted R2, AICc, effective degrees of freedom and residual error of fitted regressions."""
    c = F.col
    sums = fitted.groupBy(*by).agg(F.count("*").alias("n"), F.sum(c("residual") * c("residual")).alias("rss"), (F.count("*") * F.var_pop("yi")).alias("tss"), F.sum("s_ii").alias("tr_s"), F.sum("s_sq").alias("tr_ss"))
    n = c("n")
    return (
        sums.withColumn("edf", n - 2 * c("tr_s") + c("tr_ss"))
        .withColumn("r2", 1 - c("rss") / c("tss"))
        .withColumn("adj_r2", 1 - (1 - c("r2")) * (n - 1) / (c("edf") - 1))
        .withColumn("aicc", n * F.log(c("rss") / n) + n * F.log(F.lit(2 * math.pi)) + n * (n + c("tr_s")) / (n - 2 - c("tr_s")))
        .withColumn("residual_rmse", F.sqrt(c("rss") / n))
    )


def studentised(fitted: DataFrame, diagnosed: DataFrame, by: list[str] = ("pair_key",)) -> DataFrame:
    """Residuals over their estimated deviation."""
    c = F.col
    found = diagnosed.select(*[c(b).alias(f"_{b}") for b in by], (c("rss") / c("edf")).alias("_s2"))
    on = [c(b) == c(f"_{b}") for b in by]
    q = 1 - 2 * c("s_ii") + c("s_sq")
    return fitted.join(found, on).withColumn("stud_residual", c("residual") / F.sqrt(c("_s2") * q)).drop("_s2", *[f"_{b}" for b in by])


def local_r2(rows: DataFrame, fitted: DataFrame, fields: list[str], by: list[str] = ("i",)) -> DataFrame:
    """(by, pair_key, local_r2): one less the weighted residual over the weighted total sum of squares around i."""
    made, rest = pairs(fields), [b for b in by if b != "i"]
    each = lambda of, value, name: [of(F.when(F.col("pair_key") == p.key, F.col(value))).alias(f"{name}{k}") for k, p in enumerate(made)]
    fit = fitted.groupBy(*[F.col(b).alias(f"_{b}") for b in rest], F.col("i").alias("_j")).agg(*each(F.max, "residual", "_e"))  # one row a point, for all pairs
    means = fitted.groupBy(*[F.col(b).alias(f"m_{b}") for b in rest]).agg(*each(F.avg, "yi", "_m"))
    met = rows.join(fit.hint("merge"), [F.col("j") == F.col("_j"), *[F.col(b) == F.col(f"_{b}") for b in rest]])
    met = met.join(F.broadcast(means), [F.col(b) == F.col(f"m_{b}") for b in rest]) if rest else met.crossJoin(F.broadcast(means))
    w, out = F.col("w"), []
    for k, p in enumerate(made):
        e, dev = F.col(f"_e{k}"), F.col(p.y) - F.col(f"_m{k}")
        out.append((1 - F.sum(w * e * e) / F.sum(w * dev * dev)).alias(f"_r{k}"))
    return met.groupBy(*by).agg(*out).select(*by, F.inline(F.array(*[F.struct(F.lit(p.key).alias("pair_key"), F.col(f"_r{k}").alias("local_r2")) for k, p in enumerate(made)])))


def sweep(points: DataFrame, fields: list[str], kernel: str, bandwidths: list[float], space: Space = PLANE) -> tuple[DataFrame, DataFrame]:
    """Neighbour rows (one neighbour join at the largest) and fitted regressions for every fixed bandwidth."""
    weight, reach = KERNELS[kernel]
    within = F.filter(F.array(*[F.lit(float(b)) for b in bandwidths]), lambda b: F.col("d") <= b * reach)
    met = neighbours(points, max(bandwidths) * reach, fields, space=space).withColumn("bandwidth", F.explode(within))
    rows = met.withColumn("w", weight(F.col("d") / F.col("bandwidth"))).where("w > 0")
    return rows, regression(fixed_sums(points, fields, kernel, bandwidths, space))


def auto_bandwidth(points: DataFrame, fields: list[str], kernel: str = "bisquare", rounds: int = 25) -> float:
    """Golden-section search of the fixed bandwidth with the least AICc for the first pair.

    Bisquare sums go by moments of squares inside the bandwidth (``kernels.Moments``), so the first steps, whose bandwidths
    span most of the map, meet near all pairs without listing them. Other kernels are no polynomials and meet them in
    blocks."""
    box = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    hi = math.hypot(box[1] - box[0], box[3] - box[2])
    lo, ratio = hi / 5000, (math.sqrt(5) - 1) / 2

    pair = pairs(fields[:2])[0]
    table = kernels.Moments(points, pair.y, pair.x) if kernel == "bisquare" and not repeated_ids(points) else None

    def loss(b: float) -> float:
        if table is not None:
            sums = table.sums(b).withColumns({"wii": F.lit(1.0), "pair_key": F.lit(pair.key)})
        else:
            sums = fixed_sums(points, fields[:2], kernel, [b])
        got = diagnostics(regression(sums)).first()
        return got["aicc"] if got and got["aicc"] is not None and not math.isnan(got["aicc"]) else math.inf

    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(rounds):
        if hi - lo <= 1e-3 * hi:
            break
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = loss(b)
    if table is not None:
        table.drop()
    return (lo + hi) / 2


def auto_neighbours(points: DataFrame, fields: list[str], kernel: str = "bisquare", start: float | None = None, least: int = 20) -> int:
    """Golden-section search, over the whole numbers from ``least`` to all points, of the neighbour count with the
    least AICc for the first pair."""
    box = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count("*")).first()
    hi = box[4]
    lo, ratio, known = min(least, hi), (math.sqrt(5) - 1) / 2, {}
    start = start or math.hypot(box[1] - box[0], box[3] - box[2]) * math.sqrt(lo / max(hi, 1)) / 2 or 1.0

    def loss(k: int) -> float:
        if k not in known:
            got = diagnostics(regression(local_sums(weighted_pairs(points, fields[:2], kernel, k, True, start), fields[:2]))).first()
            known[k] = got["aicc"] if got and got["aicc"] is not None and not math.isnan(got["aicc"]) else math.inf
        return known[k]

    while hi - lo > 4:
        step = round(ratio * (hi - lo))
        a, b = hi - step, lo + step
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    for k in range(lo, hi + 1):
        loss(k)
    return min(known, key=lambda k: (known[k], k))


def percent_plan(percents: list[int], base: float, mode: str) -> list[tuple[int, float]]:
    """(percent, bandwidth) with the first percent of each bandwidth. Modes: raster (odd, at least 3), adaptive (a
    whole count, at least 2) and metric (tens, at least 10); halves round to even."""
    out: dict[float, int] = {}
    for percent in percents:
        value = base * percent / 100
        if mode == "raster":
            size = max(3, round(value))
            made = size + 1 if size % 2 == 0 else size
        elif mode == "adaptive":
            made = max(2, round(value))
        else:
            made = max(10, round(value / 10) * 10)
        out.setdefault(made, percent)
    return [(p, b) for b, p in out.items()]


def baseline(points: DataFrame, fields: list[str]) -> DataFrame:
    """What bandwidths are percents of, one row: the points with all fields, and the diagonal of their extent."""
    whole = complete_cases(points, fields)
    wide, high = F.max("px") - F.min("px"), F.max("py") - F.min("py")
    return whole.agg(F.count("*").alias("samples"), F.sqrt(wide * wide + high * high).alias("diagonal"))


def raster_baseline(infos: list[dict], most: int = 999) -> int:
    """The short side of the smallest raster in cells, ``most`` at most: what window sizes are percents of."""
    return min(most, *(min(i["width"], i["height"]) for i in infos))


def best_bandwidth(curve: DataFrame, metric: str, largest: bool = False, by: list[str] = ("pair_key",)) -> DataFrame:
    """The bandwidth with the least (or largest) metric, the smallest on a tie."""
    score = -F.col(metric) if largest else F.col(metric)
    return curve.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by("bandwidth", F.struct(score, F.col("bandwidth"))).alias("best_bandwidth"))
