"""Classification of values, colour ramps, histograms and densities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaccord.operators import catalog
from geoaccord.scratch import written

JENKS_SAMPLE = 1024
DENSITY_REACH = 9
TOP_CLASSES = 64
#: Types whose values are classified as numbers.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: The name of the class of all other values, the stops of the sequential and of the diverging ramp, the
#: base colours of categories, and the golden ratio's part that spreads further hues.
OTHER = "其他"
SEQUENTIAL = ["#ffffd9", "#c7e9b4", "#7fcdbb", "#41b6c4", "#1d91c0", "#225ea8", "#0c2c84"]
DIVERGING = ["#2166ac", "#67a9cf", "#d1e5f0", "#f7f7f7", "#fddbc7", "#ef8a62", "#b2182b"]
CATEGORIES = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac", "#86bcb6", "#d37295"]
GOLDEN = 0.6180339887


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value.cast("double"))


def dedupe(breaks: list[float]) -> list[float]:
    """Breaks without equal neighbours; a single one is doubled, so that there is one class."""
    out = [b for k, b in enumerate(breaks) if k == 0 or b != breaks[k - 1]]
    return out if len(out) > 1 else out * 2


def equal_breaks(df: DataFrame, value: str, classes: int) -> DataFrame:
    """One row: ``breaks`` of equal width from the least to the largest value."""
    ends = df.agg(F.min(finite(F.col(value))).alias("lo"), F.max(finite(F.col(value))).alias("hi"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: F.when(i == classes, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * i / classes))
    return ends.select(F.when(F.col("lo") == F.col("hi"), F.array("lo", "hi")).otherwise(steps).alias("breaks"))


def quantile_breaks(df: DataFrame, value: str, classes: int) -> DataFrame:
    """One row: linearly interpolated quantiles without repeats."""
    shares = F.array(*[F.lit(i / classes) for i in range(classes + 1)])
    made = df.agg(F.array_distinct(F.percentile(finite(F.col(value)), shares)).alias("b"))
    return made.select(F.when(F.size("b") == 1, F.array(F.col("b")[0], F.col("b")[0])).otherwise(F.col("b")).alias("breaks"))


def manual_breaks(df: DataFrame, value: str, wanted: list) -> DataFrame:
    """One row: the wanted breaks that are numbers inside the range, with the ends of the range."""
    numbers = []
    for w in wanted:
        try:
            number = float(w)
        except (TypeError, ValueError):
            continue
        if math.isfinite(number):
            numbers.append(number)
    ends = df.agg(F.min(finite(F.col(value))).alias("lo"), F.max(finite(F.col(value))).alias("hi"))
    inside = F.filter(F.array(*[F.lit(n) for n in sorted(numbers)]).cast("array<double>"), lambda b: (b > F.col("lo")) & (b < F.col("hi")))
    made = ends.select(F.array_distinct(F.concat(F.array("lo"), inside, F.array("hi"))).alias("b"))
    return made.select(F.when(F.size("b") == 1, F.array(F.col("b")[0], F.col("b")[0])).otherwise(F.col("b")).alias("breaks"))


def class_of(value: Column, breaks: Column) -> Column:
    """Index of the class [b_i, b_i+1) of a value, the ends clamped; null for a missing value."""
    below = F.size(F.filter(breaks, lambda b: b <= value))
    return F.when(finite(value).isNotNull(), F.least(F.greatest(below - 1, F.lit(0)), F.size(breaks) - 2))


def assign(df: DataFrame, value: str, breaks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with the class of the value; ``breaks`` is one row."""
    return df.crossJoin(F.broadcast(breaks)).select(*keep, class_of(F.col(value), F.col("breaks")).cast("int").alias("class_id"))


def natural_breaks(values: np.ndarray, classes: int) -> list[float]:
    """Breaks that minimise the squared deviations inside classes: the least value, then the largest of each class.

    Dynamic programming over the sorted values; of equal splits the first is taken.
    """
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n == 0:
        return []
    classes = min(classes, len(np.unique(x)))
    s1, s2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    ends = np.arange(1, n + 1)
    cost = s2[ends] - s1[ends] ** 2 / ends
    cut = np.zeros((classes, n), int)
    for k in range(1, classes):
        new = np.full(n, np.inf)
        for j in range(k, n):
            first = np.arange(k, j + 1)
            size = j + 1 - first
            inside = s2[j + 1] - s2[first] - (s1[j + 1] - s1[first]) ** 2 / size
            total = cost[first - 1] + inside
            best = int(np.argmin(total))
            new[j], cut[k, j] = total[best], first[best]
        cost = new
    edges, j = [], n - 1
    for k in range(classes - 1, -1, -1):
        edges.append(float(x[j]))
        j = cut[k, j] - 1
    return dedupe([float(x[0]), *edges[::-1]])


def stride_sample(df: DataFrame, value: str, order: str, limit: int) -> DataFrame:
    """Evenly spaced ones of the sorted values, the least and the largest among them: at most ``limit`` rows."""
    clean = df.select(finite(F.col(value)).alias("v"), F.col(order).alias("o")).where("v is not null")
    return catalog.spaced_sample(clean, ["v", "o"], limit).select("v")


def jenks_breaks(df: DataFrame, value: str, classes: int, order: str, limit: int = JENKS_SAMPLE) -> list[float]:
    """Natural breaks of the values, or of at most ``limit`` evenly spaced ones."""
    sample = np.array([r[0] for r in stride_sample(df, value, order, limit).collect()])
    return natural_breaks(sample, classes)


def top_classes(df: DataFrame, value: str, top: int = TOP_CLASSES) -> DataFrame:
    """(class_id, class_label, n): classes of the values in their order, numbers by size and text by its bytes. Of more
    than ``top`` values the most frequent stay (ties by value), and the rest are one class at the end. Numbers that are
    whole to 1e-9 are labelled without decimals."""
    number = F.col(value).cast("double") if dict(df.dtypes)[value].split("(")[0] in NUMBERS else F.lit(None).cast("double")
    text = F.col(value).cast("string")
    whole = F.abs(number - F.round(number)) < 1e-9
    label = F.when(whole & (F.abs(number) < 1e15), F.round(number).cast("long").cast("string")).otherwise(text)
    counts = written(df.where(F.col(value).isNotNull()).groupBy(number.alias("number"), label.alias("v")).agg(F.count("*").alias("n")), "values")
    of, merged = counts, counts.count() > top
    if merged:
        of = counts.orderBy(F.desc("n"), F.col("number").asc_nulls_last(), "v").limit(top - 1)
    best = of.agg(F.sort_array(F.collect_list(F.struct(F.col("number").isNull().alias("text"), "number", "v", "n"))).alias("o"))  # top rows at most
    named = best.select(F.posexplode("o").alias("class_id", "o")).select("class_id", F.col("o.v").alias("class_label"), F.col("o.n").alias("n"))
    if not merged:
        return named
    named = written(named, "classes")
    rest = counts.agg(F.sum("n").alias("all")).crossJoin(F.broadcast(named.agg(F.sum("n").alias("some"))))
    return named.union(rest.select(F.lit(top - 1), F.lit(OTHER), (F.col("all") - F.col("some"))))


def histogram_bins(n: int) -> int:
    return max(5, min(30, int(math.sqrt(n)) * 2))


def histogram(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """(bin, lo, hi, n) over the range of the values, the last bin closed; empty bins included."""
    clean = df.select(finite(F.col(value)).alias("v")).where("v is not null")
    ends = clean.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"))
    count = F.lit(bins) if bins else F.greatest(F.lit(5), F.least(F.lit(30), F.floor(F.sqrt("m")) * 2))
    ends = ends.withColumn("bins", count.cast("int")).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    filled = clean.crossJoin(F.broadcast(ends)).groupBy(at.alias("_b")).agg(F.count("*").alias("_n"))
    frame = ends.where("m > 0").select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "width")
    low = F.col("lo") + F.col("bin") * F.col("width")
    return frame.join(filled, F.col("bin") == F.col("_b"), "left").select("bin", low.alias("bin_lo"), (low + F.col("width")).alias("bin_hi"), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def density(df: DataFrame, value: str, bins: int = 18, points: int = 160) -> DataFrame:
    """Gaussian kernel density at evenly spaced points, scaled to the counts of a histogram of ``bins``.

    The bandwidth is the larger of std n ^ (-1/5) and a eightieth of the range. A value adds to the points within
    DENSITY_REACH bandwidths only, beyond which its weight is below 2 ** -53.
    """
    clean = df.select(finite(F.col(value)).alias("v")).where("v is not null")
    ends = clean.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"), F.stddev_pop("v").alias("sd"))
    span = F.col("hi") - F.col("lo")
    ends = ends.withColumn("bw", F.greatest(F.col("sd") * F.pow(F.col("m").cast("double"), -0.2), span / 80)).withColumn("step", span / (points - 1)).where("bw > 0")
    at = F.col("lo") + F.col("k") * F.col("step")
    q = (at - F.col("v")) / F.col("bw")
    place = lambda shift: (F.col("v") + shift * F.col("bw") - F.col("lo")) / F.col("step")
    reached = F.sequence(F.greatest(F.lit(0), F.ceil(place(-DENSITY_REACH)).cast("int")), F.least(F.lit(points - 1), F.floor(place(DENSITY_REACH)).cast("int")))
    sums = clean.crossJoin(F.broadcast(ends)).select("*", F.explode(reached).alias("k")).groupBy(F.col("k").alias("_k")).agg(F.sum(F.exp(-0.5 * q * q)).alias("s"))
    scale = (F.col("hi") - F.col("lo")) / bins / (F.col("bw") * math.sqrt(2 * math.pi))
    grid = ends.select("lo", "hi", "bw", "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return grid.join(sums, F.col("k") == F.col("_k"), "left").select(F.col("k").alias("point"), at.alias("x"), (F.coalesce("s", F.lit(0.0)) * scale).alias("density"))


def _hex(rgb) -> str:
    return "#" + "".join(f"{max(0, min(255, round(c))):02x}" for c in rgb)


def _rgb(text: str) -> tuple[int, int, int]:
    return tuple(int(text.lstrip("#")[k : k + 2], 16) for k in (0, 2, 4))


def ramp(stops: list[str], n: int) -> list[str]:
    """``n`` colours linearly between the stops."""
    out = []
    for i in range(n):
        at = i / (n - 1) * (len(stops) - 1) if n > 1 else 0.0
        k = min(int(at), len(stops) - 2)
        a, b, f = _rgb(stops[k]), _rgb(stops[k + 1]), at - k
        out.append(_hex([u + (v - u) * f for u, v in zip(a, b)]))
    return out


def numeric_ramp(least: float, n: int, sequential: list[str] = SEQUENTIAL, diverging: list[str] = DIVERGING) -> list[str]:
    """A diverging ramp where values are below 0, else a sequential one."""
    return ramp(diverging if least < 0 else sequential, n)


def category_colours(n: int, base: list[str] = CATEGORIES) -> list[str]:
    """The base colours while they last; for more classes, hues a golden angle apart in three shades."""
    if n <= len(base):
        return base[:n]
    return [hsl(k * GOLDEN % 1 * 360, 0.6, 0.38 + 0.13 * (k % 3)) for k in range(n)]


def classify(df: DataFrame, value: str, method: str = "natural", classes: int = 5, manual: list | None = None, order: str = "feature_id") -> DataFrame:
    """(class_id, label, n, colour) of a field: breaks by ``method`` (natural, equal, quantile, manual) with a ramp, or
    unique values with category colours where the method is unique or the field is text."""
    spark = df.sparkSession
    if method == "unique" or dict(df.dtypes)[value] in ("string", "boolean", "date"):
        found = top_classes(df, value).orderBy("class_id").collect()  # at most TOP_CLASSES
        colours = category_colours(len(found))
        rows = [(k, r["class_label"], r["n"], c) for k, (r, c) in enumerate(zip(found, colours))]
        return spark.createDataFrame(rows, "class_id int, label string, n long, colour string")
    made = {"equal": lambda: equal_breaks(df, value, classes), "quantile": lambda: quantile_breaks(df, value, classes), "manual": lambda: manual_breaks(df, value, manual or [])}
    breaks = made[method]().first()[0] if method in made else jenks_breaks(df, value, classes, order)
    if not breaks or breaks[0] is None:
        return spark.createDataFrame([], "class_id int, label string, n long, colour string")
    frame = spark.createDataFrame([([float(b) for b in breaks],)], "breaks array<double>")
    counts = {r["class_id"]: r["n"] for r in assign(df, value, frame, []).where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("n")).collect()}
    colours = numeric_ramp(float(breaks[0]), len(breaks) - 1)
    rows = [(k, legend_label(a, b), counts.get(k, 0), c) for k, (a, b, c) in enumerate(zip(breaks, breaks[1:], colours))]
    return spark.createDataFrame(rows, "class_id int, label string, n long, colour string")


def hsl(hue: float, saturation: float, light: float) -> str:
    c = (1 - abs(2 * light - 1)) * saturation
    x = c * (1 - abs(hue / 60 % 2 - 1))
    parts = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)][int(hue // 60) % 6]
    return _hex([(p + light - c / 2) * 255 for p in parts])


def grey_legend(n: int) -> list[str]:
    return [_hex([60 + 175 * i / (n - 1) if n > 1 else 60] * 3) for i in range(n)]


def legend_label(lo: float, hi: float) -> str:
    show = lambda v: str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else f"{v:.4g}"
    return f"{show(lo)}–{show(hi)}"
