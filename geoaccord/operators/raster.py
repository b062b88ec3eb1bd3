"""Rasters as long tables (r, c, value columns): focal windows, previews, stretches and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaccord.functions.crs import transform
from geoaccord.operators.catalog import spaced_sample
from geoaccord.operators.metrics import raster_metrics
from geoaccord.operators.ranks import medians
from geoaccord.operators.windows import focal_tiles

EPSILON = 1e-12
#: Points along each side of a grid whose bounds are found in another system.
EDGE_POINTS = 32


def check_window(size: int) -> int:
    if size < 3 or size % 2 == 0:
        raise ValueError("a window is an odd number from 3")
    return size


def clean(value: Column, nodata: float = -9999.0) -> Column:
    """A cell value, null where it is the no-data mark or not finite."""
    return F.when((value == nodata) | F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def box_sums(cells: DataFrame, values: dict[str, Column], sizes: list[int]) -> DataFrame:
    """(r, c, size, sums): sums of each value over the square windows around every cell, along rows and then along
    columns. Nulls count 0. All sizes share one sort of the rows and one of the columns."""
    halves = [check_window(size) // 2 for size in sizes]
    over = lambda part, order, half: Window.partitionBy(part).orderBy(order).rangeBetween(-half, half)
    first = cells.select("r", "c", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"_{k}") for k, v in values.items()])
    along = first.select("r", "c", *[F.sum(f"_{k}").over(over("r", "c", half)).alias(f"{k}_{half}") for half in halves for k in values])
    both = along.select("r", "c", *[F.sum(f"{k}_{half}").over(over("c", "r", half)).alias(f"{k}_{half}") for half in halves for k in values])
    each = [F.struct(F.lit(size).alias("size"), *[F.col(f"{k}_{half}").alias(k) for k in values]) for size, half in zip(sizes, halves)]
    return both.select("r", "c", F.inline(F.array(*each)))


def focal(cells: DataFrame, size: int, left: str = "left_v", right: str = "right_v", epsilon: float = EPSILON) -> DataFrame:
    """Local error, correlation and no-intercept regression (left on right) in the window around every cell."""
    return focal_sizes(cells, [size], left, right, epsilon).drop("size")


def focal_sizes(cells: DataFrame, sizes: list[int], left: str = "left_v", right: str = "right_v", epsilon: float = EPSILON) -> DataFrame:
    """The statistics of :func:`focal` for several window sizes.

    Cells where both layers have a value count; results exist also where the centre has none. Shifting the values by
    constants keeps the moments of the correlation small; the regression uses the values as they are.
    """
    both = F.col(left).isNotNull() & F.col(right).isNotNull() & ~F.isnan(left) & ~F.isnan(right)
    y, x = F.when(both, F.col(left)), F.when(both, F.col(right))
    d = y - x
    far = F.abs(y) > epsilon
    s = box_sums(
        cells,
        {"n": F.when(both, 1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "sd": d, "sa": F.abs(d), "sdd": d * d, "sr": F.when(far, F.abs(d / y)), "nr": F.when(far, 1.0)},
        sizes,
    )
    c = F.col
    vx, vy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    corr = (c("sxy") - c("sx") * c("sy") / c("n")) / F.sqrt(vx * vy)
    clamp = lambda v, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), v))
    some = c("n") > 0
    return (
        s.withColumn("coefficient", F.when((c("n") >= 2) & (c("sxx") > epsilon), c("sxy") / c("sxx")))
        .withColumns({
            "local_me": F.when(some, c("sd") / c("n")),
            "local_mae": F.when(some, c("sa") / c("n")),
            "local_rmse": F.when(some, F.sqrt(F.greatest(F.lit(0.0), c("sdd") / c("n")))),
            "local_mre": F.when(c("nr") > 0, c("sr") / c("nr")),
            "local_corr": F.when((c("n") >= 3) & (vx > epsilon) & (vy > epsilon), clamp(corr, -1.0)),
            "local_r2": F.when(c("coefficient").isNotNull() & (c("syy") > epsilon), clamp(1 - (c("syy") - 2 * c("coefficient") * c("sxy") + c("coefficient") * c("coefficient") * c("sxx")) / c("syy"), 0.0)),
        })
        .select("r", "c", "size", F.col("n").cast("long").alias("n"), "local_me", "local_mae", "local_mre", "local_rmse", "local_corr", "coefficient", "local_r2")
    )


def window_sweep(cells: DataFrame, sizes: list[int], left: str = "left_v", right: str = "right_v") -> DataFrame:
    """Medians of the focal statistics for each window size."""
    names = ("local_mae", "local_rmse", "local_corr", "coefficient", "local_r2")
    found = focal_tiles(cells, [check_window(size) for size in dict.fromkeys(sizes)], left, right, columns=names)
    return medians(found.withColumnRenamed("size", "window_size"), "window_size", list(names)).toDF("window_size", *[f"{k}_median" for k in names])


def block_mean(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """Means of ``factor`` x ``factor`` blocks, nulls left out."""
    return cells.groupBy(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.avg(value).alias("value"))


def preview_factor(height: int, width: int, limit: int) -> int:
    return max(1, -(-max(height, width) // limit))


def stretch(cells: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """0 .. 255 between two percentiles, and alpha 0 where there is no value. Equal limits fall back to the range,
    and then to the minimum plus 1."""
    p = cells.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("p"), F.min(value).alias("mn"), F.max(value).alias("mx"))
    lo = F.when(F.col("p")[1] > F.col("p")[0], F.col("p")[0]).otherwise(F.col("mn"))
    hi = F.when(F.col("p")[1] > F.col("p")[0], F.col("p")[1]).otherwise(F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mn") + 1))
    limits = p.select(lo.alias("_lo"), hi.alias("_hi"))  # one row
    scaled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255))).cast("int")
    return cells.crossJoin(F.broadcast(limits)).select("r", "c", F.coalesce(scaled, F.lit(0)).alias("grey"), F.when(F.col(value).isNull(), 0).otherwise(255).alias("alpha"))


def _weights(method: str, f: Column) -> list[tuple[int, Column]]:
    """(offset, weight) along one axis of the source cells around a position with fraction f."""
    if method == "near":
        return [(0, F.lit(1.0))]
    if method == "bilinear":
        return [(0, 1 - f), (1, f)]
    a = -0.5  # Catmull-Rom cubic convolution (Keys 1981)
    near = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1
    far = lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return [(-1, far(f + 1)), (0, near(f)), (1, near(1 - f)), (2, far(2 - f))]


def resample(target: DataFrame, source: DataFrame, value: str, row_at: Column, col_at: Column, method: str = "bilinear") -> DataFrame:
    """(r, c, value) of the target cells from the source grid at fractional source positions of cell centres.

    Each target cell lists its 1, 4 or 16 source cells, joins them by (row, column) and takes the weighted mean over
    those with a value; a cell without any is null.
    """
    placed = target.select("r", "c", row_at.alias("_y"), col_at.alias("_x"))
    if method == "near":
        placed = placed.select("r", "c", F.floor(F.col("_y") + 0.5).alias("_r"), F.floor(F.col("_x") + 0.5).alias("_c"), F.lit(0.0).alias("_fy"), F.lit(0.0).alias("_fx"))
    else:
        placed = placed.select("r", "c", F.floor("_y").alias("_r"), F.floor("_x").alias("_c"), (F.col("_y") - F.floor("_y")).alias("_fy"), (F.col("_x") - F.floor("_x")).alias("_fx"))
    around = [F.struct((F.col("_r") + a).cast("int").alias("sr"), (F.col("_c") + b).cast("int").alias("sc"), (wa * wb).alias("w")) for a, wa in _weights(method, F.col("_fy")) for b, wb in _weights(method, F.col("_fx"))]
    wanted = placed.select("r", "c", F.inline(F.array(*around)))
    have = source.select(F.col("r").cast("int").alias("_sr"), F.col("c").cast("int").alias("_sc"), F.col(value).alias("_v"))
    met = wanted.join(have.hint("merge"), (F.col("sr") == F.col("_sr")) & (F.col("sc") == F.col("_sc")), "left")
    total = F.sum(F.when(F.col("_v").isNotNull(), F.col("w")))
    return met.groupBy("r", "c").agg(F.when(F.abs(total) > EPSILON, F.sum(F.col("w") * F.col("_v")) / total).alias("value"))


def pairwise(cells: DataFrame, layers: list[str], epsilon: float = EPSILON) -> DataFrame:
    return raster_metrics(cells, layers, epsilon)


def pixel_sample(cells: DataFrame, limit: int = 50_000, left: str = "left_v", right: str = "right_v") -> DataFrame:
    """At most ``limit`` cells with both values, evenly spaced in the order of rows and columns (data of a scatter plot)."""
    return spaced_sample(cells.where(F.col(left).isNotNull() & F.col(right).isNotNull()), ["r", "c"], limit)


def preflight(infos: list[dict]) -> None:
    """Raise where rasters (as :func:`geoaccord.sources.tiff.read_info` describes them) cannot be compared."""
    if len(infos) < 2:
        raise ValueError("two rasters or more are needed")
    for k, info in enumerate(infos):
        if info["bands"] != 1:
            raise ValueError(f"raster {k + 1} has {info['bands']} bands")
        if info["epsg"] is None or info["extent"] is None:
            raise ValueError(f"raster {k + 1} has no reference system or no place")


def align(source: DataFrame, own: dict, target: dict, method: str = "bilinear") -> DataFrame:
    """(r, c, value) of ``source`` on the grid of another raster, also in another reference system (that of an EPSG code in
    ``epsg``, or any in ``crs``): the centres of its cells are taken to the plane of the source."""
    width, height = target["width"], target["height"]
    grid = source.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    (dx, dy), (sx, sy) = target["cell"], own["cell"]
    x, y = target["extent"][0] + (F.col("c") + 0.5) * dx, target["extent"][3] - (F.col("r") + 0.5) * dy
    there, here = (info.get("crs") or info["epsg"] for info in (target, own))
    if there != here:
        x, y = transform(there, here, x, y)
    return resample(grid, source, "value", (own["extent"][3] - y) / sy - 0.5, (x - own["extent"][0]) / sx - 0.5, method)


def grid_in(spark, own: dict, crs) -> dict:
    """A grid in another reference system of as many cells over the bounds of a raster, by points along its sides."""
    xmin, ymin, xmax, ymax = own["extent"]
    at = [k / EDGE_POINTS for k in range(EDGE_POINTS + 1)]
    edge = [(xmin + u * (xmax - xmin), ymin + v * (ymax - ymin)) for t in at for u, v in ((t, 0.0), (t, 1.0), (0.0, t), (1.0, t))]
    x, y = transform(own.get("crs") or own["epsg"], crs, F.col("x"), F.col("y"))
    box = spark.createDataFrame(edge, "x double, y double").select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    cell = ((box[2] - box[0]) / own["width"], (box[3] - box[1]) / own["height"])
    return {"width": own["width"], "height": own["height"], "bands": 1, "nodata": None, "cell": cell, "extent": list(box), "epsg": None, "crs": crs}


def overlay(layers: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """(r, c, one column a layer) of rasters (r, c, value) on one grid; cells that a raster lacks are null."""
    rows = None
    for name, cells in layers.items():
        one = cells.select("r", "c", F.struct(F.lit(name).alias("layer"), F.col(value).alias("v")).alias("x"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("r", "c").agg(*[F.max(F.when(F.col("x.layer") == name, F.col("x.v"))).alias(name) for name in layers])
