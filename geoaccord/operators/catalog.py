"""Data checks around an analysis: missing values, distinct values, samples, extents and catalog consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaccord.scratch import written


def blank(c: Column) -> Column:
    """Null or only white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def missing_report(df: DataFrame, fields: list[str], top: int | None = None) -> DataFrame:
    """(field, missing): fields with blank values; with ``top``, the fields that have most."""
    total = df.agg(*[F.sum(F.when(blank(F.col(f)), 1).otherwise(0)).alias(f) for f in fields])
    rows = total.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])))
    rows = rows.where("missing > 0")
    return rows.orderBy(F.desc("missing"), "field").limit(top) if top else rows


def distinct_values(df: DataFrame, value: str, order: str, limit: int = 500) -> DataFrame:
    """(value, first_seen): distinct values as text in order of first appearance, at most ``limit``."""
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("value")).agg(F.min(order).alias("first_seen"))
    return seen.orderBy("first_seen", "value").limit(limit)


def positions(df: DataFrame, order: list[str], at: str = "position") -> tuple[DataFrame, int]:
    """``df`` with the position of each row, from 0, in the order of some columns, and the number of rows.

    Ranges of the order are sorted apart and their counts summed, so no task sorts all rows. The ranges are written, as
    sampling them again after a loss could cut them elsewhere.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, n = [], 0
    for row in parts.groupBy("_range").count().orderBy("_range").collect():  # one row a range
        starts.append((row["_range"], n))
        n += row["count"]
    begin = df.sparkSession.createDataFrame(starts, "_of int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = parts.withColumn(at, inside).join(F.broadcast(begin), F.col("_range") == F.col("_of"))
    return placed.withColumn(at, F.col("_start") + F.col(at)).select(*df.columns, at), n


def systematic_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """Rows at even steps of a dense key: every max(1, n // limit)-th."""
    step = max(1, df.count() // limit)
    first = df.agg(F.min(order)).first()[0] or 0
    return df.where(F.pmod(F.col(order) - first, F.lit(step)) == 0)


def spaced_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``limit`` rows (all where there are fewer) at even, fractional steps of the order, the first and the last among
    them."""
    placed, n = positions(df, order)
    if n <= limit or limit < 2:
        return placed.where(F.col("position") < limit).drop("position")
    step = (n - 1) / (limit - 1)
    slot = F.floor(F.col("position") / step + 0.5)
    return placed.where(F.floor(slot * step + 0.5) == F.col("position")).drop("position")


def extents(df: DataFrame) -> DataFrame:
    """Union and intersection of (xmin, ymin, xmax, ymax) rows; the intersection is null where it is empty."""
    box = df.agg(
        F.min("xmin").alias("union_xmin"), F.min("ymin").alias("union_ymin"), F.max("xmax").alias("union_xmax"), F.max("ymax").alias("union_ymax"),
        F.max("xmin").alias("x1"), F.max("ymin").alias("y1"), F.min("xmax").alias("x2"), F.min("ymax").alias("y2"),
    )
    some = (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))
    return box.select("union_xmin", "union_ymin", "union_xmax", "union_ymax", *[F.when(some, F.col(a)).alias(f"common_{b}") for a, b in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))])


def consistency(catalog: DataFrame, crs: str, resolution: float, fmt: str) -> DataFrame:
    """Flags of catalog rows against a project's standard, and what to do about them.

    The reference system is checked except for attribute tables, the resolution for rasters, the format except for
    tables in CSV or Excel.
    """
    c = F.col
    crs_off = (c("data_type") != "attribute") & (c("crs") != crs)
    res_off = (c("data_type") == "raster") & (c("resolution") != resolution)
    fmt_off = ~c("format").isin("CSV", "Excel") & (c("format") != fmt)
    steps = F.array_compact(F.array(F.when(crs_off, "reproject"), F.when(res_off, "resample"), F.when(fmt_off, "convert")))
    flags = [F.coalesce(f, F.lit(False)).alias(n) for f, n in ((crs_off, "crs_off"), (res_off, "resolution_off"), (fmt_off, "format_off"))]
    return catalog.select("name", "data_type", *flags, F.when(F.size(steps) > 0, F.concat_ws("+", steps)).otherwise("none").alias("action"))


def numeric_fields(df: DataFrame) -> list[str]:
    """Fields with a numeric type."""
    return [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def field_union(frames: list[DataFrame]) -> list[str]:
    """Numeric fields of all sources in order of first appearance."""
    return list(dict.fromkeys(f for df in frames for f in numeric_fields(df)))


def append_result(df: DataFrame, result: DataFrame, on: str = "feature_id") -> DataFrame:
    """Source rows with the result's columns, null where a row was left out of the analysis."""
    other = result.withColumnRenamed(on, "_on")
    return df.join(other, F.col(on) == F.col("_on"), "left").drop("_on")


def path_map(df: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Paths replaced by the aligned path of a manifest (source_path, aligned_path) where there is one."""
    m = manifest.select("source_path", "aligned_path")
    return df.join(m, F.col(path) == F.col("source_path"), "left").withColumn(path, F.coalesce("aligned_path", path)).drop("source_path", "aligned_path")


def nearest(values: DataFrame, steps: DataFrame, value: str, step: str) -> DataFrame:
    """For each value the nearest step, the smaller on a tie. ``steps`` is a short scale."""
    scale = steps.agg(F.sort_array(F.collect_set(step)).alias("_scale"))
    at = F.array_min(F.transform("_scale", lambda s: F.struct(F.abs(s - F.col(value)).alias("d"), s.alias("s"))))["s"]
    return values.crossJoin(F.broadcast(scale)).withColumn("nearest", at).drop("_scale")


def percent_of(values: DataFrame, known: DataFrame, value: str, default: int = 50) -> DataFrame:
    """``values`` with the ``percent`` that a snapshot (value, percent) has for each value, else the default."""
    side = known.select(F.col("value").alias("_value"), F.col("percent").alias("_percent"))
    return values.join(side, F.col(value) == F.col("_value"), "left").withColumn("percent", F.coalesce("_percent", F.lit(default))).drop("_value", "_percent")


def local_values(df: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """One column ``value``: the finite values of a field, rounded."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(F.round(v, digits).alias("value"))


def containing(df: DataFrame, fields: list[str], keyword: str) -> DataFrame:
    """Rows of which any of the fields holds the keyword, whatever its case; all rows for an empty keyword."""
    found = F.lit(not keyword)
    for f in fields:
        found = found | F.coalesce(F.lower(F.col(f).cast("string")).contains(keyword.lower()), F.lit(False))
    return df.where(found)


def sorted_table(df: DataFrame, column: str, descending: bool = False, ties: list[str] = ()) -> DataFrame:
    """The rows of a table by one of its columns: numbers in text by their value before other text, nulls and blanks last
    in either direction, ``ties`` rising within equal values. The sort is distributed, by ranges."""
    if column not in df.columns:
        raise ValueError(f"there is no column {column}")
    text = F.trim(F.col(column).cast("string"))
    number = F.col(column).try_cast("double")
    order = [F.coalesce(text, F.lit("")) == "", number.isNull(), number, F.col(column).cast("string")]
    falling = [order[0], *(o.desc() for o in order[1:])]
    return df.orderBy(*(falling if descending else order), *ties)
