"""Global agreement metrics of paired columns, each in one aggregation over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaccord.pairs import Pair, pairs


def complete_cases(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows without a missing value (null or NaN) in any of ``fields``."""
    return df.dropna(subset=list(dict.fromkeys(fields)))


def per_pair(df: DataFrame, fields: list[str], columns, extra: list[Column] = ()) -> DataFrame:
    """One aggregation whose columns (name, expression) per pair become one row a pair."""
    made = pairs(fields)
    parts = [[c.alias(f"p{i}_{n}") for n, c in columns(p)] for i, p in enumerate(made)]
    names = [n for n, _ in columns(made[0])]
    total = df.agg(*[c for part in parts for c in part], *extra)
    rows = [F.struct(F.lit(p.key).alias("pair_key"), F.lit(p.label).alias("pair_label"), *[F.col(f"p{i}_{n}").alias(n) for n in names]) for i, p in enumerate(made)]
    kept = [c for c in total.columns if not c.split("_")[0][1:].isdigit() or not c.startswith("p")]
    return total.select(F.explode(F.array(*rows)).alias("r"), *kept).select("r.*", *kept)


def attribute_metrics(df: DataFrame, fields: list[str]) -> DataFrame:
    """Mean, absolute, relative and squared error of y - x and correlation, over the complete cases of all fields.

    The relative error divides by the signed x and leaves out rows where x is 0.
    """
    usable = F.lit(True)
    for f in dict.fromkeys(fields):
        usable = usable & F.col(f).isNotNull() & ~F.isnan(f)
    flagged = df.withColumn("_usable", usable)

    def columns(p: Pair):
        y, x = (F.when(F.col("_usable"), F.col(c).cast("double")) for c in (p.y, p.x))
        d = y - x
        return [("me", F.avg(d)), ("mae", F.avg(F.abs(d))), ("mre", F.avg(F.when(x != 0, F.abs(d) / x))), ("rmse", F.sqrt(F.avg(d * d))), ("correlation", F.corr(y, x))]

    counts = [F.count(F.when(F.col("_usable"), 1)).alias("samples"), F.count(F.when(~F.col("_usable"), 1)).alias("dropped")]
    return per_pair(flagged, fields, columns, counts)


def matrix_metrics(df: DataFrame, fields: list[str]) -> DataFrame:
    """Error matrices over all ordered pairs i, j of fields (i = j included); the relative error is null where any
    denominator is 0."""
    rows = complete_cases(df, fields)
    cells = [(a, b) for a in fields for b in fields]
    out = []
    for i, (a, b) in enumerate(cells):
        d, x = F.col(a) - F.col(b), F.col(b)
        zero = F.max(F.when(x == 0, 1).otherwise(0)) == 1
        out += [F.avg(d).alias(f"m{i}_me"), F.avg(F.abs(d)).alias(f"m{i}_mae"), F.when(~zero, F.avg(F.abs(d) / F.nullif(x, F.lit(0.0)))).alias(f"m{i}_mre"), F.sqrt(F.avg(d * d)).alias(f"m{i}_rmse")]
    made = [F.struct(F.lit(a).alias("field_i"), F.lit(b).alias("field_j"), *[F.col(f"m{i}_{n}").alias(n) for n in ("me", "mae", "mre", "rmse")]) for i, (a, b) in enumerate(cells)]
    return rows.agg(*out).select(F.inline(F.array(*made)))


def scatter_stats(df: DataFrame, y: str, x: str) -> DataFrame:
    """Errors, correlation (0 where degenerate) and least-squares line y = a + b x over the complete rows."""
    d = F.col(y) - F.col(x)
    return complete_cases(df, [y, x]).agg(
        F.avg(d).alias("me"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.coalesce(F.corr(y, x), F.lit(0.0)).alias("r"), F.coalesce(F.regr_slope(F.col(y), F.col(x)), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(F.col(y), F.col(x)), F.avg(y)).alias("intercept"), F.count("*").alias("n"),
    )


def scatter_matrix(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per pair, over the rows where both are finite: r, rmse, mae, me and n of y - x."""

    def columns(p: Pair):
        both = F.col(p.y).isNotNull() & F.col(p.x).isNotNull() & ~F.isnan(p.y) & ~F.isnan(p.x)
        y, x = F.when(both, F.col(p.y)), F.when(both, F.col(p.x))
        d = y - x
        return [("r", F.corr(y, x)), ("rmse", F.sqrt(F.avg(d * d))), ("mae", F.avg(F.abs(d))), ("me", F.avg(d)), ("n", F.count(d))]

    return per_pair(df, fields, columns)


def raster_metrics(cells: DataFrame, layers: list[str], zero_epsilon: float = 1e-12) -> DataFrame:
    """Per pair of layers over the cells that both have: d = left - right, relative error by |left| over epsilon.
    Pairs without a common cell are left out."""

    def columns(p: Pair):
        both = F.col(p.y).isNotNull() & F.col(p.x).isNotNull() & ~F.isnan(p.y) & ~F.isnan(p.x)
        left, right = F.when(both, F.col(p.y)), F.when(both, F.col(p.x))
        d = left - right
        n = F.count(d)
        return [("me", F.avg(d)), ("mae", F.avg(F.abs(d))), ("mre", F.avg(F.when(F.abs(left) > zero_epsilon, F.abs(d / left)))), ("rmse", F.sqrt(F.avg(d * d))), ("correlation", F.when(n >= 2, F.corr(left, right))), ("valid_cells", n)]

    return per_pair(cells, layers, columns).where("valid_cells > 0")


def summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """Count, minimum, quartiles, maximum, mean and sample deviation of the finite values of each field."""
    finite = [F.when(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")), F.col(f).cast("double")).alias(f) for f in fields]
    clean = df.select(*finite)
    out = []
    for f in fields:
        out += [F.count(f).alias(f"{f}__count"), F.min(f).alias(f"{f}__min"), F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{f}__q"), F.max(f).alias(f"{f}__max"), F.avg(f).alias(f"{f}__mean"), F.stddev_samp(f).alias(f"{f}__sd")]
    rows = [
        F.struct(F.lit(f).alias("field"), F.col(f"{f}__count").alias("n"), F.col(f"{f}__min").alias("min"), F.col(f"{f}__q")[0].alias("q1"), F.col(f"{f}__q")[1].alias("median"), F.col(f"{f}__q")[2].alias("q3"), F.col(f"{f}__max").alias("max"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__sd").alias("sd"))
        for f in fields
    ]
    return clean.agg(*out).select(F.inline(F.array(*rows)))
