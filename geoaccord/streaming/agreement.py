"""An extension: running agreement of two measures over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(stream: DataFrame, y: str, x: str, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Errors of y - x per tumbling window, rows later than ``late`` left out. Works on streams and on tables."""
    d = F.col(y) - F.col(x)
    seen = stream.withWatermark(time, late).where(F.col(y).isNotNull() & F.col(x).isNotNull())
    made = seen.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg(d).alias("me"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "me", "mae", "rmse")
