"""Exact medians of groups of any size.

A median as one aggregate gathers all values of a group in one task. Here each round counts the values of each group by
equal bins of the interval that is known to hold its middle, and keeps the bin that does; few rounds leave few values.
What a round brings to the driver is a row a group and column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaccord.scratch import drop, written

#: Bins of a round, and values of an interval that are sorted at last.
BINS, FEW = 1024, 100_000
GREATEST = 1.7976931348623157e308


def medians(rows: DataFrame, by: str, columns: list[str], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(``by``, one column a median) for every group: the middle value, or the mean of the two in the middle, of the values
    that are neither null nor NaN; null where there is none. A null group is a group. ``rows`` is read once."""
    spark = rows.sparkSession
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    table = written(rows.select(F.col(by).alias("g"), each), "values")
    kept = table.where(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = {(r["g"], r["which"]): r for r in kept.groupBy("g", "which").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    groups = [r["g"] for r in table.select("g").distinct().collect()]
    middle = {k: ((r["n"] - 1) // 2, r["n"] // 2) for k, r in whole.items()}  # places of the two in the middle, from 0
    ends = {k: r["lo"] for k, r in whole.items() if r["lo"] == r["hi"]}
    # (group, column) -> (low, high, values below low, values from low to high)
    open_ = {k: (r["lo"], r["hi"], 0, r["n"]) for k, r in whole.items() if k not in ends}
    last = {}
    kind = table.schema["g"].dataType.simpleString()

    def inside(of: dict) -> DataFrame:
        # a row a group and column
        limits = spark.createDataFrame([(g, w, s[0], s[1]) for (g, w), s in of.items()], f"_g {kind}, _which int, lo double, hi double")
        met = kept.join(F.broadcast(limits), F.col("g").eqNullSafe(F.col("_g")) & (F.col("which") == F.col("_which")))
        return met.where(F.col("v").between(F.col("lo"), F.col("hi"))).select("g", "which", "v", "lo", "hi")

    while open_:
        last |= {k: s for k, s in open_.items() if s[3] <= few}
        open_ = {k: s for k, s in open_.items() if k not in last}
        if not open_:
            break
        # halves, as the width of an interval may be no number; infinite ends count as the greatest numbers
        half = lambda c: F.greatest(F.lit(-GREATEST), F.least(F.lit(GREATEST), F.col(c))) / 2
        share = (half("v") - half("lo")) / (half("hi") - half("lo"))
        place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins))).alias("bin")
        found: dict = {}
        for r in inside(open_).groupBy("g", "which", place).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            found.setdefault((r["g"], r["which"]), []).append(r)  # at most ``bins`` rows a group and column
        for key, rows_ in found.items():
            low, high = middle[key]
            below, held = open_[key][2], []
            for r in sorted(rows_, key=lambda r: r["bin"]):
                if below <= high and below + r["n"] > low:
                    held.append((r["lo"], r["hi"], below, r["n"]))
                below += r["n"]
            if len(held) == 2:  # the last of a bin and the first of the next
                ends[key] = (held[0][1] + held[1][0]) / 2
            elif held[0][0] == held[0][1]:
                ends[key] = held[0][0]
            elif held[0] == open_[key]:  # an interval too narrow for bins
                last[key] = held[0]
            else:
                open_[key] = held[0]
                continue
            del open_[key]
    if last:
        at = spark.createDataFrame([(g, w, *(p - s[2] + 1 for p in middle[g, w])) for (g, w), s in last.items()], f"_g {kind}, _which int, a int, b int")
        lists = inside(last).groupBy("g", "which").agg(F.sort_array(F.collect_list("v")).alias("v"))
        picked = lists.join(F.broadcast(at), F.col("g").eqNullSafe(F.col("_g")) & (F.col("which") == F.col("_which")))
        for r in picked.select("g", "which", ((F.element_at("v", F.col("a")) + F.element_at("v", F.col("b"))) / 2).alias("m")).collect():
            ends[r["g"], r["which"]] = r["m"]
    drop(table)
    found = [(g, *(None if (m := ends.get((g, k))) is None or math.isnan(m) else float(m) for k in range(len(columns)))) for g in groups]
    return spark.createDataFrame(found, f"`{by}` {kind}, " + ", ".join(f"`{c}` double" for c in columns))
