"""Focal statistics of many window sizes at a cost that does not grow with the sizes.

Cells go to square tiles with a rim of half the largest window, so a tile has what its windows need. Sums of a size are
taken along rows and then along columns, each from running sums forth and back within blocks as long as the window: a window
is the end of one block and the start of the next. That takes three additions a cell for every size, and never subtracts
running sums of a whole tile, which would lose the digits of flat regions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along the side of a tile.
SIDE = 128
STATISTICS = ("local_me", "local_mae", "local_mre", "local_rmse", "local_corr", "coefficient", "local_r2")
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "sd", "sa", "sdd", "sr", "nr")


def slid(values: np.ndarray, size: int) -> np.ndarray:
    """Sums of all windows of ``size`` along the last axis that lie inside it."""
    long = values.shape[-1]
    blocks = np.pad(values, [(0, 0)] * (values.ndim - 1) + [(0, -long % size)]).reshape(*values.shape[:-1], -1, size)
    forth = blocks.cumsum(-1).reshape(*values.shape[:-1], -1)
    back = blocks[..., ::-1].cumsum(-1)[..., ::-1].reshape(forth.shape)
    first = np.arange(long - size + 1)
    return back[..., first] + np.where(first % size > 0, forth[..., first + size - 1], 0.0)


def statistics(s: dict[str, np.ndarray], epsilon: float) -> dict[str, np.ndarray]:
    """The statistics of windows from their sums, NaN where they are not defined."""
    n = s["n"]
    with np.errstate(all="ignore"):
        slope = np.where((n >= 2) & (s["sxx"] > epsilon), s["sxy"] / s["sxx"], np.nan)
        vx, vy = s["sxx"] - s["sx"] * s["sx"] / n, s["syy"] - s["sy"] * s["sy"] / n
        corr = np.clip((s["sxy"] - s["sx"] * s["sy"] / n) / np.sqrt(vx * vy), -1.0, 1.0)
        rest = s["syy"] - 2 * slope * s["sxy"] + slope * slope * s["sxx"]
        some = lambda ok, v: np.where(ok, v, np.nan)
        return {
            "local_me": some(n > 0, s["sd"] / n), "local_mae": some(n > 0, s["sa"] / n), "local_mre": some(s["nr"] > 0, s["sr"] / s["nr"]),
            "local_rmse": some(n > 0, np.sqrt(np.maximum(0.0, s["sdd"] / n))), "local_corr": some((n >= 3) & (vx > epsilon) & (vy > epsilon), corr),
            "coefficient": slope, "local_r2": some(~np.isnan(slope) & (s["syy"] > epsilon), np.clip(1 - rest / s["syy"], 0.0, 1.0)),
        }


def focal_tiles(cells: DataFrame, sizes: list[int], left: str = "left_v", right: str = "right_v", epsilon: float = 1e-12, columns: tuple = STATISTICS, side: int = SIDE) -> DataFrame:
    """(r, c, size, n, statistics) of the windows around every cell of ``cells`` (r, c, two layers), for all ``sizes``.

    Cells where both layers have a value count, results exist also where the centre has none; statistics that are not
    defined are null. A cell that stands twice counts twice and gives one row. Missing cells count as cells without values.
    """
    if not sizes or any(w < 3 or w % 2 == 0 for w in sizes):
        raise ValueError("a window is an odd number from 3")
    rim = max(sizes) // 2
    wide = side + 2 * rim

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["r"].to_numpy(), frame["c"].to_numpy()
        top, first = int(frame["tr"].iloc[0]) * side, int(frame["tc"].iloc[0]) * side
        i, j = r - top + rim, c - first + rim
        own = np.zeros((wide, wide), bool)
        own[i, j] = True
        own = own[rim : rim + side, rim : rim + side]
        y, x = frame["y"].to_numpy(float), frame["x"].to_numpy(float)
        ok = ~np.isnan(y) & ~np.isnan(x)
        i, j, y, x = i[ok], j[ok], y[ok], x[ok]
        d, far = y - x, np.abs(y) > epsilon
        share = np.abs(d / np.where(far, y, 1.0)) * far
        at = np.zeros((len(SUMS), wide, wide))
        for k, v in enumerate((np.ones(len(y)), x, y, x * x, y * y, x * y, d, np.abs(d), d * d, share, far.astype(float))):
            np.add.at(at[k], (i, j), v)
        row, column = np.nonzero(own)
        out = []
        for size in sizes if len(row) else ():
            half = slice(rim - size // 2, rim + side + size // 2)
            along = slid(at[:, half, half], size)
            both = slid(along.swapaxes(1, 2), size).swapaxes(1, 2)[:, row, column]
            s = dict(zip(SUMS, both))
            found = statistics(s, epsilon)
            out.append(pd.DataFrame({"r": row + top, "c": column + first, "size": size, "n": s["n"].astype(np.int64)} | {k: pd.Series(pd.arrays.FloatingArray(np.nan_to_num(found[k]), np.isnan(found[k]))) for k in columns}))
        return pd.concat(out) if out else pd.DataFrame(columns=["r", "c", "size", "n", *columns])

    reach = lambda a: F.explode(F.sequence(F.floor((F.col(a) - rim) / side), F.floor((F.col(a) + rim) / side)))
    value = lambda v: F.when(F.isnan(v), None).otherwise(F.col(v).cast("double"))
    spread = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), value(left).alias("y"), value(right).alias("x")).where("r is not null and c is not null")
    spread = spread.select("*", reach("r").alias("tr")).select("*", reach("c").alias("tc"))
    kinds = ", ".join(f"{k} double" for k in columns)
    # tiles are few bytes and much work: as many partitions as the session names, which adaptive execution would join
    spread = spread.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tr", "tc")
    return spread.groupBy("tr", "tc").applyInPandas(tile, f"r int, c int, size int, n long, {kinds}")
