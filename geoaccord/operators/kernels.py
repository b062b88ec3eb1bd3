"""Kernel weighted sums around every point of the plane, by blocks of points.

Points are dealt to square blocks; a block's task gets its own points and, one after another, those it may meet, and takes
the sums as products of matrices (weights by values) a few thousand points at a time. So a pair of points costs some
nanoseconds and no row, and a task holds a piece of a block and a chunk of what it meets, however dense the points are.

A bisquare weight is a polynomial of the coordinates inside its bandwidth: w = (1 - d^2 / b^2)^2, of degree 4, its square of
degree 8. So the sums over a square that lies whole inside the bandwidth follow from its moments, without its points, and
only squares that the edge of the bandwidth crosses are met point by point: :class:`Moments` takes squares of all sizes
(sides double), which makes the work grow with the edges and not with the areas.

Cases: points without a finite coordinate meet nothing; points on one another are met like others, by pieces of a block;
values must not be null (a null is what ``values`` makes of it), infinite ones are summed apart. Points far off widen no
block of the sums within a radius: its size follows the places that are taken (:func:`_side`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaccord.scratch import drop, spread, written

#: Points of a block (between the least and the most, by the points' number), of a piece of a block, and of a chunk.
LEAST, MOST, PIECE, CHUNK = 256, 4096, 16_384, 16_384
#: Points of a block whose weights are held at once (TILE: of those that lie together, so that few others are near them in
#: vain); squares along a block's side that are told apart inside a task.
ROWS, TILE, PARTS = 256, 64, 8
#: The last number of a block along an axis, behind which blocks are one.
LAST = 1 << 62
#: Weights by the distance over the bandwidth.
WEIGHTS = {"bisquare": lambda q: np.square(np.maximum(1 - q * q, 0.0)), "gaussian": lambda q: np.exp(-0.5 * q * q), "exponential": lambda q: np.exp(-q)}


def _side(whole: DataFrame, radius: float, wide: float, high: float, n: int) -> float:
    """The side of blocks of some thousand points, the radius at least, by the squares as wide as the radius that hold
    points: gaps between points and points far off do not count. It is at most MOST times the radius."""
    cells = whole.select(*[F.floor(F.col(c) / radius).alias(c) for c in ("px", "py")]).distinct().count()
    across, along = max(wide / radius, 1.0), max(high / radius, 1.0)
    taken = min(MOST, max(LEAST, n / 128)) * min(cells, across * along) / n  # squares that hold the points of a block
    return radius * max(math.sqrt(taken), taken / min(across, along), 1.0)


def placed(points: DataFrame, columns: list[str], radius: float = 0.0) -> tuple[DataFrame, tuple]:
    """The points (i, h, px, py, columns, bx, by) in blocks, of the radius at least, and (x0, y0, side, blocks along x and
    y); h stands for the id."""
    whole = points.where("abs(px) < double('infinity') and abs(py) < double('infinity')")  # NaN is above all numbers
    box = whole.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count("*")).first()
    x0, y0, wide, high, n = (box[0] or 0.0, box[2] or 0.0, (box[1] or 0.0) - (box[0] or 0.0), (box[3] or 0.0) - (box[2] or 0.0), box[4])
    if radius and n:
        side = _side(whole, radius, wide, high, n)
    else:
        share = min(1.0, min(MOST, max(LEAST, n / 128)) / max(n, 1))
        side = max(math.sqrt(wide * high * share), max(wide, high) * share, radius) or 1.0
    at = lambda c, low: F.least(F.lit(LAST), F.floor((F.col(c) - low) / side).cast("long"))
    rows = whole.select(F.col("feature_id").alias("i"), F.xxhash64("feature_id").alias("h"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), *[F.col(c).cast("double").alias(c) for c in columns], at("px", x0).alias("bx"), at("py", y0).alias("by"))
    return rows, (x0, y0, side, *(math.floor(min(v / side, float(LAST))) + 1 for v in (wide, high)))


def _pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Blocks (_bx, _by, pieces), the points with the piece of their block in which their sums are taken, all pieces and
    the most of a block."""
    blocks = written(rows.groupBy(F.col("bx").alias("_bx"), F.col("by").alias("_by")).count().select("_bx", "_by", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")), "blocks")
    number, most = (v or 1 for v in blocks.agg(F.sum("pieces"), F.max("pieces")).first())
    if most == 1:
        return blocks, rows.withColumn("piece", F.lit(0)), number, most
    met = rows.join(blocks.hint("merge"), (F.col("bx") == F.col("_bx")) & (F.col("by") == F.col("_by")))
    return blocks, met.withColumn("piece", F.pmod("h", "pieces").cast("int")).drop("_bx", "_by", "pieces"), number, most


def runs(batches, keys: list[str]):
    """(key, rows) of neighbouring rows with equal keys, a run in as many parts as its batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in ks], axis=0)) + 1
        for lo, hi in zip([0, *new], [*new, batch.num_rows]):
            yield tuple(int(k[lo]) for k in ks), batch.slice(lo, hi - lo)


def _columns(parts: list, names: list[str]) -> list[np.ndarray]:
    return [np.concatenate([p.column(n).to_numpy(zero_copy_only=False) for p in parts]) for n in names]


def gathered(batches, make):
    """For each run of (bx, by, piece), ``make(key, own rows)`` gets the rows met in chunks (by ``add``), in the order of
    their kind (0: the block's own), and ``done`` gives the batches."""
    key, own, work, held, size = None, [], None, [], 0

    def flush():
        nonlocal held, size
        if held and work:
            work.add(held)
        held, size = [], 0

    for k, part in runs(batches, ["bx", "by", "piece", "kind"]):
        if k[:3] != key:
            if own and not work:
                work = make(key, own)
            flush()
            if work:
                yield from work.done()
            key, own, work = k[:3], [], None
        if k[3] == 0:
            own.append(part)
            continue
        if not work:
            if not own:
                continue  # no point of the block is to be summed for
            work = make(key, own)
        if k[3] == 1:
            work.far(part)
            continue
        held.append(part)
        size += part.num_rows
        if size >= CHUNK:
            flush()
    if own and not work:
        work = make(key, own)
    flush()
    if work:
        yield from work.done()


def product(w: np.ndarray, values: np.ndarray) -> np.ndarray:
    """w @ values, where a weight of 0 takes nothing even of an infinite value."""
    if np.isfinite(values).all():
        return w @ values
    with np.errstate(invalid="ignore", over="ignore"):
        return np.stack([np.where(w > 0, w * v, 0.0).sum(1) for v in values.T], axis=1)


def lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))


class _Near:
    """Sums of one piece of a block over all that it meets, for every bandwidth."""

    def __init__(self, own, columns, weigh, bandwidths, reach, values, squares):
        self.ids = pa.concat_arrays([p.column("i") for p in own])
        self.h, x, y, *self.fields = _columns(own, ["h", "px", "py", *columns])
        self.at, self.columns, self.weigh, self.bandwidths, self.reach, self.values, self.squares = (x, y), columns, weigh, bandwidths, reach, values, squares
        step = max(np.ptp(x), np.ptp(y)) / max(1.0, math.sqrt(len(x) / TILE)) or 1.0
        order = np.lexsort((x, np.floor((y - y.min()) / step)))
        self.tiles = [order[k : k + TILE] for k in range(0, len(order), TILE)]
        n, empty = len(x), [np.zeros(0) for _ in columns]
        self.s = [np.zeros((n, values(empty).shape[1])) for _ in bandwidths]
        self.q = [np.zeros((n, squares(empty).shape[1])) for _ in bandwidths]
        self.n, self.wii = [np.zeros(n, np.int64) for _ in bandwidths], [np.zeros(n) for _ in bandwidths]

    def add(self, parts):
        h, x, y, *fields = _columns(parts, ["h", "px", "py", *self.columns])
        one, two = self.values(fields), self.squares(fields)
        far = max(self.bandwidths) * self.reach
        for tile in self.tiles:
            tx, ty = self.at[0][tile], self.at[1][tile]
            near = np.flatnonzero((x >= tx.min() - far) & (x <= tx.max() + far) & (y >= ty.min() - far) & (y <= ty.max() + far))
            if not len(near):
                continue
            dx, dy = tx[:, None] - x[near][None, :], ty[:, None] - y[near][None, :]
            d = np.sqrt(dx * dx + dy * dy)
            v1, v2 = one[near], two[near]
            for k, b in enumerate(self.bandwidths):
                w = self.weigh(d / b)
                w *= d <= b * self.reach
                self.s[k][tile] += product(w, v1)
                if v2.shape[1]:
                    self.q[k][tile] += product(w * w, v2)
                self.n[k][tile] += (w > 0).sum(1)
        # Weights of the point itself: of the rows with its id.
        order = np.argsort(h, kind="stable")
        low, high = np.searchsorted(h[order], self.h), np.searchsorted(h[order], self.h, side="right")
        i = np.repeat(np.arange(len(low)), high - low)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)] if len(i) else i
        d = np.sqrt((self.at[0][i] - x[j]) ** 2 + (self.at[1][i] - y[j]) ** 2)
        for k, b in enumerate(self.bandwidths):
            np.add.at(self.wii[k], i, np.where(d <= b * self.reach, self.weigh(d / b), 0.0))

    def done(self):
        for k, b in enumerate(self.bandwidths):
            columns = [pa.array(np.full(len(self.ids), b)), self.ids, *[pa.array(f) for f in self.fields], pa.array(self.wii[k]), pa.array(self.n[k]), lists(self.s[k]), lists(self.q[k])]
            yield pa.RecordBatch.from_arrays(columns, names=["bandwidth", "i", *[f"fi_{c}" for c in self.columns], "wii", "n", "s", "q"])


def kernel_sums(points: DataFrame, columns: list[str], weigh, bandwidths: list[float], reach: float, values, squares=lambda fields: np.zeros((len(fields[0]), 0))) -> DataFrame:
    """(bandwidth, i, fi_*, wii, n, s, q) of every point and bandwidth: its own fields, its own weight, the points with a
    weight above 0 within ``reach`` bandwidths, and the sums of w times ``values`` and of w^2 times ``squares``. ``weigh`` takes distances over the bandwidth; ``values`` and
    ``squares`` make a matrix, a row a point, of the columns."""
    radius = max(bandwidths) * reach
    rows, (x0, y0, side, nx, ny) = placed(points, columns, radius)
    blocks, own, number, most = _pieces(rows)
    # A point goes to the blocks within the radius, 3 by 3 at most, as a side is the radius at least; a little is added to
    # the radius for the rounding of the blocks' edges.
    near = radius * (1 + 1e-9)
    at = lambda value, most: F.least(F.lit(most - 1), F.greatest(F.lit(0), F.floor(value / side))).cast("long")
    span = lambda c, low, most: F.explode(F.sequence(at(F.col(c) - near - low, most), at(F.col(c) + near - low, most)))
    met = rows.drop("bx", "by").withColumn("bx", span("px", x0, nx)).withColumn("by", span("py", y0, ny))
    if most == 1:
        met = met.withColumn("piece", F.lit(0))
    else:
        met = met.join(blocks.hint("merge"), (F.col("bx") == F.col("_bx")) & (F.col("by") == F.col("_by"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("_bx", "_by", "pieces")
    both = own.withColumn("kind", F.lit(0)).unionByName(met.withColumn("kind", F.lit(2)))
    dealt = spread(both, "bx", "by", "piece", most=number).sortWithinPartitions("bx", "by", "piece", "kind")

    def run(batches):
        yield from gathered(batches, lambda key, own: _Near(own, columns, weigh, bandwidths, reach, values, squares))

    kind = rows.schema["i"].dataType.simpleString()
    fields = "".join(f"fi_{c} double, " for c in columns)
    return dealt.mapInArrow(run, f"bandwidth double, i {kind}, {fields}wii double, n long, s array<double>, q array<double>")


#: Exponents of the monomials of degree 8, and those of degree 4 among them.
POWERS = [(a, b) for a in range(9) for b in range(9 - a)]
FOUR = [k for k, (a, b) in enumerate(POWERS) if a + b <= 4]
#: Values that are weighted by w (1, x, y, x^2, xy) and by w^2 (1, x, x^2), and the moments of a square.
WEIGHTED, SQUARED = 5, 3
SIZE = WEIGHTED * len(FOUR) + SQUARED * len(POWERS)


def _values(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    one = np.ones_like(x)
    return np.stack([one, x, y, x * x, x * y, one, x, x * x], axis=1)


def monomials(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A row a pair of exponents, a column a point."""
    us, vs = [np.ones_like(u)], [np.ones_like(v)]
    for _ in range(8):
        us.append(us[-1] * u)
        vs.append(vs[-1] * v)
    return np.stack([us[a] * vs[b] for a, b in POWERS])


def moments(u, v, values, starts) -> np.ndarray:
    """The moments of runs of points that begin at ``starts``, a row a run."""
    eight = monomials(u, v)
    four, out, cut = eight[FOUR], np.empty((len(starts), SIZE)), WEIGHTED * len(FOUR)
    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(u)])):
        out[k, :cut] = (four[:, lo:hi] @ values[lo:hi, :WEIGHTED]).T.reshape(-1)
        out[k, cut:] = (eight[:, lo:hi] @ values[lo:hi, WEIGHTED:]).T.reshape(-1)
    return out


def cells_of(x: np.ndarray, y: np.ndarray, corner, side: float) -> tuple[np.ndarray, np.ndarray]:
    """The squares with points (a row each: along x, along y), and for each point the row of its square."""
    cx, cy = (np.floor((v - low) / side).astype(np.int64) for v, low in zip((x, y), corner))
    names, of = np.unique(cx << 32 | cy & 0xFFFFFFFF, return_inverse=True)
    return np.stack([names >> 32, names & 0xFFFFFFFF], axis=1).astype(float), of


def moved(held: np.ndarray, scale: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Moments about other centres in another unit: u' = scale u + dx, v' = scale v + dy."""
    n = len(held)
    full = np.zeros((n, WEIGHTED + SQUARED, 9, 9))
    at = np.array(POWERS)
    four = at[FOUR]
    full[:, :WEIGHTED, four[:, 0], four[:, 1]] = held[:, : WEIGHTED * len(FOUR)].reshape(n, WEIGHTED, -1)
    full[:, WEIGHTED:, at[:, 0], at[:, 1]] = held[:, WEIGHTED * len(FOUR) :].reshape(n, SQUARED, -1)
    sides = []
    for d in (dx, dy):
        step = np.zeros((n, 9, 9))
        for a in range(9):
            for k in range(a + 1):
                step[:, a, k] = math.comb(a, k) * scale**k * d ** (a - k)
        sides.append(step)
    got = sides[0][:, None] @ full @ sides[1].transpose(0, 2, 1)[:, None]
    return np.concatenate([got[:, :WEIGHTED, four[:, 0], four[:, 1]].reshape(n, -1), got[:, WEIGHTED:, at[:, 0], at[:, 1]].reshape(n, -1)], axis=1)


def polynomial(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points (u, v) in bandwidths, the coefficients of (1 - d^2)^2 and of its square by the other point's monomials."""
    n, index = len(u), {p: k for k, p in enumerate(POWERS)}
    base = {(0, 0): 1 - u * u - v * v, (1, 0): 2 * u, (0, 1): 2 * v, (2, 0): np.full(n, -1.0), (0, 2): np.full(n, -1.0)}

    def times(one, two):
        out: dict = {}
        for (a, b), p in one.items():
            for (c, d), q in two.items():
                out[a + c, b + d] = out[a + c, b + d] + p * q if (a + c, b + d) in out else p * q
        return out

    def table(terms):
        out = np.zeros((n, len(POWERS)))
        for p, value in terms.items():
            out[:, index[p]] = value
        return out

    two = times(base, base)
    return table(two)[:, FOUR], table(times(two, two))


class _Bisquare:
    """Sums of one piece of a block for one bandwidth, by points of squares at its edge and by moments inside."""

    def __init__(self, key, own, grid, b):
        x0, y0, side = grid[:3]
        self.b, self.side, self.centre = b, side, (x0 + (key[0] + 0.5) * side, y0 + (key[1] + 0.5) * side)
        x, y, self.y, self.x = _columns(own, ["px", "py", "vy", "vx"])
        parts = max(1, min(PARTS, round(math.sqrt(len(x) / 64))))
        self.at, part = (x, y), side / parts
        self.corner, self.part = (x0, y0), part
        self.cells, of = cells_of(x, y, self.corner, part)
        self.tiles = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
        self.inside, self.sums = np.zeros((len(self.cells), SIZE)), np.zeros((len(x), WEIGHTED + SQUARED))

    def far(self, part):
        level, cx, cy = (part.column(c).to_numpy() for c in ("level", "cx", "cy"))
        held = part.column("m").flatten().to_numpy().reshape(-1, SIZE)
        wide = self.side * 2.0**level
        dx = (self.corner[0] + (cx + 0.5) * wide - self.centre[0]) / self.b
        dy = (self.corner[1] + (cy + 0.5) * wide - self.centre[1]) / self.b
        self.inside += moved(held, wide / self.b, dx, dy).sum(0)

    def add(self, parts):
        x, y, vy, vx = _columns(parts, ["px", "py", "vy", "vx"])
        cells, of = cells_of(x, y, self.corner, self.part)
        order = np.argsort(of, kind="stable")
        x, y, of = x[order], y[order], of[order]
        values = _values(vy[order], vx[order])
        gap = np.abs(self.cells[:, None, :] - cells[None, :, :])
        most, least = np.hypot(*np.moveaxis(gap + 1, 2, 0)) * self.part, np.hypot(*np.moveaxis(np.maximum(gap - 1, 0), 2, 0)) * self.part
        within = (most <= self.b) & by_moments(self.b, self.side)
        edge = ~within & (least < self.b * (1 + 1e-9))
        if within.any():
            made = moments((x - self.centre[0]) / self.b, (y - self.centre[1]) / self.b, values, np.searchsorted(of, np.arange(len(cells))))
            self.inside += within.astype(float) @ made
        for k, tile in enumerate(self.tiles):
            if not edge[k].any():
                continue
            near = np.flatnonzero(edge[k][of])
            xn, yn, vn = x[near], y[near], values[near]
            for lo in range(0, len(tile), ROWS):
                at = tile[lo : lo + ROWS]
                q = np.square(self.at[0][at][:, None] - xn[None, :])
                q += np.square(self.at[1][at][:, None] - yn[None, :])
                q *= -1 / (self.b * self.b)
                q += 1
                np.maximum(q, 0, out=q)
                np.square(q, out=q)
                self.sums[at, :WEIGHTED] += q @ vn[:, :WEIGHTED]
                np.square(q, out=q)
                self.sums[at, WEIGHTED:] += q @ vn[:, WEIGHTED:]

    def done(self):
        if self.inside.any():
            four, eight = polynomial((self.at[0] - self.centre[0]) / self.b, (self.at[1] - self.centre[1]) / self.b)
            cut = WEIGHTED * len(FOUR)
            for held, tile in zip(self.inside, self.tiles):
                self.sums[tile, :WEIGHTED] += four[tile] @ held[:cut].reshape(WEIGHTED, -1).T
                self.sums[tile, WEIGHTED:] += eight[tile] @ held[cut:].reshape(SQUARED, -1).T
        columns = [self.y, self.x, *self.sums.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["yi", "xi", *SUMS])


SUMS = ["s0", "sx", "sy", "sxx", "sxy", "q0", "qx", "qxx"]


def by_moments(b: float, side: float) -> bool:
    """Whether coordinates around a block's centre are small enough, in bandwidths, for sums of their powers to be exact."""
    return b >= side / 2


class Moments:
    """The points in blocks and the moments of squares of all sizes above them, for the bisquare sums of any bandwidth."""

    def __init__(self, points: DataFrame, y: str, x: str):
        rows, self.grid = placed(points.select("feature_id", "px", "py", F.col(y).alias("vy"), F.col(x).alias("vx")), ["vy", "vx"])
        self.blocks, rows, self.number, _ = _pieces(rows)
        # Several tasks a core, and more where a task would get over some tens of blocks; not one a block, for its start.
        self.number = min(self.number, max(4 * points.sparkSession.sparkContext.defaultParallelism, self.number >> 4))
        self.points = written(rows.drop("i", "h"), "points")
        x0, y0, side, nx, ny = self.grid
        self.top = max(0, math.ceil(math.log2(max(nx, ny))))

        def lowest(batches):
            for (bx, by), part in runs(batches, ["bx", "by"]):
                px, py, vy, vx = _columns([part], ["px", "py", "vy", "vx"])
                made = moments((px - x0) / side - bx - 0.5, (py - y0) / side - by - 0.5, _values(vy, vx), np.zeros(1, np.int64))
                yield square([0], [bx], [by], made)

        def above(batches):
            for batch in batches:
                level, cx, cy = (batch.column(c).to_numpy() for c in ("level", "cx", "cy"))
                held = batch.column("m").flatten().to_numpy().reshape(-1, SIZE)
                yield square(level + 1, cx // 2, cy // 2, moved(held, np.full(len(cx), 0.5), (cx % 2 - 0.5) / 2, (cy % 2 - 0.5) / 2))

        def summed(batches):
            key, total = None, None
            for k, part in runs(batches, ["level", "cx", "cy"]):
                held = part.column("m").flatten().to_numpy().reshape(-1, SIZE).sum(0)
                if k != key:
                    if total is not None:
                        yield square([key[0]], [key[1]], [key[2]], total[None])
                    key, total = k, np.zeros(SIZE)
                total += held
            if total is not None:
                yield square([key[0]], [key[1]], [key[2]], total[None])

        schema, key = "level int, cx long, cy long, m array<double>", ["level", "cx", "cy"]
        grouped = lambda df, most: spread(df, *key, most=most).sortWithinPartitions(*key).mapInArrow(summed, schema)
        made = spread(self.points, "bx", "by", most=self.number).sortWithinPartitions("bx", "by").mapInArrow(lowest, schema)
        levels = [written(grouped(made, self.number), "squares")]
        for k in range(self.top):
            levels.append(written(grouped(levels[-1].mapInArrow(above, schema), max(1, self.number >> k)), "squares"))
        squares = levels[0]
        for table in levels[1:]:
            squares = squares.union(table)
        self.squares = written(squares.coalesce(max(1, self.number >> 3)), "squares")
        drop(*levels)

    def sums(self, b: float) -> DataFrame:
        """(yi, xi, s0, ..., qxx) of every point under the bandwidth ``b``."""
        grid, top = self.grid, self.top
        side = grid[2]

        def descend(batches):
            for batch in batches:
                for bx, by, pieces in zip(*(batch.column(c).to_numpy() for c in ("_bx", "_by", "pieces"))):
                    found = [np.concatenate(c) for c in zip(*squares_met(int(bx), int(by), grid, top, b))]
                    for piece in range(int(pieces)):
                        n = len(found[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, t)) for v, t in ((bx, np.int64), (by, np.int64), (piece, np.int32))] + [pa.array(c.astype(t)) for c, t in zip(found, (np.int32, np.int32, np.int64, np.int64))], names=["bx", "by", "piece", "kind", "level", "cx", "cy"])

        met = spread(self.blocks, "_bx", "_by", most=self.number >> 3).mapInArrow(descend, "bx long, by long, piece int, kind int, level int, cx long, cy long")
        near, far = met.where("kind = 2").drop("level"), met.where("kind = 1")
        source = self.points.select(F.col("bx").alias("_x"), F.col("by").alias("_y"), "px", "py", "vy", "vx")
        near = near.join(source.hint("merge"), (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y"))).drop("_x", "_y", "cx", "cy")
        squares = self.squares.select(F.col("level").alias("_l"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), "m")
        far = far.join(squares.hint("merge"), (F.col("level") == F.col("_l")) & (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y"))).drop("_l", "_x", "_y")
        both = self.points.withColumn("kind", F.lit(0)).unionByName(near, True).unionByName(far, True)
        dealt = spread(both, "bx", "by", "piece", most=self.number).sortWithinPartitions("bx", "by", "piece", "kind")

        def run(batches):
            yield from gathered(batches, lambda key, own: _Bisquare(key, own, (grid[0], grid[1], side), b))

        return dealt.mapInArrow(run, ", ".join(f"{c} double" for c in ["yi", "xi", *SUMS]))

    def drop(self) -> None:
        drop(self.points, self.blocks, self.squares)


def square(level, cx, cy, made: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(level, np.int32)), pa.array(np.asarray(cx, np.int64)), pa.array(np.asarray(cy, np.int64)), lists(made)], names=["level", "cx", "cy", "m"])


def squares_met(bx: int, by: int, grid: tuple, top: int, b: float):
    """(kind, level, cx, cy) of the squares that a block meets, from the largest down: 1 for squares inside the bandwidth
    of each of its points, 2 for blocks that the edge of a bandwidth may cross."""
    _, _, side, nx, ny = grid
    cx, cy = np.zeros(1, np.int64), np.zeros(1, np.int64)
    reach, use = b / side, by_moments(b, side)
    for level in range(top, -1, -1):
        wide = 2.0**level
        gap = [np.abs((c + 0.5) * wide - (o + 0.5)) for c, o in ((cx, bx), (cy, by))]
        half = (wide + 1) / 2 + 1e-9
        most, least = np.hypot(gap[0] + half, gap[1] + half), np.hypot(np.maximum(gap[0] - half, 0), np.maximum(gap[1] - half, 0))
        within = (most <= reach) & use
        left = ~within & (least <= reach)
        yield np.ones(within.sum(), np.int32), np.full(within.sum(), level, np.int32), cx[within], cy[within]
        if level == 0:
            yield np.full(left.sum(), 2, np.int32), np.zeros(left.sum(), np.int32), cx[left], cy[left]
            return
        cx, cy = (np.concatenate([2 * c[left] + k for k in ks]) for c, ks in ((cx, (0, 1, 0, 1)), (cy, (0, 0, 1, 1))))
        inside = (cx * 2.0 ** (level - 1) < nx) & (cy * 2.0 ** (level - 1) < ny)
        cx, cy = cx[inside], cy[inside]
