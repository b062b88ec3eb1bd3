"""Compression of vectors to short codes: a codebook for each of the equal parts of a vector, learned by rounds of
assignment and rounded means in whole numbers, so that every engine gets the same codes.

The nearest entry is found by annular norm pruning: entries are sorted by norm; a first distance from the entries next to
the part's own norm bounds how far the norm of a nearer entry can be from it; a binary search gives that annulus, bounds
included, and only its entries are evaluated, exactly. An entry as near as the best one lies on or inside the bound, so
ties go to the lowest index as in a full search.

Codebooks have a fixed size (entries times the length of a vector), so they go to the driver and to all tasks; sums for
the means are added up inside each partition first. Vectors stay where they are read.

Cases: a row whose vector is null or holds null or non-finite components is dropped; so is one whose length differs from
that of the first kept vector (by id), for which the codebooks have no place; that length must divide into the parts;
fewer rows than entries give smaller codebooks; rows that repeat, of any id, are vectors of their own, in the order of id
(null last) and components where the codebooks start; whole numbers whose sums of squares would not fit 64 bits (components over about 10^5) are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries on each side of a part's norm that give the first bound, and pairs evaluated at once.
NEAR, PAIRS = 2, 1 << 18
#: Vectors of one Arrow batch: codes are found for so many at once.
BATCH = 4096


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of the entry nearest to each row of ``parts`` (ties: the lowest), its squared distance, and the number of
    pairs that were evaluated; whole numbers, in arrays of int64."""
    n, k = len(parts), len(entries)
    norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    ring, own = norms[order], np.sqrt((parts * parts).sum(1).astype(np.float64))
    best, code, evaluated = np.full(n, np.iinfo(np.int64).max), np.full(n, k), 0

    def take(rows: np.ndarray, places: np.ndarray) -> None:
        """Evaluate the entries at ``places`` of the ring for ``rows`` (sorted), and keep the nearest of them and the best."""
        nonlocal evaluated
        evaluated += len(rows)
        index = order[places]
        apart = parts[rows] - entries[index]
        distance = np.einsum("ij,ij->i", apart, apart)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least, of = np.minimum.reduceat(distance, starts), rows[starts]
        lowest = np.minimum.reduceat(np.where(distance == np.repeat(least, np.diff(np.r_[starts, len(rows)])), index, k), starts)
        better = (least < best[of]) | (least == best[of]) & (lowest < code[of])
        best[of[better]], code[of[better]] = least[better], lowest[better]

    middle = np.searchsorted(ring, own)
    low, high = np.maximum(middle - NEAR, 0), np.minimum(middle + NEAR, k)
    low = np.minimum(low, np.maximum(high - 1, 0))
    _ranges(low, high, take)
    reach = np.sqrt(best.astype(np.float64)) + 1e-6 + 1e-12 * own  # rounding of the norms stays far below this
    first, last = np.searchsorted(ring, own - reach, "left"), np.searchsorted(ring, own + reach, "right")
    _ranges(first, np.minimum(low, last), take)  # what the first bound has evaluated is left out
    _ranges(np.maximum(high, first), last, take)
    return code, best, evaluated


def _ranges(low: np.ndarray, high: np.ndarray, take) -> None:
    """Call ``take`` with the pairs (row, place) of all ranges, not many more than PAIRS at once."""
    counts = np.maximum(high - low, 0)
    rows = np.flatnonzero(counts)
    ends = np.cumsum(counts[rows])
    at = 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS)))
        some = rows[at:to]
        each = np.repeat(some, counts[some])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
        take(each, low[each] + inside)
        at = to


def whole(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are kept, and their components as whole numbers."""
    lists = column.cast(pa.large_list(pa.float64()))
    counts = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(counts == length)
    flat = lists.take(pa.array(rows)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    fine = np.isfinite(flat).all(1)
    scaled = np.floor(flat[fine] * SCALE)
    most = math.isqrt((1 << 61) // max(length, 1))  # then the squares of differences add up to less than 2^63
    if scaled.size and np.abs(scaled).max() > most:
        raise ValueError(f"a component is too large: {SCALE} times it must not exceed {most}")
    return rows[fine], scaled.astype(np.int64)


def _vectors(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows whose vector holds finite numbers only."""
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def codebooks(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, entries by components; none for a table without a vector."""
    vectors = _vectors(docs, id_col, vector_col)
    ordered = [F.col("id").asc_nulls_last(), F.col("vector")]
    smallest = _kept(vectors).orderBy(*ordered).limit(1).collect()
    if not smallest:
        return []
    length = len(smallest[0]["vector"])
    if length % parts or not length:
        raise ValueError(f"{length} components do not divide into {parts} equal parts")
    first = _kept(vectors).where(F.size("vector") == length).orderBy(*ordered).limit(entries).collect()
    start = whole(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length)[1]
    books = [start[:, k * (length // parts) : (k + 1) * (length // parts)].copy() for k in range(parts)]
    width = length // parts
    for _ in range(rounds):
        shared = Shared(docs.sparkSession, books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total, count = [np.zeros(b.shape, np.int64) for b in now], [np.zeros(len(b), np.int64) for b in now]
            for batch in batches:
                _, x = whole(batch.column("vector"), length)
                for k, book in enumerate(now):
                    part = x[:, k * width : (k + 1) * width]
                    code, _, _ = nearest(part, book)
                    np.add.at(total[k], code, part)
                    count[k] += np.bincount(code, minlength=len(book))
            for k, book in enumerate(now):
                used = np.flatnonzero(count[k])
                if len(used):
                    yield pa.record_batch({"part": pa.array(np.full(len(used), k)), "entry": pa.array(used), "n": pa.array(count[k][used]), "total": pa.array(list(total[k][used]), pa.list_(pa.int64()))})

        added = _batched(vectors).mapInArrow(sums, "part long, entry long, n long, total array<long>").groupBy("part", "entry")
        for r in added.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", k)) for k in range(width))).alias("total")).collect():
            books[r["part"]][r["entry"]] = np.array(r["total"], np.int64) // r["n"]
        shared.broadcast.unpersist()
    return books


def _batched(vectors: DataFrame) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(vectors.sparkSession.conf.get(key)) <= BATCH:
        vectors.sparkSession.conf.set(key, str(BATCH))
    return vectors


def encode(docs: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Each kept row's id, label, code (two hexadecimal digits a part) and error, the sum of its squared distances."""
    shared, length = Shared(docs.sparkSession, books), sum(b.shape[1] for b in books)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    schema = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            if not now:
                return
            kept, x = whole(batch.column("vector"), length)
            digits, error, at = np.zeros((len(kept), len(now)), np.uint8), np.zeros(len(kept), np.int64), 0
            for k, book in enumerate(now):
                code, distance, _ = nearest(x[:, at : at + book.shape[1]], book)
                digits[:, k], at = code, at + book.shape[1]
                error += distance
            yield pa.record_batch([batch.column("id").take(pa.array(kept)), batch.column("label").take(pa.array(kept)), pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return _batched(rows).mapInArrow(coded, schema)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Id, label, code, error, the error summed over the rows of the same label (null is one), and the codebooks' digest."""
    books = codebooks(docs, id_col, vector_col, parts, entries, rounds)
    coded = materialize(encode(docs, books, id_col, vector_col, label_col), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error"), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
