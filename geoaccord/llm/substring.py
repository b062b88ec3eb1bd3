"""Substring deduplication by content-defined chunks.

A passage is repeated where WORDS words in a row stand, byte by byte, at an earlier place (smaller id, then offset)
that does not overlap it (:func:`passages`). Chunks begin at content-defined cuts: of the word starts in a window the
one with the least gear rolling hash of the bytes behind it, so that any WORDS words hold a cut, and the CHUNK words
behind it, that depend on nothing but themselves; words inserted elsewhere move no cut. Chunks are compared by digest.
Only runs of WORDS words whose chunk occurs twice are listed and held against each other; neighbours with one source at
one distance join to a span. The first occurrence of a passage stays.

Cases: null and empty texts have no chunk; a null id is not compared and stays whole; rows that repeat id and text are
one document; rows that repeat an id with another text are documents of their own; an empty table gives an empty
result; other columns are ignored (:func:`passages`) or kept (:func:`remove`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, drop, materialize, mix64, packed, session, utf8

#: Words of the least passage, and of the chunk behind a cut.
WORDS, CHUNK = 50, 25
#: Longer words are split, into words of their own, behind bytes whose gear hash begins with MASK_BITS zeros (at least
#: LEAST bytes from their start), and where these are MOST bytes apart.
LONG_WORD, MASK_BITS, LEAST, MOST = 64, 4, 16, 256
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
_GEAR32 = (mix64(np.arange(257, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray, table: np.ndarray = _GEAR) -> np.ndarray:
    """The gear hash h = 2 h + table[byte] after each byte: a sum over the last 16 bytes (32 for a 32-bit table), by doubling."""
    h = table[raw]
    width = 1
    while width < h.itemsize * 8:
        moved = h.copy()
        moved[width:] += h[:-width] << h.dtype.type(width)
        h, width = moved, width * 2
    return h


_SPACE = np.isin(np.arange(256), list(WORD_SPACE.encode()))


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text. Characters of scripts without spaces (U+3000 to U+9FFF) begin words."""
    solid = ~_SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    begin |= (raw >= 0xE3) & (raw <= 0xE9)
    if len(raw) > LONG_WORD:
        edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        first, behind = edges[::2], edges[1::2]
        long = behind - first > LONG_WORD
        for a, b in zip(first[long].tolist(), behind[long].tolist()):
            marks = np.flatnonzero((gear(raw[a:b]) >> np.uint16(16 - MASK_BITS)) == 0) + a + 1
            begin[marks[(marks >= a + LEAST) & (marks < b)]] = True
            own = [*(np.flatnonzero(begin[a:b]) + a), b]
            for c, d in zip(own, own[1:]):
                begin[c:d:MOST] = True
    starts = np.flatnonzero(begin)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | begin[1:]
    return starts, np.flatnonzero(last) + 1


def chosen(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of WORDS words its cut: the first word, with CHUNK - 1 more behind it in the run, whose first 32 bytes
    have the least gear hash (CHUNK words have more)."""
    if len(starts) < WORDS:
        return np.zeros(0, np.int64)
    order = gear(raw, _GEAR32)[starts[: len(starts) - CHUNK + 1] + 31]
    windows = np.lib.stride_tricks.sliding_window_view(order, WORDS - CHUNK + 1)
    return windows.argmin(axis=1) + np.arange(len(windows))


def _cut_chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, text_key, word) of the chunks behind the cuts of (doc_id, text_key, text)."""

    def list_chunks(batches):
        for batch in batches:
            raw, off = utf8(batch.column(2))
            digests, firsts, counts = [], [], []
            for i in range(len(off) - 1):
                part = raw[off[i] : off[i + 1]]
                starts, ends = words(part)
                found, view = np.unique(chosen(part, starts, ends)), part.tobytes()
                digests.extend([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[found].tolist(), ends[found + CHUNK - 1].tolist())] if len(found) else [])
                firsts.append(found)
                counts.append(len(found))
            at = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            word = np.concatenate(firsts or [np.zeros(0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(word)], names=["digest", "doc_id", "text_key", "word"])

    return docs.mapInArrow(list_chunks, "digest long, doc_id long, text_key long, word int")


def _grams(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, text_key, place) of the runs of WORDS words of (doc_id, text_key, text, cuts) whose own
    cut is among these; place is start * 2 ** 31 + size."""

    def list_grams(batches):
        for batch in batches:
            raw, off = utf8(batch.column(2))
            digests, places, counts = [], [], []
            for i, held in enumerate(batch.column(3)):
                part = raw[off[i] : off[i + 1]]
                starts, ends = words(part)
                at = np.flatnonzero(np.isin(chosen(part, starts, ends), np.array(held.as_py(), np.int64)))
                a, b, view = starts[at], ends[at + WORDS - 1], part.tobytes()
                digests.extend([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())])
                places.append((a << 31) + b - a)
                counts.append(len(at))
            at = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            place = np.concatenate(places or [np.zeros(0)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(place)], names=["digest", "doc_id", "text_key", "place"])

    return docs.mapInArrow(list_grams, "digest long, doc_id long, text_key long, place long")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, start, end, first_doc_id, first_start): byte spans of WORDS words or more that stand whole at
    the earlier place. Spans with other sources may overlap."""
    session(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    found = materialize(_cut_chunks(rows), "cuts")
    shared = materialize(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_d")), "shared")
    hits = found.join(shared, F.col("digest") == F.col("_d")).groupBy("doc_id", "text_key").agg(F.collect_set("word").alias("cuts"))
    hits = materialize(hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "cuts"), "hits")
    drop(found, shared)
    held = rows.join(hits, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "cuts")
    grams = materialize(_grams(held), "grams")
    drop(hits)
    start, size, first_start, first_size = (f(c) for c in ("place", "first_place") for f in (lambda c: F.shiftright(c, 31), lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1))))
    apart = (F.col("first_doc_id") != F.col("doc_id")) | (F.col("first_key") != F.col("text_key")) | (first_start + first_size <= start)
    # Half of the digests at a time, so that only half of the shuffles are on disk at once.
    halves = []
    for half in (0, 1):
        part = grams.where(F.col("digest").bitwiseAND(F.lit(1)) == half)
        first = part.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("first")).where("n > 1")
        first = materialize(first.select(F.col("digest").alias("_d"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_key").alias("first_key"), F.col("first.place").alias("first_place")), "first")
        again = part.join(first, F.col("digest") == F.col("_d")).where(apart & (size == first_size))
        again = again.select("doc_id", "text_key", start.cast("int").alias("start"), (start + size).cast("int").alias("end"), "first_doc_id", "first_key", (start - first_start).cast("int").alias("shift"))
        halves.append(materialize(again, "again"))
        drop(first)
    drop(grams)
    again = halves[0].union(halves[1])
    # Overlapping runs at one distance from one source are one span; rows that repeat a document have equal places.
    source = ["doc_id", "text_key", "first_doc_id", "first_key", "shift"]
    per_source = Window.partitionBy(*source).orderBy("start")
    before = F.max("end").over(per_source.rangeBetween(Window.unboundedPreceding, -1))
    spans = again.withColumn("_new", F.coalesce(before < F.col("start"), F.lit(True))).withColumn("_run", F.max(F.when(F.col("_new"), F.col("start"))).over(per_source))
    spans = spans.groupBy(*source, "_run").agg(F.max("end").alias("end"))
    return spans.select("doc_id", "text_key", F.col("_run").alias("start"), "end", "first_doc_id", (F.col("_run") - F.col("shift")).alias("first_start"))


def cut_spans(text: str, starts, ends) -> str:
    """``text`` without the UTF-8 byte spans, each narrowed to whole characters."""
    raw, out, at = text.encode("utf-8"), [], 0
    for a, b in sorted(zip(starts, ends)):
        a, b = max(int(a), at), int(b)
        while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append(raw[at:a])
            at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut out of the texts; texts without any stay as they are."""
    spans = passages(docs, id_col, text_col)
    edits = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    edits = materialize(edits, "edits")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_spans(t, a, b) for t, a, b in zip(text, starts, ends)], dtype=object)

    # One join; only texts with spans go to Python.
    joined = packed(docs, id=F.col(id_col).cast("long"), key=F.xxhash64(F.col(text_col))).join(edits, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    text = F.col("row").getField(text_col)
    joined = joined.select("row", "spans", cut(F.when(F.col("spans").isNotNull(), text), F.col("spans.start"), F.col("spans.end")).alias("short"))
    kept = F.when(F.col("spans").isNull(), text).otherwise(F.col("short"))
    return joined.select(*((kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
