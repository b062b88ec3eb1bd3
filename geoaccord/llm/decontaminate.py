"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is split into k + 1 pieces. Any passage within k edits of the item holds at
least one piece unchanged, so exact piece hits (Aho-Corasick over all pieces) give all candidates; Myers' bit-parallel
edit distance verifies the window around each (Myers 1999; Wu & Manber 1992). Texts and items are compared lower-cased
and with runs of white space as one space.

Cases: null and empty texts match nothing, and so do null items and items without a word; items so short that
the rate gives them no edit match whole words only; items with a null id are searched and give null ids; repeated rows give
equal rows; an empty table on either side gives an empty result; other columns are ignored (:func:`matches`) or kept
(:func:`flag`, which replaces one named as its result).
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, session, worker_state

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Characters of items in one search block; a larger benchmark is searched in several blocks.
BLOCK_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their offsets."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Least distance of a pattern of m characters to a substring of ``text``, with its end; None where it is over k."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    get = masks.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Searches texts for a block of items (id, normal text)."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = budget(text, rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, len(text), k, masks, text))
        self.search = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.search.add_word(piece, (len(piece), uses))
        if found:
            self.search.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end) of the best match of each item within its budget."""
        if not text or not self.items:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        whole_words: dict[int, int] = {}
        for end, (size, uses) in self.search.iter(text):
            for item, at in uses:
                _, m, k, _, _ = self.items[item]
                begin = end + 1 - size - at
                if k == 0:
                    if (begin == 0 or text[begin - 1] == " ") and text[end + 1 : end + 2] in ("", " "):
                        whole_words.setdefault(item, end + 1)
                    continue
                lo, hi = max(0, begin - k), min(len(text), begin + m + k)
                spans = windows.setdefault(item, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        out = [(self.items[item][0], 0, end) for item, end in whole_words.items()]
        for item, spans in windows.items():
            item_id, m, k, masks, whole = self.items[item]
            exact = text.find(whole)
            if exact >= 0:
                out.append((item_id, 0, exact + m))
                continue
            hits = [(got[0], lo + got[1]) for lo, hi in spans if (got := myers(masks, m, text[lo:hi], k))]
            if hits:
                out.append((item_id, *min(hits)))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The items in blocks of bounded size, so that what is broadcast never grows with the benchmark."""
    block, chars = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col).distinct().orderBy(id_col, text_col)
    for item_id, text in rows.toLocalIterator():
        text = normal(text)
        if not text:
            continue
        block.append((item_id, text))
        chars += len(text)
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end) of every row and item that match; ``end`` counts in the normal text."""
    spark = session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, end int"
    out = None
    for block in blocks(benchmark, item_id, item_text, block_chars):
        part = rows.mapInArrow(_search(Shared(spark, block), rate), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _search(shared, rate: float):
    def run(batches):
        matcher = worker_state("decontaminate", (shared.key, rate), lambda: Matcher(shared.value, rate))
        for batch in batches:
            found = [(i, *hit) for i, text in enumerate(batch.column(1)) for hit in matcher.find(text.as_py())]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())], names=["doc_id", "item_id", "distance", "end"])

    return run


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "contaminated", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a boolean column: whether a row's text holds any item."""
    spark = session(docs.sparkSession)
    hit = F.lit(False)
    for block in blocks(benchmark, item_id, item_text, block_chars):
        hit = hit | _holds(Shared(spark, block), rate)(F.col(text_col))
    return docs.withColumn(out_col, hit)


def _holds(shared, rate: float):
    @F.pandas_udf("boolean")
    def held(text: pd.Series) -> pd.Series:
        matcher = worker_state("decontaminate", (shared.key, rate), lambda: Matcher(shared.value, rate))
        return pd.Series([bool(matcher.find(t)) for t in text.where(text.notna(), None)], dtype=bool)

    return held
