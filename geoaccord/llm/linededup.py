"""Removal of lines that many documents share, in built-in DataFrame functions only.

Lines are brought to a key (white space stripped at both ends, A-Z in lower case) and hashed; the documents that hold each
hash are counted, and every line whose key reaches the threshold is dropped in every document. What moves through the
shuffles is hashes and positions: each document sends a hash once to be counted (with partial sums, so that a line of very
many documents arrives as one row a task), then the positions of its lines meet the frequent hashes, and the text itself
is dealt out once, to be put together by position without the dropped lines.

Both joins read written tables or plain scans on both sides, so that adaptive execution can split a hash or a document
that holds a large share of the rows. Hashes are two of 64 bits.

Cases: a null or empty text is one empty line, and stays an empty text; a row is a document, so rows that repeat, of any
id or none, count as many documents and all lose the line; a line that a document repeats counts once; keys shorter than
``min_chars`` code points stay; a document that loses all lines becomes the empty text; only \\n ends a line; an empty
table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, drop, fresh, materialize, packed

#: The letters that a key lower-cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents that must share a line before it goes, and the least code points of its key.
MIN_DOCS, MIN_CHARS = 10, 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """Of each line, two hashes of its key; null where the key is too short."""
    keys = F.transform(lines_of(F.translate(text, UPPER, UPPER.lower())), lambda x: F.trim(x, F.lit(WORD_SPACE)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(F.lit(1), k).alias("a"), F.xxhash64(F.lit(2), k).alias("b"))))


def _document(id_col: Column, text: Column) -> list[Column]:
    """What a row is known by: rows of one id and text are alike, as are their results."""
    return [F.xxhash64(F.lit(k), id_col.cast("string"), id_col.isNull(), text) for k in (1, 2)]


def frequent(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """The hashes of the lines that at least ``min_docs`` documents hold."""
    held = docs.select(F.explode(F.array_distinct(F.filter(_hashes(F.col(text_col), min_chars), lambda h: h.isNotNull()))).alias("h"))
    return held.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def remove(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines") -> DataFrame:
    """``docs`` with a struct ``out_col``: ``n_lines`` before, ``n_dropped``, and ``text``, the kept lines joined by \\n."""
    name = fresh(docs, out_col)
    shared = materialize(frequent(docs, min_docs, min_chars, text_col), "frequent-lines")
    key, text = _document(F.col(id_col), F.col(text_col)), F.col(text_col)
    placed = docs.select(key[0].alias("k"), key[1].alias("l"), F.posexplode(_hashes(text, min_chars)).alias("at", "h"))
    placed = placed.where("h is not null").select("k", "l", "at", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    hit = placed.join(shared, ["a", "b"], "left_semi").groupBy("k", "l").agg(F.collect_set("at").alias("gone"))
    gone = materialize(hit, "dropped-lines")
    drop(shared)
    rows = packed(docs, k=key[0], l=key[1]).join(gone, ["k", "l"], "left")
    lines = lines_of(F.col(f"row.`{text_col}`"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n = lambda c: c.cast("long")
    edited = F.struct(n(F.size(lines)).alias("n_lines"), n(F.coalesce(F.size("gone"), F.lit(0))).alias("n_dropped"), kept.alias("text"))
    return rows.select("row", edited.alias("edited")).select("row.*", F.col("edited").alias(name))
