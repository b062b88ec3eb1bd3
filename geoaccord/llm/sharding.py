"""Weighted rendezvous hashing of record keys, in built-in DataFrame functions only.

A key goes to the shard with the largest weight / -ln(u), where u in (0, 1) is a hash of key and shard. A new
shard takes keys only into itself, and takes its share of the weights (Thaler & Ravishankar 1998).

Cases: a null key is the empty key, so all its rows go to one shard; repeated rows go to the same shard and get
slots of their own; a null text has no bytes, so size 1 and checksum 0; an empty table gives an empty result; other
columns are ignored. Slots follow the order of id, checksum and size; rows that are equal in these are alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, materialize

#: Rows of one numbering block, as a power of two.
BLOCK_BITS = 14


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 .. len(weights) - 1 of a key; 52 bits of an MD5 digest make u, so any engine can repeat it."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(k: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{k}"))), 1, 13), 16, 10).cast("double")
        return F.lit(float(weight)) / -F.log((bits + 0.5) / float(1 << 52))

    best = F.greatest(*[F.struct(score(k, w).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(weights)]) if len(weights) > 1 else None
    return F.lit(0) if best is None else -best["k"]


def number_slots(rows: DataFrame, order: Sequence[str], shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in an order, no task holding more than a block of a shard.

    The rows are dealt into ranges of the order (equal ones by their place, so that they may be in several ranges) and
    written: then they have fixed ids (range, row), and a block is 2 ** BLOCK_BITS ids of a range. Rows are numbered
    inside (block, shard), and the offsets of the blocks are running sums over block counts.
    """
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order, "_place").sortWithinPartitions(*order, "_place").drop("_place")
    fixed = materialize(placed.withColumn("_rid", F.monotonically_increasing_id()), "slots")
    fixed = fixed.withColumn("_block", F.shiftright("_rid", BLOCK_BITS))
    inside = fixed.withColumn("_n", F.row_number().over(Window.partitionBy(shard_col, "_block").orderBy("_rid")) - 1)
    counts = fixed.groupBy(shard_col, "_block").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(shard_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard_col).alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return (
        inside.join(offsets, (F.col(shard_col) == F.col("_s")) & (F.col("_block") == F.col("_b")))
        .withColumn(slot_col, (F.col("_before") + F.col("_n")).cast("long"))
        .drop("_rid", "_block", "_n", "_s", "_b", "_before")
    )


def shard(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and the shard after one more shard of ``grown_weight``, for every row of ``docs``."""
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col), list(weights)).cast("int").alias("shard"),
        shard_of(F.col(id_col), [*weights, grown_weight]).cast("int").alias("grown_shard"),
    )
    return number_slots(placed, ["doc_id", "text_crc32", "size"])
