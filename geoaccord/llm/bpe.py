"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols. Each merge rank has a bucket of list positions; a bitmap over the ranks
(words of 64 bits), with a bitmap over its words above it, names the lowest rank that has entries by find-first-set. An entry whose
pair has changed since is skipped when it is popped. Encoding n bytes takes O(n log n) steps, also where one
pre-token is very long.

Cases: a null text encodes as the empty text (no ids); repeated rows get equal results; an empty table gives an
empty result; a byte that the ranks lack raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, session, worker_state

#: Pre-tokens kept with their ids in each Python worker, and the longest that is kept.
CACHE_SIZE, CACHE_LENGTH = 1 << 19, 64
MAX_RANK_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The rank file; its size is checked, as it is broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has over {MAX_RANK_BYTES} bytes")
    return raw


class Encoder:
    """Encodes and decodes with the merge ranks of a rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        self.words = [0] * (size // 64 + 1)  # the lower level of the bitmap: 64 ranks a word
        self.longest = max(map(len, self.ranks))
        self.bytes_of: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        n, longest, words, top, buckets = len(piece), self.longest, self.words, 0, {}
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: merged into another
        before = list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts here
        pair.append(-1)
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # in rising order, so a heap
                else:
                    buckets[r] = [i]
                    words[r >> 6] |= 1 << (r & 63)
                    top |= 1 << (r >> 6)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            end[j], pair[j], pair[i] = 0, -1, -1
            starts = (before[i],)
            if k < n:
                before[k] = i
                starts = (before[i], i)
            for h in starts:
                if h < 0:
                    continue
                m = end[end[h]]
                r = pair[h] = rank_of(piece[h:m], -1) if m - h <= longest else -1
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        words[r >> 6] |= 1 << (r & 63)
                        top |= 1 << (r >> 6)
        ids, i = [], 0
        while i < n:
            if (r := rank_of(piece[i : end[i]])) is None:
                raise ValueError(f"the ranks lack the byte {piece[i]}")
            ids.append(r)
            i = end[i]
        return ids

    def packed(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8"))
        ids = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        cached, packed = self.cache.get, self.packed
        return b"".join([cached(piece) or packed(piece) for piece in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and n_tokens of every row."""
    return _apply(docs, rank_path, pattern, id_col, text_col, "doc_id %s, n_tokens long, ids binary", lambda e, ids: (ids,))


def digest(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the bytes that they decode to."""
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return _apply(docs, rank_path, pattern, id_col, text_col, "doc_id %s, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda e, ids: (sha(ids), sha(e.decode(ids))))


def _apply(docs, rank_path, pattern, id_col, text_col, schema, columns) -> DataFrame:
    spark = session(docs.sparkSession)
    shared = Shared(spark, read_ranks(rank_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = worker_state("bpe", (shared.key, pattern), lambda: Encoder(shared.value, pattern))
        for batch in batches:
            counts, rest = [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                rest.append(columns(encoder, ids))
            arrays = [pa.array([r[k] for r in rest]) for k in range(len(rest[0]))] if rest else []
            if rest:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *arrays], names=names)

    schema = schema % rows.schema[0].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def decode(ids: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``ids`` with the bytes that each row's ids decode to (null ids: null)."""
    spark = session(ids.sparkSession)
    shared = Shared(spark, read_ranks(rank_path))

    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        encoder = worker_state("bpe", (shared.key, pattern), lambda: Encoder(shared.value, pattern))
        return column.map(lambda x: None if x is None else encoder.decode(bytes(x)))

    return ids.withColumn(out_col, back(F.col(ids_col)))
