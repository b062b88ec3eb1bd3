"""Records of large text files that no line ends: quoted values over several lines, and the features of one JSON text.

Where a block of a file begins, nothing tells whether it lies inside a quoted text. So a first pass sums up each block for
both cases (quotes, and depth of braces), a prefix over the few sums gives every block's true state, and a second pass
cuts each block at its records. A record that runs into the next blocks leaves fragments, which alone are dealt out and put
together. Blocks are those of Spark's text reader, so a file takes as many tasks as it has blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaccord.scratch import written

CUT = "file string, block long, n long, kind int, text binary"
#: Kinds of rows: a whole record, the beginning of one that goes on in the next block, and a piece of one begun before.
WHOLE, BEGUN, GOES_ON = 0, 1, 2
_FEATURE = re.compile(rb'"type"\s*:\s*"Feature"')
_TOKEN = re.compile(rb'"|\{')


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, block, value): the bytes between ends, in the order of the file within each block."""
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batches) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((file, block), values) of each stretch of a block in the batches of a partition."""
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        values = batch.column(2).to_pylist()
        edges = [0, *(k for k in range(1, len(values)) if blocks[k] != blocks[k - 1] or files[k] != files[k - 1]), len(values)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield (files[a], int(blocks[a])), values[a:b]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "block", "n", "kind", "text"])


def _states(sums: DataFrame, after: Callable) -> dict:
    """The state at the start of each block: ``after`` gives the state behind a block from that before it and its sums. A
    row a block reaches the driver."""
    states: dict = {}
    last, state = None, None
    for row in sums.orderBy("file", "block").collect():
        state = after(state if row["file"] == last else None, None)
        states[row["file"], row["block"]] = state
        last, state = row["file"], after(state, row)
    return states


def _whole(cut: DataFrame, end: str) -> DataFrame:
    """(file, feature_id, within, files, text) of all records, fragments put together: numbers in the order of files,
    blocks and records, numbers within the file, and how many files there are up to it."""
    cut = written(cut, "records")
    counts = cut.where(F.col("kind") != GOES_ON).groupBy("file", "block").agg((F.max("n") + 1).alias("many"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = counts.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"), F.dense_rank().over(Window.orderBy("file")).alias("files"))
    base = base.withColumn("first", F.min("base").over(Window.partitionBy("_f")))
    broken = cut.where(F.col("kind") != WHOLE)
    owner = F.sum((F.col("kind") == BEGUN).cast("int")).over(Window.partitionBy("file").orderBy("block", F.desc("kind")))
    parts = F.sort_array(F.collect_list(F.struct("block", (-F.col("kind")).alias("k"), F.col("text").alias("text"))))
    first = F.min(F.when(F.col("kind") == BEGUN, F.struct("block", "n")))
    ends = F.lit(end.encode())
    joined = F.aggregate(F.transform("parts", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.concat(ends, p["text"]))), F.lit(b""), lambda s, p: F.concat(s, p))
    mended = broken.withColumn("owner", owner).where("owner > 0").groupBy("file", "owner").agg(parts.alias("parts"), first.alias("first")).select("file", "first.block", "first.n", joined.alias("text"))
    records = cut.where(F.col("kind") == WHOLE).select("file", "block", "n", "text").union(mended)
    return records.join(F.broadcast(base), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select("file", (F.col("base") + F.col("n")).alias("feature_id"), (F.col("base") + F.col("n") - F.col("first")).alias("within"), "files", "text")


# -- quoted lines -----------------------------------------------------------------------------------------------------


def quoted_records(spark: SparkSession, path: str, skip: Callable[[bytes], bool], quote: bytes = b'"') -> DataFrame:
    """(file, feature_id, text) of the records of a table of text: lines, where those inside quotes do not end a record.
    Records that ``skip`` names have no number. A header is a record like others."""
    lines = pieces(spark, path, "\n")
    marks = F.length("value") - F.length(F.replace(F.col("value").cast("string"), F.lit(quote.decode()), F.lit("")).cast("binary"))
    sums = lines.groupBy("file", "block").agg(F.sum(marks).alias("quotes"))
    states = _states(sums, lambda state, row: (state or 0) if row is None else (state + row["quotes"]) % 2)

    def cut(batches):
        at, inside, held, n, begun = None, 0, [], 0, False

        def close():
            """What is left of a block: a record that goes on behind it."""
            return [(*at, n if begun else None, BEGUN if begun else GOES_ON, b"\n".join(held))] if held else []

        for key, values in _runs(batches):
            out = []
            if key != at:
                out += close()
                at, inside, held, n, begun = key, states[key], [], 0, not states[key]
            for line in values:
                held.append(line)
                inside ^= line.count(quote) & 1
                if not inside:
                    text = b"\n".join(held)
                    if not begun:
                        out.append((*at, None, GOES_ON, text))
                    elif not skip(text):
                        out.append((*at, n, WHOLE, text))
                        n += 1
                    held, begun = [], True
            if out:
                yield _rows(out)
        if rest := close():
            yield _rows(rest)

    return _whole(lines.mapInArrow(cut, CUT), "\n")


# -- features of a collection -----------------------------------------------------------------------------------------


def _braces(value: bytes) -> tuple[int, int, int]:
    """Of a piece that ends at a brace: quotes, and opening braces outside of strings, if it begins outside and if it
    begins inside one."""
    texts = (re.sub(rb"\\.", b"", value, flags=re.S) if b"\\" in value else value).split(b'"')
    opened = [t.count(b"{") for t in texts]
    return len(texts) - 1, sum(opened[::2]), sum(opened[1::2])


def features(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature_id, text) of the features of collections: objects of that type, one brace inside the outermost."""
    parts = pieces(spark, path, "}")

    def summed(batches):
        for (file, block), values in _runs(batches):
            quotes, out, inside = np.array([_braces(v) for v in values], np.int64).T
            row = {"file": [file], "block": [block], "first": [values[0][:0]], "quotes": [int(quotes.sum() & 1)]}
            for start in (0, 1):
                within = (start + np.r_[0, np.cumsum(quotes)]) & 1
                row[f"depth{start}"] = [int(np.where(within[:-1] == 0, out, inside).sum() - (within[1:] == 0).sum())]
            yield pa.RecordBatch.from_pydict({k: row[k] for k in ("file", "block", "quotes", "depth0", "depth1")}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("depth0", pa.int64()), ("depth1", pa.int64())]))

    stretches = parts.mapInArrow(summed, "file string, block long, quotes long, depth0 long, depth1 long").withColumn("order", F.monotonically_increasing_id())
    run = F.sort_array(F.collect_list(F.struct("order", "quotes", "depth0", "depth1")))  # a row for each batch of a block
    sums = stretches.groupBy("file", "block").agg(run.alias("runs"))

    def after(state, row):
        quoted, depth = state or (0, 0)
        for part in row["runs"] if row is not None else ():
            depth += part["depth1"] if quoted else part["depth0"]
            quoted ^= part["quotes"]
        return quoted, depth

    states = _states(sums, after)

    def cut(batches):
        at, quoted, depth, held, n, begun = None, 0, 0, [], 0, False

        def close():
            return [(*at, n if begun else None, BEGUN if begun else GOES_ON, b"}".join(held))] if held else []

        for key, values in _runs(batches):
            out = []
            if key != at:
                out += close()
                at, (quoted, depth), held, n, begun = key, states[key], [], 0, False
                going = depth >= 2
            for value in values:
                start = 0 if going else None
                if not going:  # find the brace that opens an object inside the outermost one
                    text = re.sub(rb"\\.", b"__", value, flags=re.S) if b"\\" in value else value
                    for token in _TOKEN.finditer(text):
                        if token[0] == b'"':
                            quoted ^= 1
                        elif not quoted:
                            depth += 1
                            if depth == 2 and start is None:
                                start, going, begun = token.start(), True, True
                else:
                    quotes, outside, inner = _braces(value)
                    depth += inner if quoted else outside
                    quoted ^= quotes & 1
                if start is not None:
                    held.append(value[start:])
                if not quoted:
                    depth -= 1
                    if going and depth == 1:
                        text = b"}".join(held) + b"}"
                        if not begun:
                            out.append((*at, None, GOES_ON, text))
                        elif _FEATURE.search(text):
                            out.append((*at, n, WHOLE, text))
                            n += 1
                        held, going, begun = [], False, False
            if out:
                yield _rows(out)
        if rest := close():
            yield _rows(rest)

    return _whole(parts.mapInArrow(cut, CUT), "}")
