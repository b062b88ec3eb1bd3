"""Shared helpers of the training-data operators: scratch tables, Arrow batches and text patterns."""

from __future__ import annotations

import atexit
import gc
import hashlib
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, and the pattern of a word.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch; with texts of 0.1 MB that keeps a batch near 25 MB.
ARROW_ROWS = 256

_scratch: dict[str, SparkSession] = {}


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session, so that long texts cannot pile up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, one of our own in local mode
    (tests), whose driver is the only executor, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="geoaccord-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends, or by :func:`drop`."""
    path = f"{shared_dir(spark)}/geoaccord/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(lambda: [_remove(s, p) for p, s in list(_scratch.items())])
    _scratch[path] = spark
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the context may be gone when the interpreter ends
        pass


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _scratch:
            _remove(_scratch.pop(path), path)


def freed(spark: SparkSession) -> None:
    """Let the driver's cleaner remove the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor
    costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    freed(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column, nulls as empty texts, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Shared:
    """A broadcast value, with a digest of its content that names it in Python workers."""

    def __init__(self, spark: SparkSession, value):
        raw = value if isinstance(value, bytes) else pickle.dumps(value)
        self.broadcast, self.key = spark.sparkContext.broadcast(value), hashlib.sha256(raw).hexdigest()

    @property
    def value(self):
        return self.broadcast.value


_state: dict = {}


def worker_state(operator: str, key=None, make=lambda: None):
    """What ``make`` returned for the operator and ``key`` in this Python worker, across its tasks and runs; only the last
    is kept, so that a pipeline's stages do not add up. It holds only what can be made again from the key (tables,
    bounded caches), so a lost worker loses no result."""
    if (operator, key) not in _state:
        _state.clear()  # frees the old one before the new one is made
        gc.collect()
        _state[operator, key] = make()
    return _state[operator, key]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, as no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, **keys) -> DataFrame:
    """The rows of ``df`` as one struct column ``row`` beside ``keys``, so that none of its names can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))


def crc32_text(column) -> F.Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a text."""
    return F.crc32(F.encode(column, "UTF-8"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
