"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='geoaccord-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path; it is deleted when the driver ends, or by :func:`drop`."""
    path = f"{shared_dir(spark)}/geoaccord/{label}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(lambda: [_delete(s, p) for p, s in list(_tables.items())])
    _tables[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: lineage ends there, and a lost executor costs a reread."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _tables:
            _delete(_tables.pop(path), path)


def spread(df: DataFrame, *by: str, most: int = 1 << 30) -> DataFrame:
    """``df`` in several tasks a core (in ``most`` at most), by columns with many values: for steps whose work a row is large
    beside its bytes, which a scan or a shuffle of few bytes would leave to one task."""
    context = df.sparkSession.sparkContext
    many = max(4 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(many, most)), *by)


def discard(path: str) -> None:
    """Delete what lies at a path of :func:`scratch_path` that no later step reads."""
    if path in _tables:
        _delete(_tables.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the context may be gone when the interpreter ends
        pass
