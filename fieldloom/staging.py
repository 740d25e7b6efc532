"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_scopes = threading.local()

#: Rows and bytes of one Arrow batch that a Python worker gets while a table is stored.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
    return _OWN_DIRS[app]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/fieldloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for the one that the function given stores and returns."""
    path, made = new_path(spark, name), []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield lambda df: _store(df, path)
    finally:
        _scopes.open = _scopes.open[:-1]
        for used in made:
            drop_path(spark, used)


def drop_path(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what Python workers hold at once; the session's own settings are put back."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _store(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    return _store(df, new_path(df.sparkSession, name))


def stage_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As ``stage``, in a table bucketed by ``column``: joins, windows and groups on keys with it read rows where they lie.

    ``df`` is dealt out by the column first, unless it lies so already.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"fieldloom_{uuid.uuid4().hex}"
    with small_batches(spark), colocated(spark):
        df.repartition(buckets, column).write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


@contextmanager
def colocated(spark: SparkSession) -> Iterator[None]:
    """Lets joins rest on a partitioning by some of their keys, for what is planned within."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
