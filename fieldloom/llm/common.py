"""Helpers shared by the training-data operators: staging, bounded literals, table readers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.textvec import forget_powers
from fieldloom.session import ship_package
from fieldloom.staging import drop_path, new_path, path_exists, scratch, shared_dir, stage

__all__ = ["drop_path", "id_and_text", "kept", "map_arrow", "new_path", "partitions", "path_exists", "release", "scratch", "sent", "shared_dir", "stage", "table", "text_or_empty"]


@contextmanager
def sent(spark: SparkSession, value) -> Iterator:
    """``value`` as a broadcast that is destroyed afterwards; what is made with it must be stored by then."""
    out = spark.sparkContext.broadcast(value)
    try:
        yield out
    finally:
        out.destroy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text becomes empty."""
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


#: What a Python worker keeps from task to task; one thing at a time.
_kept: dict = {}


def kept(name, make):
    """The object of this name in this worker, made if it isn't there; takes the place of any other."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Drop what this worker keeps, and give freed memory back to the system where its C library can."""
    _kept.clear()
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run, schema: str, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` with this package present in the workers; unless ``run`` keeps things, theirs are released before and after."""
    ship_package(df.sparkSession)

    def task(batches):
        if _kept:
            release()
        yield from run(batches)
        release()

    return df.mapInArrow(run if keeps else task, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
