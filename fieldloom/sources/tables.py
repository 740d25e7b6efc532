"""Metrics and importance tables as CSV, and models as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> bool:
    """One CSV folder with a header; nothing is written for an empty table, and False returned."""
    if df.isEmpty():
        return False
    df.write.option("header", True).csv(path)
    return True


def read_csvs(spark: SparkSession, pattern: str, sort_by: Sequence[str] = ()) -> DataFrame:
    """All CSV files of a glob as one table; Spark raises if there are none."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    return df.orderBy(*[c for c in sort_by if c in df.columns]) if sort_by else df


def write_models(models: DataFrame, path: str) -> None:
    models.write.partitionBy("month").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("month", df["month"].cast("int"))
