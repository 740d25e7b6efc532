"""Days as a stream: anomalies against a static climatology, and running monthly means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.fields import daily

SCHEMA = "day date, iy int, ix int, value double"


def read_days(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return daily(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def anomalies(days: DataFrame, clim: DataFrame) -> DataFrame:
    """Stream of (day, year, month, iy, ix, value) less the static climatology; no state."""
    c = clim.select("month", "iy", "ix", F.col("value").alias("clim"))
    return days.join(c, ["month", "iy", "ix"], "left").select("day", "year", "month", "iy", "ix", (F.col("value") - F.col("clim")).alias("value"))


def monthly_means(days: DataFrame, late: str = "40 days") -> DataFrame:
    """(first, iy, ix, value, n) of calendar months, by their first day.

    A month is complete, and written, once there is a day of a month that begins more
    than ``late`` after it; days of complete months are dropped.
    """
    stamped = days.withColumn("first", F.date_trunc("month", F.col("day").cast("timestamp"))).withWatermark("first", late)
    means = stamped.groupBy("first", "iy", "ix").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return means.withColumn("first", F.to_date("first"))


def write_days(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what is there now, exactly once, into Parquet; returns the query."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
