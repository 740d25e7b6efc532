"""Gridded fields derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.fields import daily

BASELINE = (1995, 1999)
HOLDOUT = (2000, 2001)
COARSE, FINE = 8, 40
COARSE_AXIS = [round(0.125 + 0.25 * i, 6) for i in range(COARSE)]
FINE_AXIS = [round(0.025 + 0.05 * j, 6) for j in range(FINE)]
COARSE_GRID, FINE_GRID = (COARSE_AXIS, COARSE_AXIS), (FINE_AXIS, FINE_AXIS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(spark: SparkSession, sf_dir: str, n: int = COARSE, agg=F.max) -> DataFrame:
    """Daily field on n x n cells, with whole numbers as values so that sums are exact in any order."""
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % n).cast("int").alias("iy"), (F.col("l_partkey") % n).cast("int").alias("ix"), F.col("l_quantity").cast("double").alias("q"))
    return daily(rows.groupBy("day", "iy", "ix").agg(agg("q").alias("value")))


def days_sql(n: int = COARSE, agg: str = "max") -> str:
    return f"""(SELECT CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
      CAST(l_suppkey % {n} AS INT) AS iy, CAST(l_partkey % {n} AS INT) AS ix, CAST({agg}(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly field with holes: most cells of each month, the largest value of its days."""
    return days(spark, sf_dir).groupBy("month", "iy", "ix").agg(F.sum("value").alias("value")).filter("(iy * 3 + ix + month) % 11 <> 0")


MONTHLY_SQL = f"(SELECT month, iy, ix, sum(value) AS value FROM {days_sql()} GROUP BY ALL HAVING (iy * 3 + ix + month) % 11 <> 0)"


def mask(spark: SparkSession, n: int, radius: float) -> DataFrame:
    c = (n - 1) / 2
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("iy"), (F.col("id") % n).cast("int").alias("ix"))
    return cells.withColumn("inside", (F.col("iy") - c) * (F.col("iy") - c) + (F.col("ix") - c) * (F.col("ix") - c) <= radius * radius)


def mask_sql(n: int, radius: float) -> str:
    c = (n - 1) / 2
    return f"""(SELECT iy, ix, (iy - {c}) * (iy - {c}) + (ix - {c}) * (ix - {c}) <= {radius * radius} AS inside
      FROM (SELECT CAST(range // {n} AS INT) AS iy, CAST(range % {n} AS INT) AS ix FROM range({n * n})))"""


def coarse_mask(spark: SparkSession) -> DataFrame:
    return mask(spark, COARSE, 3.5)


def fine_mask(spark: SparkSession) -> DataFrame:
    return mask(spark, FINE, 18)


COARSE_MASK_SQL, FINE_MASK_SQL = mask_sql(COARSE, 3.5), mask_sql(FINE, 18)


def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, iy, ix, value) of part: largest and summed size of each cell."""
    p = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 8) % 8).cast("int").alias("iy"), (F.col("p_partkey") % 8).cast("int").alias("ix"), F.col("p_size").cast("double").alias("s"))
    wide = p.groupBy("iy", "ix").agg(F.max("s").alias("top"), F.sum("s").alias("total"))
    return wide.select(F.explode(F.array(F.struct(F.lit("size_top").alias("feature"), F.col("top").alias("value")), F.struct(F.lit("size_total").alias("feature"), F.col("total").alias("value")))).alias("f"), "iy", "ix").select("f.feature", "iy", "ix", "f.value")


STATIC_SQL = """(WITH w AS (SELECT CAST(p_partkey // 8 % 8 AS INT) AS iy, CAST(p_partkey % 8 AS INT) AS ix, CAST(max(p_size) AS DOUBLE) AS top, CAST(sum(p_size) AS DOUBLE) AS total FROM part GROUP BY ALL)
      SELECT 'size_top' AS feature, iy, ix, top AS value FROM w UNION ALL SELECT 'size_total', iy, ix, total FROM w)"""


def yearly_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, year, iy, ix, value) of orders: orders of each cell and year."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), (F.floor(F.col("o_custkey") / 8) % 8).cast("int").alias("iy"), (F.col("o_custkey") % 8).cast("int").alias("ix"))
    return o.groupBy("year", "iy", "ix").agg(F.count("*").cast("double").alias("value")).withColumn("feature", F.lit("orders"))


YEARLY_SQL = """(SELECT 'orders' AS feature, CAST(year(o_orderdate) AS INT) AS year, CAST(o_custkey // 8 % 8 AS INT) AS iy, CAST(o_custkey % 8 AS INT) AS ix, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL)"""
