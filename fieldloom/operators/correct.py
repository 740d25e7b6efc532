"""Residuals, sums of aligned fields, and strict consistency with parent means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import axes


def restrict_days(target: DataFrame, days: DataFrame) -> DataFrame:
    """``target`` on the days of ``days`` (day), which must all be there."""
    days = days.select("day").distinct()
    if not (gap := missing_days(target, days)).isEmpty():
        raise ValueError(f"days without target, from {gap.agg(F.min('day')).first()[0]} on")
    return semi_join_days(target, days)


def semi_join_days(target: DataFrame, days: DataFrame) -> DataFrame:
    """``target`` on the days of ``days``. Where it is stored by year and month, these of the days cut its files first.

    There are a few months for any number of days, so their table is broadcast; the
    filter on it is what lets dynamic partition pruning take it for the target's scan.
    """
    days = days.select("day").distinct()
    if {"year", "month"} <= set(target.columns):
        months = days.select(F.year("day").alias("year"), F.month("day").alias("month")).filter("year > 0").distinct()
        target = target.join(F.broadcast(months), ["year", "month"], "left_semi").select(*target.columns)
    return target.join(days, "day", "left_semi").select(*target.columns)


def missing_days(target: DataFrame, days: DataFrame) -> DataFrame:
    """Days of ``days`` that ``target`` lacks."""
    return days.select("day").distinct().join(target.select("day").distinct(), "day", "left_anti")


def add_aligned(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("day", "iy", "ix"), check: bool = False) -> DataFrame:
    """(keys, value): sum of two fields on the same grid and days; with ``check`` an error where only one has a row."""
    x, y = a.select(*keys, F.col("value").alias("a")), b.select(*keys, F.col("value").alias("b"))
    if check:
        alone = x.withColumn("in_a", F.lit(1)).join(y.withColumn("in_b", F.lit(1)), list(keys), "full").filter("in_a is null or in_b is null")
        if not alone.isEmpty():
            raise ValueError(f"fields are not aligned at {alone.select(*keys).first()}")
    return x.join(y, list(keys)).select(*keys, (F.col("a") + F.col("b")).alias("value"))


def add_on_same_grid(a: DataFrame, b: DataFrame, a_axes: DataFrame, b_axes: DataFrame, rtol: float = 1e-5, atol: float = 1e-4) -> DataFrame:
    """(day, iy, ix, value): sum of two fields whose grids (axis "lat" or "lon", idx, coord) agree within tolerance, on the cells of ``a``.

    Coordinates of products of one grid often differ by their last digits, so labels
    would not meet; the axes are matched by a band join, and its map gives ``b`` the
    indices of ``a``, whichever way round its axes run. Grids that differ raise an error.
    """
    pairs = axes.same_grid_map(a_axes, b_axes, rtol, atol)
    of = lambda axis, index: F.broadcast(pairs.filter(F.col("axis") == axis).select(F.col("idx_b").alias(index), F.col("idx_a").alias(f"{index}_a")))  # noqa: E731  # one row a point of an axis
    moved = b.join(of("lat", "iy"), "iy").join(of("lon", "ix"), "ix").select("day", F.col("iy_a").alias("iy"), F.col("ix_a").alias("ix"), "value")
    return add_aligned(a, moved)


def residual(target: DataFrame, aggregate: DataFrame, keys: Sequence[str] = ("day", "iy", "ix")) -> DataFrame:
    """(keys, value): target less aggregate; null where there is no aggregate."""
    agg = aggregate.select(*keys, F.col("value").alias("agg"))
    return target.join(agg, list(keys), "left").select(*keys, (F.col("value") - F.col("agg")).alias("value"))


def make_consistent(placed: DataFrame, target: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(keys, iy, ix, cy, cx, value, delta): each child shifted by its parent's target less the children's mean.

    ``placed`` has each fine cell's parent (cy, cx; -1 outside). Cells without a parent
    stay as they are; where the target is missing children become null. The mean is taken
    over the children that are together anyway, so fine rows are shuffled once, for it
    and the join alike; a group has ratio * ratio rows, and a cell without a parent is a
    group of its own.
    """
    inside = (F.col("cy") >= 0) & (F.col("cx") >= 0)
    own = placed.withColumn("_gy", F.when(inside, F.col("cy")).otherwise(-1 - F.col("iy"))).withColumn("_gx", F.when(inside, F.col("cx")).otherwise(-1 - F.col("ix")))
    children = Window.partitionBy(*keys, "_gy", "_gx")
    goal = target.select(*keys, F.col("iy").alias("_gy"), F.col("ix").alias("_gx"), F.col("value").alias("goal"))
    means = own.withColumn("mean", F.avg("value").over(children)).join(goal, [*keys, "_gy", "_gx"], "left")
    delta = F.when(inside, F.col("goal") - F.col("mean"))
    return means.select(*keys, "iy", "ix", "cy", "cx", F.when(inside, F.col("value") + delta).otherwise(F.col("value")).alias("value"), delta.alias("delta"))


def consistency_error(final: DataFrame, target: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(cells, max_error): parents with both a mean and a target, and the largest difference."""
    mean = final.filter("cy >= 0 and cx >= 0 and value is not null").groupBy(*keys, F.col("cy").alias("iy"), F.col("cx").alias("ix")).agg(F.avg("value").alias("mean"))
    return mean.join(target, [*keys, "iy", "ix"]).filter("value is not null").agg(F.count("*").alias("cells"), F.max(F.abs(F.col("mean") - F.col("value"))).alias("max_error"))
