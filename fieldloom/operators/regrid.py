"""Regridding: bilinear, nearest, and linear with nearest in its holes; parent means.

Interpolation gathers the four corners of each source cell first. Source points are few
(1/25 of the target's at either step), so that is a small shuffle; target points inside a
cell then come from two broadcast axis tables without another one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import axes

#: Ascending coordinates (lat, lon).
Grid = tuple[Sequence[float], Sequence[float]]

METHODS = ("linear", "nearest", "linear_nearest")


def corners(field: DataFrame, keys: Sequence[str], ny: int, nx: int) -> DataFrame:
    """(keys, cy, cx, v00, v01, v10, v11): values at the corners of each cell of an ny * nx grid that has one."""
    spots = [F.struct((F.col("iy") - dy).alias("cy"), (F.col("ix") - dx).alias("cx"), F.lit(2 * dy + dx).alias("corner")) for dy in (0, 1) for dx in (0, 1)]
    rows = field.filter("value is not null").select(*keys, "value", F.explode(F.array(*spots)).alias("s")).select(*keys, "value", "s.*")
    rows = rows.filter(F.col("cy").between(0, ny - 2) & F.col("cx").between(0, nx - 2))
    return rows.groupBy(*keys, "cy", "cx").agg(*[F.max(F.when(F.col("corner") == k, F.col("value"))).alias(n) for k, n in enumerate(("v00", "v01", "v10", "v11"))])


def regrid(field: DataFrame, source: tuple[Sequence[float], Sequence[float]], target: tuple[Sequence[float], Sequence[float]], keys: Sequence[str] = ("day",), method: str = "linear") -> DataFrame:
    """(keys, iy, ix, value) on the target grid (lat, lon).

    linear: null if a corner is missing, even one of weight 0. nearest: half-way goes to
    the lower index. Targets outside the source's hull, and those whose cell has no value
    at all, give no row; join to a template grid for them.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    spark = field.sparkSession
    ty = axes.interval_table(spark, source[0], target[0], "iy", "cy", "wy")
    tx = axes.interval_table(spark, source[1], target[1], "ix", "cx", "wx")
    cells = corners(field, keys, len(source[0]), len(source[1])).join(ty, "cy").join(tx, "cx")
    wy, wx, one = F.col("wy"), F.col("wx"), F.lit(1.0)
    linear = (one - wy) * ((one - wx) * F.col("v00") + wx * F.col("v01")) + wy * ((one - wx) * F.col("v10") + wx * F.col("v11"))
    low, high = F.when(wx > 0.5, F.col("v01")).otherwise(F.col("v00")), F.when(wx > 0.5, F.col("v11")).otherwise(F.col("v10"))
    nearest = F.when(wy > 0.5, high).otherwise(low)
    value = {"linear": linear, "nearest": nearest, "linear_nearest": F.coalesce(linear, nearest)}[method]
    return cells.select(*keys, "iy", "ix", value.alias("value"))


def with_parents(field: DataFrame, fine: tuple[Sequence[float], Sequence[float]], coarse: tuple[Sequence[float], Sequence[float]], outer: str = "clip") -> DataFrame:
    """``field`` with the coarse cell (cy, cx) of each row, -1 outside; a separable range lookup by two broadcast joins."""
    spark = field.sparkSession
    my = axes.parent_table(spark, fine[0], coarse[0], "iy", "cy", outer)
    mx = axes.parent_table(spark, fine[1], coarse[1], "ix", "cx", outer)
    return field.join(my, "iy").join(mx, "ix")


def with_tiles(field: DataFrame, fine: tuple[Sequence[float], Sequence[float]], coarse: tuple[Sequence[float], Sequence[float]], size: int, outer: str = "clip") -> DataFrame:
    """``with_parents``, and the tile of ``size`` * ``size`` parents that each row lies in; a parent's children share one."""
    spark = field.sparkSession
    my = axes.tile_table(spark, fine[0], coarse[0], "iy", "cy", "_ty", size, outer)
    mx = axes.tile_table(spark, fine[1], coarse[1], "ix", "cx", "_tx", size, outer)
    return field.join(my, "iy").join(mx, "ix").withColumn("tile", F.col("_ty") * (len(coarse[1]) // size + 1) + F.col("_tx")).drop("_ty", "_tx")


def tile_of_parent(field: DataFrame, coarse: tuple[Sequence[float], Sequence[float]], size: int) -> DataFrame:
    """A coarse field with the tile that each cell's children lie in."""
    return field.withColumn("tile", F.floor(F.col("iy") / size).cast("int") * (len(coarse[1]) // size + 1) + F.floor(F.col("ix") / size).cast("int"))


def parent_mean(placed: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(keys, iy, ix, value): mean of the valid children of each coarse cell; cells without one give no row."""
    inside = placed.filter("cy >= 0 and cx >= 0 and value is not null")
    return inside.groupBy(*keys, F.col("cy").alias("iy"), F.col("cx").alias("ix")).agg(F.avg("value").alias("value"))


def on_grid(field: DataFrame, source: tuple[Sequence[float], Sequence[float]], target: tuple[Sequence[float], Sequence[float]], keys: Sequence[str] = ("month",), method: str = "linear") -> DataFrame:
    """``field`` on the target grid: as it is if both grids agree within tolerance, regridded otherwise."""
    if axes.same_axis(source[0], target[0]) and axes.same_axis(source[1], target[1]):
        return field.select(*keys, "iy", "ix", "value")
    return regrid(field, source, target, keys, method)


def month_slots(monthly: DataFrame, ny: int, nx: int) -> DataFrame:
    """(month, iy, ix, value): all twelve months over the whole grid, null where ``monthly`` has no row."""
    grid = monthly.sparkSession.range(12 * ny * nx).select((F.floor(F.col("id") / (ny * nx)) + 1).cast("int").alias("month"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return grid.join(monthly.select("month", "iy", "ix", "value"), ["month", "iy", "ix"], "left")


def mask_on_grid(mask: DataFrame, source: tuple[Sequence[float], Sequence[float]], target: tuple[Sequence[float], Sequence[float]]) -> DataFrame:
    """(iy, ix, inside) on the target grid, from the nearest source cell where the grids differ."""
    numbers = mask.select(F.lit(0).alias("one"), "iy", "ix", F.col("inside").cast("double").alias("value"))
    return on_grid(numbers, source, target, ["one"], "nearest").select("iy", "ix", (F.coalesce("value", F.lit(0.0)) > 0).alias("inside"))
