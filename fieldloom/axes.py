"""One-dimensional axes: the only place where coordinates are compared. Everything else joins on indices.

Axes are short (a few thousand points), so maps between grids that are given as numbers
are computed on the driver and sent to executors as small tables. Axes that are tables
themselves stay so: ``as_of`` and ``aligned`` join them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Axis tables beyond this many rows are joined as Catalyst sees fit instead of by broadcast.
BROADCAST_ROWS = 1_000_000
#: Digits to which weights are rounded, which removes the noise of decimal coordinates.
WEIGHT_DIGITS = 12


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of a known number of rows, where that is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ascending(axis: DataFrame) -> DataFrame:
    """(axis, idx, coord, source_idx): each axis of (axis, idx, coord) in ascending order, with where each point was."""
    order = Window.partitionBy("axis").orderBy("coord")
    return axis.select("axis", (F.row_number().over(order) - 1).cast("int").alias("idx"), "coord", F.col("idx").alias("source_idx"))


def same_axis(a: Sequence[float], b: Sequence[float], rtol: float = 1e-5, atol: float = 1e-4) -> bool:
    return len(a) == len(b) and bool(np.allclose(a, b, rtol=rtol, atol=atol))


def check_same_grid(a: tuple[Sequence[float], Sequence[float]], b: tuple[Sequence[float], Sequence[float]], rtol: float = 1e-5, atol: float = 1e-4) -> None:
    for name, x, y in zip(("lat", "lon"), a, b, strict=True):
        if not same_axis(x, y, rtol, atol):
            raise ValueError(f"grids differ in {name}: {len(x)} and {len(y)} points")


def edges(centres: Sequence[float], outer: str = "clip") -> np.ndarray:
    """Cell edges: midpoints inside; outside the outermost centres ('clip') or half a median step beyond them ('half')."""
    c = np.asarray(centres, float)
    if len(c) < 2:
        raise ValueError("an axis needs two points at least")
    reach = {"clip": 0.0, "half": float(np.median(np.diff(c))) / 2}
    if outer not in reach:
        raise ValueError(f"unknown outer mode {outer!r}")
    return np.concatenate(([c[0] - reach[outer]], (c[1:] + c[:-1]) / 2, [c[-1] + reach[outer]]))


def parents(fine: Sequence[float], coarse: Sequence[float], outer: str = "clip") -> np.ndarray:
    """Index of the coarse cell [edge_i, edge_i+1) that holds each fine centre; -1 outside."""
    at = np.searchsorted(edges(coarse, outer), np.round(np.asarray(fine, float), WEIGHT_DIGITS), side="right") - 1
    return np.where((at >= 0) & (at < len(coarse)), at, -1)


def intervals(source: Sequence[float], target: Sequence[float]) -> list[tuple[int, int, float]]:
    """(target index, left source index, weight of the right source point) of each target point inside the source's hull."""
    s, out = np.asarray(source, float), []
    for t, x in enumerate(np.asarray(target, float)):
        if len(s) < 2 or x < s[0] or x > s[-1]:
            continue
        left = min(int(np.searchsorted(s, x, side="right")) - 1, len(s) - 2)
        out.append((t, left, round(float((x - s[left]) / (s[left + 1] - s[left])), WEIGHT_DIGITS)))
    return out


def parent_table(spark: SparkSession, fine: Sequence[float], coarse: Sequence[float], index: str, parent: str, outer: str = "clip") -> DataFrame:
    rows = [(i, int(p)) for i, p in enumerate(parents(fine, coarse, outer))]
    return small(spark.createDataFrame(rows, f"{index} int, {parent} int"), len(rows))


def interval_table(spark: SparkSession, source: Sequence[float], target: Sequence[float], target_name: str, cell: str, weight: str) -> DataFrame:
    rows = intervals(source, target)
    return small(spark.createDataFrame(rows, f"{target_name} int, {cell} int, {weight} double"), len(rows))


def as_of(points: DataFrame, marks: DataFrame, by: Sequence[str], at: str, value: str, later: bool = False) -> DataFrame:
    """``points`` (by, at) with ``value`` of the last of ``marks`` (by, at, value) at or before each; with ``later``, else of the first one after.

    A join by union: marks and points in one order, and the last value that is not null.
    ``by`` parts the work; a part is sorted, not collected. Of marks at one place the
    largest value counts; points without a mark get null, repeated points stay.
    """
    order = Window.partitionBy(*by).orderBy(at, "_point")
    key = [*by, at]
    both = marks.groupBy(*key).agg(F.max(value).alias(value)).withColumn("_point", F.lit(0)).unionByName(points.withColumn("_point", F.lit(1)), allowMissingColumns=True)
    held = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if later:
        held = F.coalesce(held, F.first(value, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return both.withColumn("_held", held).filter("_point = 1").drop(value, "_point").withColumnRenamed("_held", value)


def parent_map(fine: DataFrame, coarse: DataFrame, outer: str = "clip") -> DataFrame:
    """(axis, idx, parent) for axes that are tables (axis, idx, coord) in ascending order: ``parents`` as an as-of join on cell edges."""
    if outer not in ("clip", "half"):
        raise ValueError(f"unknown outer mode {outer!r}")
    w = Window.partitionBy("axis").orderBy("coord")
    steps = coarse.withColumn("before", F.lag("coord").over(w)).withColumn("after", F.lead("coord").over(w))
    reach = steps.groupBy("axis").agg((F.percentile(F.col("after") - F.col("coord"), F.lit(0.5)) / 2).alias("reach")) if outer == "half" else steps.select("axis").distinct().withColumn("reach", F.lit(0.0))
    placed = steps.join(reach, "axis")
    left = placed.select("axis", F.round(F.coalesce((F.col("before") + F.col("coord")) / 2, F.col("coord") - F.col("reach")), WEIGHT_DIGITS).alias("coord"), "idx")
    end = placed.filter("after IS NULL").select("axis", F.round(F.col("coord") + F.col("reach"), WEIGHT_DIGITS).alias("coord"), F.lit(-1).alias("idx"))
    marks = left.unionByName(end).withColumnRenamed("idx", "parent")
    points = fine.select("axis", F.col("idx"), F.round("coord", WEIGHT_DIGITS).alias("coord"))
    return as_of(points, marks, ["axis"], "coord", "parent").select("axis", "idx", F.coalesce("parent", F.lit(-1)).cast("int").alias("parent"))


def aligned(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-4) -> DataFrame:
    """(axis, idx_a, idx_b, coord_a, coord_b): points of two sets of axes (axis, idx, coord) that agree within atol + rtol * |b|.

    A band join: points of ``b`` go to their bucket and to both neighbours, buckets as
    wide as the widest tolerance, so a point meets only what is near. Of several points
    within the tolerance the nearest counts, then the smaller index.
    """
    width = F.lit(atol) + rtol * F.abs(F.col("coord"))
    widest = b.agg(F.max(width)).first()[0] or 1.0
    bucket = F.floor(F.col("coord") / max(widest, 1e-300))
    x = a.select("axis", F.col("idx").alias("idx_a"), F.col("coord").alias("coord_a"), bucket.alias("bucket"))
    y = b.select("axis", F.col("idx").alias("idx_b"), F.col("coord").alias("coord_b"), width.alias("width"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    apart = F.abs(F.col("coord_a") - F.col("coord_b"))
    near = x.join(y, ["axis", "bucket"]).filter(apart <= F.col("width")).withColumn("apart", apart)
    first = lambda key, other: F.row_number().over(Window.partitionBy("axis", key).orderBy("apart", other))
    return near.withColumns({"of_a": first("idx_a", "idx_b"), "of_b": first("idx_b", "idx_a")}).filter("of_a = 1 AND of_b = 1").select("axis", "idx_a", "idx_b", "coord_a", "coord_b")


def same_grid_map(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-4) -> DataFrame:
    """``aligned``, or an error unless every point of either side has its partner, in the same order or turned as a whole."""
    pairs = aligned(a, b, rtol, atol)
    count = lambda df, name: df.groupBy("axis").agg(F.count("*").alias(name))
    counts = count(a, "n_a").join(count(b, "n_b"), "axis", "full").join(count(pairs, "n"), "axis", "left")
    wrong = counts.filter("n IS NULL OR n_a IS NULL OR n_b IS NULL OR n <> n_a OR n <> n_b").first()
    if wrong is not None:
        raise ValueError(f"grids differ in {wrong['axis']}: {wrong['n_a']} and {wrong['n_b']} points, of which {wrong['n'] or 0} agree within tolerance")
    return pairs


def tile_table(spark: SparkSession, fine: Sequence[float], coarse: Sequence[float], index: str, parent: str, tile: str, size: int, outer: str = "clip") -> DataFrame:
    """(index, parent, tile): tiles hold ``size`` parents; a cell without one lies with the nearest cell that has one."""
    held = parents(fine, coarse, outer)
    with_one = np.flatnonzero(held >= 0)
    nearest = with_one[np.clip(np.searchsorted(with_one, np.arange(len(held))), 0, len(with_one) - 1)] if len(with_one) else np.zeros(len(held), int)
    rows = [(i, int(held[i]), int(max(held[n], 0)) // size) for i, n in enumerate(nearest)]
    return small(spark.createDataFrame(rows, f"{index} int, {parent} int, {tile} int"), len(rows))


def predictor_years(available: DataFrame, wanted: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by, year, predictor_year): ``predictor_year`` for tables (by, year) of the years there are and those wanted, without leaving Spark."""
    years = available.select(*by, "year").distinct()
    there = {first: years.filter(F.col("year") == first).select(*by, F.lit(first).alias(f"_{first}")) for first in (1985, 1990)}
    out = as_of(wanted.select(*by, "year"), years.withColumn("predictor_year", F.col("year")), by, "year", "predictor_year", later=True)
    for marked in there.values():
        out = out.join(marked, list(by), "left")
    early = [F.when(F.col("year") <= first, F.col(f"_{first}")) for first in there]
    return out.select(*by, "year", F.coalesce(*early, "predictor_year").cast("int").alias("predictor_year"))


def predictor_year(year: int, available: Iterable[int]) -> int:
    """The predictor year that stands for ``year``."""
    there = sorted(set(available))
    for first in (1985, 1990):
        if year <= first and first in there:
            return first
    return max((y for y in there if y <= year), default=there[0])


def predictor_year_table(spark: SparkSession, available: Iterable[int], first: int, last: int) -> DataFrame:
    there = sorted({int(y) for y in available})
    if not there:
        raise ValueError("no predictor years")
    rows = [(y, predictor_year(y, there)) for y in range(first, last + 1)]
    return small(spark.createDataFrame(rows, "year int, predictor_year int"), len(rows))
