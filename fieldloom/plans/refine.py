"""One refining step as a plan, and two of them in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import climatology as clim_ops
from fieldloom.operators import correct, fill, regrid
from fieldloom.staging import colocated, stage, stage_bucketed

Grid = tuple[Sequence[float], Sequence[float]]


#: What each stored stage of a step holds, and what it is made of.
DEFINITIONS = {
    "clim": ("mean of each month over the baseline years", ("daily",)),
    "anom": ("daily less the climatology of its month", ("daily", "clim")),
    "raw": ("anomaly on the fine grid, filled inside the mask, plus the fine climatology", ("anom", "fine_clim", "mask")),
    "residual": ("target less the mean over the valid children of each coarse cell", ("daily", "raw")),
    "corrected": ("raw plus the residual on the fine grid", ("raw", "residual", "mask")),
    "final": ("corrected, children shifted so that their mean is the target, filled inside the mask", ("corrected", "daily", "mask")),
}


def _calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("day")).withColumn("month", F.month("day"))


def reconstruct_daily(anomalies: DataFrame, fine_clim: DataFrame, mask: DataFrame, coarse: Grid, fine: Grid) -> DataFrame:
    """Raw fine field: regridded anomalies, filled inside the mask, plus the fine climatology."""
    on_fine = regrid.regrid(anomalies, coarse, fine, ["day"], "linear_nearest")
    filled = fill.fill_masked(on_fine, mask, len(fine[0]), len(fine[1]))
    return clim_ops.reconstruct(_calendar(filled), fine_clim)


def refine(daily: DataFrame, fine_clim: DataFrame, mask: DataFrame, coarse: Grid, fine: Grid, baseline: tuple[int, int], months: str | Iterable[int] | None = None, fill_corrected: bool = False, store: Callable[[str, DataFrame], DataFrame] = lambda name, df: stage(df, name)) -> dict[str, DataFrame]:
    """clim, anom, raw, aggregate, residual, corrected, delta, final of one step.

    ``daily`` is the coarse field, ``fine_clim`` the predicted climatology on the fine
    grid. ``store`` writes a stage and reads it back, since later ones read it more than
    once. Months are cut before anything is regridded.
    """
    ny, nx = len(fine[0]), len(fine[1])
    clim = store("clim", clim_ops.climatology(daily, *baseline))
    anom = store("anom", clim_ops.anomaly(clim_ops.select_months(daily, months), clim))
    raw = store("raw", reconstruct_daily(anom, fine_clim, mask, coarse, fine))
    target = correct.semi_join_days(daily, raw).select("day", "iy", "ix", "value")
    aggregate = regrid.parent_mean(regrid.with_parents(raw.select("day", "iy", "ix", "value"), fine, coarse))
    residual = store("residual", correct.residual(target, aggregate))
    back = fill.fill_masked(regrid.regrid(residual, coarse, fine, ["day"], "linear_nearest"), mask, ny, nx)
    corrected = correct.add_aligned(raw, back)
    if fill_corrected:
        corrected = fill.fill_masked(corrected, mask, ny, nx)
    corrected = store("corrected", corrected)
    moved = correct.make_consistent(regrid.with_parents(corrected, fine, coarse), target)
    delta = moved.filter("delta is not null").select("day", F.col("cy").alias("iy"), F.col("cx").alias("ix"), F.col("delta").alias("value")).distinct()
    final = store("final", fill.fill_masked(moved, mask, ny, nx))
    return {"clim": clim, "anom": anom, "raw": raw, "aggregate": aggregate, "residual": residual, "corrected": corrected, "delta": delta, "final": final}


def refine_colocated(daily: DataFrame, fine_clim: DataFrame, mask: DataFrame, coarse: Grid, fine: Grid, baseline: tuple[int, int], months: str | Iterable[int] | None = None, fill_corrected: bool = False, size: int = 16, buckets: int | None = None, outer: str = "clip", store: Callable[[str, DataFrame], DataFrame] = lambda name, df: stage(df, name)) -> dict[str, DataFrame]:
    """``refine`` with its fine fields in tables bucketed by tile: ``size`` * ``size`` parents with all their children, all days.

    Means over children, sums, the join with the climatology and the shift to the target
    read fine rows where they lie; only coarse rows, 1 / ratio ** 2 of them, are dealt to
    the tiles. What filling makes, plane by plane, is dealt to the tiles once. There are
    as many tasks as ``buckets``, whatever the number of days.
    """
    spark = daily.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ny, nx = len(fine[0]), len(fine[1])
    key, cell = ["tile", "day"], ["tile", "day", "iy", "ix"]
    placed = lambda df: regrid.with_tiles(df, fine, coarse, size, outer)
    tiled = lambda df: regrid.tile_of_parent(df, coarse, size)
    clim = store("clim", clim_ops.climatology(daily, *baseline))
    anom = store("anom", clim_ops.anomaly(clim_ops.select_months(daily, months), clim))
    monthly = stage_bucketed(placed(fine_clim.select("month", "iy", "ix", F.col("value").alias("clim"))).drop("cy", "cx"), "fine_clim", "tile", n)
    filled = placed(fill.fill_masked(regrid.regrid(anom, coarse, fine, ["day"], "linear_nearest"), mask, ny, nx)).repartition(n, "tile").withColumn("month", F.month("day"))
    raw = filled.join(monthly.hint("shuffle_hash"), ["tile", "month", "iy", "ix"], "left").select(*cell, "cy", "cx", (F.col("value") + F.col("clim")).alias("value"))
    raw = stage_bucketed(raw, "raw", "tile", n)
    with colocated(spark):
        target = store("target", tiled(correct.semi_join_days(daily, raw.select("day")).select("day", "iy", "ix", "value")))
        residual = store("residual", correct.residual(target, regrid.parent_mean(raw, key), cell))
        back = placed(fill.fill_masked(regrid.regrid(residual, coarse, fine, ["day"], "linear_nearest"), mask, ny, nx)).repartition(n, "tile")
        corrected = correct.add_aligned(raw, back, [*cell, "cy", "cx"])
        if fill_corrected:
            corrected = placed(fill.fill_masked(corrected.select("day", "iy", "ix", "value"), mask, ny, nx))
        corrected = stage_bucketed(corrected, "corrected", "tile", n)
        moved = stage_bucketed(correct.make_consistent(corrected, target, key), "moved", "tile", n)
        final = store("final", fill.fill_masked(moved.select("day", "iy", "ix", "value"), mask, ny, nx))
    return {"clim": clim, "anom": anom, "raw": raw, "target": target, "residual": residual, "corrected": corrected, "moved": moved, "final": final}


def refine_twice(daily: DataFrame, clims: Sequence[DataFrame], masks: Sequence[DataFrame], grids: Sequence[Grid], baseline: tuple[int, int], months: str | Iterable[int] | None = None, store: Callable[[str, DataFrame], DataFrame] = lambda name, df: stage(df, name)) -> list[dict[str, DataFrame]]:
    """Both steps; the second starts from the first one's final field and fills its corrected one."""
    first = refine(daily, clims[0], masks[0], grids[0], grids[1], baseline, months, store=lambda n, df: store(f"1/{n}", df))
    again = _calendar(first["final"])
    second = refine(again, clims[1], masks[1], grids[1], grids[2], baseline, months, fill_corrected=True, store=lambda n, df: store(f"2/{n}", df))
    return [first, second]
