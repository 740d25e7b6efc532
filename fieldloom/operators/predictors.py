"""Predictors: static and yearly features, their statistics, z-scores and matrix."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import axes
from fieldloom.fields import inside_mask

STD_FLOOR = 1e-6


def classify(variables: dict[str, Sequence[str]], exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(static, yearly) names of variables (name -> dimensions): lat and lon alone, or with year."""
    kept = {n: set(d) for n, d in variables.items() if n not in set(exclude)}
    static = [n for n, d in kept.items() if d == {"lat", "lon"}]
    return static, [n for n, d in kept.items() if d == {"lat", "lon", "year"}]


def yearly_mean(yearly: DataFrame, first: int, last: int) -> DataFrame:
    """(feature, iy, ix, value): mean over the years first..last, each standing for its predictor year's snapshot."""
    features = yearly.select("feature").distinct()
    wanted = features.select("feature", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    years = axes.predictor_years(yearly.select("feature", "year"), wanted)
    weights = years.groupBy("feature", F.col("predictor_year").alias("year")).agg(F.count("*").alias("weight"))
    held = F.when(F.col("value").isNotNull(), F.col("weight"))
    rows = yearly.join(weights, ["feature", "year"])
    return rows.groupBy("feature", "iy", "ix").agg((F.sum(F.col("value") * F.col("weight")) / F.sum(held)).alias("value"))


def load_predictors(layers: DataFrame, first: int, last: int, exclude: Iterable[str] = (), names: Sequence[str] | None = None, stats: DataFrame | None = None) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """(features, names, stats, mask) of a table of layers (feature, step, iy, ix, value), step a year or null.

    Names are the static features, then the yearly ones, without ``exclude``, unless
    given; a name without layers is an error. Yearly features are means over first..last.
    The layer ``land_mask`` is the mask, inside where above 0; without one every cell is
    inside. Features are z-scores by ``stats``, or by their own inside the mask.
    """
    kinds = layers.groupBy("feature").agg(F.count("step").alias("steps")).collect()  # one row a variable
    static, yearly = classify({r["feature"]: ("lat", "lon", "year") if r["steps"] else ("lat", "lon") for r in sorted(kinds)}, exclude)
    there = {r["feature"] for r in kinds}
    names = static + yearly if names is None else list(names)
    if lacking := [n for n in names if n not in there]:
        raise KeyError(f"no predictor {lacking[0]!r} among {sorted(there)}")
    cells = layers.select("iy", "ix").distinct()
    land = layers.filter("feature = 'land_mask' AND step IS NULL")
    mask = inside_mask(land) if "land_mask" in there else cells.withColumn("inside", F.lit(True))
    of_years = yearly_mean(layers.filter("step IS NOT NULL").select("feature", F.col("step").alias("year"), "iy", "ix", "value"), first, last)
    both = layers.filter("step IS NULL").select("feature", "iy", "ix", "value").unionByName(of_years).filter(F.col("feature").isin(names))
    stats = feature_stats(both, mask) if stats is None else stats
    return zscore(both, stats), names, stats, mask


def feature_stats(features: DataFrame, mask: DataFrame | None = None, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by, mean, std): over finite cells inside the mask; std below the floor counts as 1, no cell gives (0, 1)."""
    inside = features if mask is None else features.join(mask.filter("inside").select("iy", "ix", F.lit(True).alias("in")), ["iy", "ix"], "left")
    value = F.col("value") if mask is None else F.when(F.col("in"), F.col("value"))
    out = inside.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(*by, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("std") >= STD_FLOOR, F.col("std")).otherwise(1.0).alias("std"))


def zscore(features: DataFrame, stats: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """``features`` with (value - mean) / std; missing values become 0. Stats have a row per feature, and are broadcast."""
    std = F.when(F.abs(F.col("std")) >= STD_FLOOR, F.col("std")).otherwise(1.0)
    scored = features.join(F.broadcast(stats), list(by)).withColumn("value", F.coalesce((F.col("value") - F.col("mean")) / std, F.lit(0.0)))
    return scored.select(*features.columns)


def destandardise(scores: DataFrame, stats: DataFrame, by: Sequence[str] = ("month",)) -> DataFrame:
    """``scores`` with value * std + mean."""
    return scores.join(F.broadcast(stats), list(by)).withColumn("value", F.col("value") * F.col("std") + F.col("mean")).select(*scores.columns)


def feature_matrix(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(iy, ix, valid, one column per name): valid where all are there; a name without rows is an error."""
    wide = features.groupBy("iy", "ix").pivot("feature", list(names)).agg(F.first("value", ignorenulls=True))
    valid = F.lit(True)
    for n in names:
        valid = valid & F.col(n).isNotNull()
    return wide.select("iy", "ix", valid.alias("valid"), *names)


def standardise_target(monthly: DataFrame, mask: DataFrame) -> DataFrame:
    """(month, iy, ix, value): z-scores of each month over the mask, 0 elsewhere."""
    inside = monthly.join(mask, ["iy", "ix"], "left").withColumn("value", F.when(F.col("inside"), F.col("value"))).select("month", "iy", "ix", "value")
    stats = inside.groupBy("month").agg(F.avg("value").alias("mean"), F.greatest(F.coalesce(F.stddev_pop("value"), F.lit(1.0)), F.lit(STD_FLOOR)).alias("std"))
    return zscore(inside, stats, ["month"])
