"""Per-month fitting of climatology on predictors, and tiled prediction on another grid.

One month is one group: its plane goes to one task, in parallel with other months.
Models are rows: their weights travel as bytes, and predictions come tile by tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import unet
from fieldloom.operators import predictors, tiles
from fieldloom.operators.metrics import errors
from fieldloom.session import ship_package

MODEL = "month int, feature_names array<string>, feature_means array<double>, feature_stds array<double>, target_mean double, target_std double, base int, depth int, best_epoch int, best_score double, importance array<double>, weights binary"
#: Tiles that meet their month's model in one group of a prediction, on average.
TILE_BLOCK = 16
FIT = "month int, iy int, ix int, test boolean, ref double, pred double"


def _planes(pdf: pd.DataFrame, names: Sequence[str], ny: int, nx: int, extra: Sequence[str]) -> dict[str, np.ndarray]:
    out = {}
    for n in (*names, *extra):
        plane = np.full((ny, nx), np.nan)
        plane[pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf[n].to_numpy(dtype=float, na_value=np.nan)
        out[n] = plane
    return out


def _fit_month(pdf: pd.DataFrame, names: Sequence[str], ny: int, nx: int, how: unet.Training):
    month = int(pdf["month"].iloc[0])
    p = _planes(pdf, names, ny, nx, ("value", "inside"))
    land = (p["inside"] == 1) & np.isfinite(p["value"])
    test = unet.spatial_split(land, how.test_share, how.seed + month)
    mean, std = float(p["value"][land].mean()), max(float(p["value"][land].std()), 1e-6)
    y = np.where(land, (p["value"] - mean) / std, 0.0)
    x = np.nan_to_num(np.stack([p[n] for n in names]))
    net, epoch, score = unet.train(x, y, land & ~test, test, how, how.seed + month)
    return month, p, land, test, mean, std, x, net, epoch, score


def _group(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    return cells.select("month", "iy", "ix", "value", F.col("inside").cast("int").alias("inside"), *names)


def wide_stats(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, mean, std) of the columns ``names`` over the distinct cells inside; see ``predictors.feature_stats``."""
    inside = cells.filter("inside").dropDuplicates(["iy", "ix"])
    long = inside.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("f")).select("f.*")
    return predictors.feature_stats(long)


def _held_stats(stats: DataFrame | None, names: Sequence[str]) -> tuple[list[float], list[float]]:
    """Means and deviations of ``names`` in order; 0 and 1 for features that come standardised."""
    found = {} if stats is None else {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}  # a row a feature
    return [found.get(n, (0.0, 1.0))[0] for n in names], [found.get(n, (0.0, 1.0))[1] for n in names]


def scored(wide: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """``wide`` with the columns ``names`` as z-scores, 0 where missing."""
    means, stds = _held_stats(stats, names)
    return wide.select(*[c for c in wide.columns if c not in names], *[F.coalesce((F.col(n) - m) / s, F.lit(0.0)).alias(n) for n, m, s in zip(names, means, stds, strict=True)])


def fit_models(cells: DataFrame, names: Sequence[str], ny: int, nx: int, how: unet.Training = unet.Training(), stats: DataFrame | None = None) -> DataFrame:
    """One model a month. ``cells``: month, iy, ix, value (target), inside, and standardised features ``names``.

    ``stats`` (feature, mean, std), by which the features were standardised, travel with
    the models, so that ``predict`` can apply them to raw features. Each evaluation
    trains again: store the result before it is used twice.
    """
    means, stds = _held_stats(stats, names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        month, _, _, _, mean, std, _, net, epoch, score = _fit_month(pdf, names, ny, nx, how)
        return pd.DataFrame([(month, list(names), means, stds, mean, std, how.base, how.depth, epoch, score, net.first_layer_importance().tolist(), net.to_bytes())], columns=[c.split()[0] for c in MODEL.split(", ")])

    ship_package(cells.sparkSession)
    return _group(cells, names).groupBy("month").applyInPandas(run, MODEL)


def fitted_field(cells: DataFrame, models: DataFrame, names: Sequence[str], ny: int, nx: int, how: unet.Training = unet.Training()) -> DataFrame:
    """(month, iy, ix, test, ref, pred) over the land cells of the training grid, de-standardised."""

    def run(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or model.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in FIT.split(", ")])
        m = model.iloc[0]
        p = _planes(pdf, names, ny, nx, ("value", "inside"))
        land = (p["inside"] == 1) & np.isfinite(p["value"])
        test = unet.spatial_split(land, how.test_share, how.seed + int(m["month"]))
        net = unet.UNet(len(names), int(m["base"]), int(m["depth"])).from_bytes(m["weights"])
        pred = net.forward(np.nan_to_num(np.stack([p[n] for n in names]))) * m["target_std"] + m["target_mean"]
        iy, ix = np.nonzero(land)
        return pd.DataFrame({"month": int(m["month"]), "iy": iy, "ix": ix, "test": test[iy, ix], "ref": p["value"][iy, ix], "pred": pred[iy, ix]})

    ship_package(cells.sparkSession)
    return _group(cells, names).groupBy("month").cogroup(models.groupBy("month")).applyInPandas(run, FIT)


def check_features(models: DataFrame) -> list[str]:
    """The feature names that all models share; an error if they differ."""
    lists = [r[0] for r in models.select("feature_names").distinct().collect()]  # 12 rows at most
    if len(lists) != 1:
        raise ValueError(f"models with different features: {lists}" if lists else "no model")
    return list(lists[0])


def predict(features: DataFrame, models: DataFrame, mask: DataFrame, ny: int, nx: int, tile: int = 96, overlap: int = 24, raw: bool = False) -> DataFrame:
    """(month, iy, ix, value): each model on a wide feature grid (iy, ix, one column per feature), blended, null outside the mask.

    With ``raw`` the features are standardised by the statistics that came with each
    model. ``models`` is a stored table. Tiles of a month go in blocks of some
    ``TILE_BLOCK``, each a group of its own that gets one copy of the month's model; no
    model passes through the driver.
    """
    names = check_features(models)
    cut = tiles.into_tiles(features.select("iy", "ix", *names), ny, nx, tile, overlap)
    months = sorted(r["month"] for r in models.select("month").collect())  # 12 rows at most
    blocks = max(1, -(-tiles.count(ny, nx, tile, overlap) // TILE_BLOCK))
    cut = cut.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months]))).withColumn("block", F.pmod(F.xxhash64("y0", "x0"), F.lit(blocks)))
    held = models.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    columns = ["month", "iy", "ix", "y0", "x0", "y0_size", "x0_size", "pred"]

    def run(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or model.empty:
            return pd.DataFrame(columns=columns)
        m = model.iloc[0]
        net = unet.UNet(len(names), int(m["base"]), int(m["depth"])).from_bytes(m["weights"])
        mean, std = (np.array(m[k], float)[:, None, None] for k in ("feature_means", "feature_stds")) if raw else (0.0, 1.0)
        out = []
        for (y0, x0), one in pdf.groupby(["y0", "x0"]):
            h, w = int(one["y0_size"].iloc[0]), int(one["x0_size"].iloc[0])
            p = _planes(one.assign(iy=one["iy"] - y0, ix=one["ix"] - x0), names, h, w, ())
            x = np.nan_to_num((np.stack([p[n] for n in names]) - mean) / std)
            pred = net.forward(x) * m["target_std"] + m["target_mean"]
            out.append(one.assign(pred=pred[one["iy"].to_numpy() - y0, one["ix"].to_numpy() - x0]))
        return pd.concat(out)[columns]

    ship_package(features.sparkSession)
    parts = cut.groupBy("month", "block").cogroup(held.groupBy("month", "block")).applyInPandas(run, "month int, iy int, ix int, y0 int, x0 int, y0_size int, x0_size int, pred double")
    out = tiles.blend(parts, ["month"], overlap)
    return out.join(mask.select("iy", "ix", "inside"), ["iy", "ix"], "left").select("month", "iy", "ix", F.when(F.col("inside"), F.col("value")).alias("value"))


def training_metrics(fitted: DataFrame, models: DataFrame, how: unet.Training, path: str) -> DataFrame:
    """A row a month: cell counts, errors of either split, the best epoch and score, the settings, and where the model lies."""
    parts = [errors(fitted.filter(F.col("test") == on), ["month"]).select("month", F.col("n").alias(f"n_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in ("mae", "rmse", "r2")]) for name, on in (("train", False), ("test", True))]
    joined = parts[0].join(parts[1], "month", "full").join(models.select("month", "best_epoch", "best_score"), "month")
    many = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return joined.select(
        "month", (many("n_train") + many("n_test")).alias("n_land_total"), many("n_train").alias("n_train"), many("n_test").alias("n_test"),
        "train_mae", "train_rmse", "train_r2", "test_mae", "test_rmse", "test_r2", "best_epoch", "best_score",
        F.lit(how.epochs).alias("epochs"), F.lit(how.rate).alias("lr"), F.lit(how.decay).alias("weight_decay"), F.lit(how.base).alias("base_channels"),
        F.concat(F.lit(f"{path}/month="), F.col("month").cast("string")).alias("model_path"),
    ).orderBy("month")


def importance(models: DataFrame) -> DataFrame:
    """(month, feature, importance_proxy)."""
    pairs = F.arrays_zip("feature_names", "importance")
    return models.select("month", F.explode(pairs).alias("p")).select("month", F.col("p.feature_names").alias("feature"), F.col("p.importance").alias("importance_proxy"))


def split_cells(cells: DataFrame, ny: int, nx: int, how: unet.Training = unet.Training()) -> DataFrame:
    """(month, iy, ix, test) of the land cells of each month."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        month = int(pdf["month"].iloc[0])
        p = _planes(pdf, (), ny, nx, ("value", "inside"))
        land = (p["inside"] == 1) & np.isfinite(p["value"])
        test = unet.spatial_split(land, how.test_share, how.seed + month)
        iy, ix = np.nonzero(land)
        return pd.DataFrame({"month": month, "iy": iy, "ix": ix, "test": test[iy, ix]})

    ship_package(cells.sparkSession)
    return _group(cells, ()).groupBy("month").applyInPandas(run, "month int, iy int, ix int, test boolean")
