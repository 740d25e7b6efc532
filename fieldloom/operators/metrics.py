"""Errors of predictions against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import regrid


def errors(pairs: DataFrame, by: Sequence[str] = (), pred: str = "pred", ref: str = "ref", total: bool = False) -> DataFrame:
    """(by, n, mae, rmse, bias, r2): over rows where both are there; r2 is null for one row, or a constant reference.

    With ``total`` (for one column ``by``) a row where that is null sums up all, in the same pass.
    """
    ok = pairs.filter(F.col(pred).isNotNull() & F.col(ref).isNotNull())
    e = F.col(pred) - F.col(ref)
    spread = F.var_pop(ref) * F.count("*")
    out = (ok.rollup(*by) if total else ok.groupBy(*by)).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.when((F.count("*") > 1) & (spread > 0), 1 - F.sum(e * e) / spread).alias("r2"),
    )
    return out.select(*by, "n", "mae", "rmse", "bias", "r2")


def _in_years(field: DataFrame, first: int, last: int) -> DataFrame:
    """Days of the years; a filter on the partition column where there is one, so that other years' files are not read."""
    return field.filter((F.col("year") if "year" in field.columns else F.year("day")).between(first, last))


def holdout(pred: DataFrame, ref: DataFrame, first: int, last: int, by: Sequence[str] = ("month",), fine: regrid.Grid | None = None, coarse: regrid.Grid | None = None) -> DataFrame:
    """Errors over the hold-out years on the reference's grid, by ``by``, and overall as the row where that is null.

    With ``fine`` and ``coarse`` the prediction, on the fine grid, is compared with a
    reference on the coarse one by its parent means.
    """
    keys = ["day", "iy", "ix"]
    pred, ref = _in_years(pred, first, last), _in_years(ref, first, last)
    if fine and coarse:
        pred = regrid.parent_mean(regrid.with_parents(pred.select(*keys, "value"), fine, coarse))
    pairs = pred.select(*keys, F.col("value").alias("pred")).join(ref.select(*keys, F.col("value").alias("ref")), keys).withColumn("month", F.month("day"))
    return errors(pairs, by, total=True)


def masked_loss(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, loss): mean absolute error plus half the mean square; 0 without rows."""
    e = F.col("pred") - F.col("ref")
    return pairs.groupBy(*by).agg(F.coalesce(F.avg(F.abs(e)) + 0.5 * F.avg(e * e), F.lit(0.0)).alias("loss"))


def split_counts(cells: DataFrame) -> DataFrame:
    """(n_land, n_train, n_test) of cells with inside and test flags."""
    return cells.agg(F.count_if("inside").alias("n_land"), F.count_if(F.col("inside") & ~F.col("test")).alias("n_train"), F.count_if(F.col("inside") & F.col("test")).alias("n_test"))
