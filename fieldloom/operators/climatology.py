"""Monthly climatology, daily anomaly, and their way back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.config import months_in, parse_months

CELL = ["month", "iy", "ix"]


def select_years(daily: DataFrame, first: int, last: int, check: bool = False) -> DataFrame:
    """Days of the years first..last; with ``check`` an error if there are none."""
    out = daily.filter(F.col("year").between(first, last))
    if check and out.isEmpty():
        raise ValueError(f"no day in {first}..{last}")
    return out


def select_months(field: DataFrame, months: str | Iterable[int] | None = None, check: bool = False) -> DataFrame:
    """Rows of the months; filters on the partition column, so other months' files are not read."""
    wanted = parse_months(months)
    out = field.filter(F.col("month").isin(wanted))
    if check and out.isEmpty():
        raise ValueError(f"nothing left in months {wanted}")
    return out


def complete_months(monthly: DataFrame, months: str | Iterable[int] | None = None) -> DataFrame:
    """Rows of the months, every one of which must be there."""
    wanted = parse_months(months)
    there = [r["month"] for r in monthly.select("month").distinct().collect()]  # 12 rows at most
    if lacking := sorted(set(wanted) - set(there)):
        raise KeyError(f"months {lacking} are missing")
    return select_months(monthly, months_in(there, wanted))


def climatology(daily: DataFrame, first: int, last: int) -> DataFrame:
    """(month, iy, ix, value): mean over the baseline years, missing values skipped."""
    return select_years(daily, first, last).groupBy(*CELL).agg(F.avg("value").alias("value"))


def anomaly(daily: DataFrame, clim: DataFrame) -> DataFrame:
    """Daily value less its month's climatology; null where either is missing."""
    c = clim.select(*CELL, F.col("value").alias("clim"))
    return daily.join(c, CELL, "left").select("day", "year", *CELL, (F.col("value") - F.col("clim")).alias("value"))


def reconstruct(anomalies: DataFrame, clim: DataFrame) -> DataFrame:
    """Daily anomaly plus its month's climatology; null where that is missing."""
    c = clim.select(*CELL, F.col("value").alias("clim"))
    return anomalies.join(c, CELL, "left").select("day", "year", *CELL, (F.col("value") + F.col("clim")).alias("value"))


def assemble(predicted: DataFrame, source: DataFrame | None, months: str | Iterable[int] | None = None, strict: bool = True) -> DataFrame:
    """Source climatology overlaid by the predicted one in the output months; other months keep the source, if there is one."""
    wanted = parse_months(months)
    over = complete_months(predicted, wanted) if strict else select_months(predicted, wanted)
    if source is None:
        return over.select(*CELL, "value")
    return source.filter(~F.col("month").isin(wanted)).select(*CELL, "value").unionByName(over.select(*CELL, "value"))


def with_fallback(predicted: DataFrame, source: DataFrame, months: str | Iterable[int] | None = None, on_missing_model: str = "null") -> DataFrame:
    """Months without a model: left out ('null'), or taken from the source climatology ('source')."""
    if on_missing_model not in ("null", "source"):
        raise ValueError(f"on_missing_model is 'null' or 'source', not {on_missing_model!r}")
    over = select_months(predicted, months).select(*CELL, "value")
    if on_missing_model == "null":
        return over
    have = over.filter("value is not null").select("month").distinct()
    rest = select_months(source, months).join(have, "month", "left_anti").select(*CELL, "value")
    return over.join(have, "month", "left_semi").select(*CELL, "value").unionByName(rest)


def merge_month_parts(*parts: DataFrame) -> DataFrame:
    """Parts of single months as one table in order of month."""
    if not parts:
        raise ValueError("no parts to merge")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*[c for c in (*CELL, "feature") if c in out.columns])
