"""Fields as tables: loading, naming, cleaning, storing, and dense planes.

A daily field is (day, iy, ix, value) with year and month as partition columns; a
monthly one has month instead of day. A missing value is NULL; NaN and infinities
become NULL on the way in.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def resolve_coordinate(names: Sequence[str], candidates: Sequence[str]) -> str:
    for c in candidates:
        if c in names:
            return c
    raise KeyError(f"none of {list(candidates)} is among {list(names)}")


def resolve_variable(variables: dict[str, Sequence[str]], dims: Sequence[str], preferred: Sequence[str] = (), name: str | None = None) -> str:
    """The variable of ``variables`` (name -> dimensions) to read: the one named, else the first preferred, else the first that has just ``dims``."""
    if name is not None:
        if name not in variables:
            raise KeyError(f"no variable {name!r} among {list(variables)}")
        return name
    fits = [v for v, d in variables.items() if set(d) == set(dims) and len(d) == len(dims)]
    for v in preferred:
        if v in fits:
            return v
    if not fits:
        raise KeyError(f"no variable over {list(dims)}")
    return fits[0]


def daily(df: DataFrame, day: str = "day", iy: str = "iy", ix: str = "ix", value: str = "value") -> DataFrame:
    """Canonical daily field of any table with these four columns."""
    d = F.to_date(F.col(day))
    return df.select(d.alias("day"), F.year(d).alias("year"), F.month(d).alias("month"), F.col(iy).cast("int").alias("iy"), F.col(ix).cast("int").alias("ix"), finite(F.col(value)).alias("value"))


def load_field(spark: SparkSession, path: str, value: str | None = None, preferred: Sequence[str] = ("value",)) -> DataFrame:
    """A stored field. Filter on its partition columns year and month: only these prune files."""
    df = spark.read.parquet(path)
    name = resolve_variable({c: ("cell",) for c in df.columns}, ("cell",), preferred, value)
    return df.withColumn("value", finite(F.col(name)))


def write_field(df: DataFrame, path: str, mode: str = "error") -> None:
    """Values as 32-bit floats, partitioned by year and month (daily) or month (monthly)."""
    parts = [c for c in ("year", "month") if c in df.columns]
    out = df.withColumn("value", F.col("value").cast("float"))
    if parts:
        # one shuffle by month and day keeps files few and a month's rows in many tasks
        out = out.repartition(*[F.col(c) for c in parts], *([F.col("day")] if "day" in df.columns else []))
    out.write.mode(mode).option("compression", "zstd").partitionBy(*parts).parquet(path)


MANIFEST = "name string, path string, definition string, inputs array<string>, rows long, values long, low double, high double, first_day date, last_day date, created_at timestamp"


def recorded(write: Callable[[DataFrame, str], None], read: Callable[[str], DataFrame], root: str, definitions: Mapping[str, tuple[str, Sequence[str]]]) -> Callable[[str, DataFrame], DataFrame]:
    """A ``store(name, df)`` that writes below ``root``, reads back, and adds a row to the table ``root``/manifest.

    Counts, ranges and days are observed while the field is written, without another
    pass; definitions and inputs come by name, "" and () for a name that has none. A name
    that is written again gets another row; the latest counts.
    """

    def store(name: str, df: DataFrame) -> DataFrame:
        spark, path, seen = df.sparkSession, f"{root}/{name}", Observation()
        day = F.col("day") if "day" in df.columns else F.lit(None).cast("date")
        write(df.observe(seen, F.count("*").alias("rows"), F.count("value").alias("values"), F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"), F.min(day).alias("first_day"), F.max(day).alias("last_day")), path)
        found = seen.get
        definition, inputs = definitions.get(name.rsplit("/", 1)[-1], ("", ()))
        row = (name, path, definition, list(inputs), found["rows"], found["values"], found["low"], found["high"], found["first_day"], found["last_day"], datetime.datetime.now())
        spark.createDataFrame([row], MANIFEST).write.mode("append").parquet(f"{root}/manifest")
        return read(path)

    return store


def to_planes(df: DataFrame, keys: Sequence[str], ny: int, nx: int) -> DataFrame:
    """(keys, plane): one row-major array of ny * nx values per key, null where there is no row."""
    cell = F.struct((F.col("iy") * nx + F.col("ix")).alias("at"), "value")
    held = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(cell)).alias("held"))
    plane = F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), lambda i: F.try_element_at("held", i))
    return held.select(*keys, plane.alias("plane"))


def from_planes(df: DataFrame, keys: Sequence[str], nx: int, plane: str = "plane") -> DataFrame:
    """(keys, iy, ix, value) of row-major arrays."""
    rows = df.select(*keys, F.posexplode(plane).alias("at", "value"))
    return rows.select(*keys, F.floor(F.col("at") / nx).cast("int").alias("iy"), (F.col("at") % nx).cast("int").alias("ix"), finite(F.col("value")).alias("value"))


def inside_mask(df: DataFrame, value: str = "value") -> DataFrame:
    """(iy, ix, inside): inside where the mask's value is finite and above 0."""
    return df.select("iy", "ix", F.coalesce(finite(F.col(value)) > 0, F.lit(False)).alias("inside"))
