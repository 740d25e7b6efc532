"""Registered queries over the derived fields, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import axes, fields
from fieldloom.functions.unet import Training
from fieldloom.operators import climatology as clim
from fieldloom.operators import correct, fill, learn, metrics, predictors, regrid, tiles
from fieldloom.plans import refine
from fieldloom.plans import fixtures as fx
from fieldloom.sources import grid_nc
from fieldloom.staging import colocated, new_path, stage, stage_bucketed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

C, N, LOW = fx.days_sql(), fx.days_sql(fx.FINE), fx.days_sql(agg="min")
M, MASK, FINE_MASK = fx.MONTHLY_SQL, fx.COARSE_MASK_SQL, fx.FINE_MASK_SQL
FIRST, LAST = fx.BASELINE
MONTHS = "month IN (5, 6, 7, 8, 9)"
CLIM = f"(SELECT month, iy, ix, avg(value) AS value FROM {C} WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY ALL)"
ANOM = f"(SELECT d.day, d.year, d.month, d.iy, d.ix, d.value - c.value AS value FROM {C} d LEFT JOIN {CLIM} c USING (month, iy, ix) WHERE d.{MONTHS})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _clim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clim.climatology(fx.days(spark, sf_dir), *fx.BASELINE)


def _observed(spark: SparkSession, sf_dir: str, n: int = fx.COARSE) -> DataFrame:
    """The daily field, stored: a step reads it five times, and its days and cells stay as many however long the table is."""
    return stage(fx.days(spark, sf_dir, n), "observed")


def _anom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clim.anomaly(clim.select_months(fx.days(spark, sf_dir)), _clim(spark, sf_dir))


@query(f"SELECT * FROM {CLIM}")
def clim_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clim(spark, sf_dir)


@query(f"SELECT * FROM {ANOM}")
def anom_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anom(spark, sf_dir)


@query(f"SELECT * FROM {C} WHERE {MONTHS}")
def month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clim.select_months(fx.days(spark, sf_dir))


@query(f"SELECT * FROM {C} WHERE year BETWEEN {FIRST} AND {LAST}")
def baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clim.select_years(fx.days(spark, sf_dir), *fx.BASELINE)


@query(f"SELECT DISTINCT month FROM {C}")
def distinct_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.days(spark, sf_dir).select("month").distinct()


@query(f"SELECT a.day, a.year, a.month, a.iy, a.ix, a.value + c.value AS value FROM {ANOM} a LEFT JOIN {CLIM} c USING (month, iy, ix)")
def raw_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clim.reconstruct(_anom(spark, sf_dir), _clim(spark, sf_dir))


@query(f"SELECT * FROM {C} WHERE day IN (SELECT day FROM {N} WHERE {MONTHS})")
def time_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.semi_join_days(fx.days(spark, sf_dir), clim.select_months(fx.days(spark, sf_dir, fx.FINE)))


@query(f"SELECT * FROM {C} WHERE day IN (SELECT day FROM {N} WHERE year = 1996 AND {MONTHS})")
def time_semi_join_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is stored by year and month; those of the days alone are read."""
    path = new_path(spark, "target")
    fx.days(spark, sf_dir).write.partitionBy("year", "month").parquet(path)
    days = stage(clim.select_months(fx.days(spark, sf_dir, fx.FINE).filter("year = 1996")).select("day").distinct(), "days")
    return correct.semi_join_days(spark.read.parquet(path), days).select("day", "year", "month", "iy", "ix", "value")


@query(f"SELECT DISTINCT day FROM {C} WHERE day NOT IN (SELECT day FROM {C} WHERE year = 1996)")
def time_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.days(spark, sf_dir)
    return correct.missing_days(d.filter("year = 1996"), d)


def _axis_sql(n: int) -> str:
    """Points of an axis that are there in the table, by number."""
    return f"(SELECT DISTINCT CAST(p_partkey % {n} AS INT) AS idx FROM part)"


def _axis(spark: SparkSession, sf_dir: str, n: int, first: float, step: float) -> DataFrame:
    points = fx.table(spark, sf_dir, "part").select((F.col("p_partkey") % n).cast("int").alias("idx")).distinct()
    return points.select(F.lit("lat").alias("axis"), "idx", F.round(first + step * F.col("idx"), 6).alias("coord"))


_POSITION = "(idx - 2) / CAST(5 AS DOUBLE)"


def _map(spark: SparkSession, sf_dir: str, outer: str) -> DataFrame:
    return axes.parent_map(_axis(spark, sf_dir, fx.FINE, 0.025, 0.05), _axis(spark, sf_dir, fx.COARSE, 0.125, 0.25), outer).select("idx", "parent")


@query(f"SELECT idx, CAST(CASE WHEN {_POSITION} >= 0 AND {_POSITION} < 7 THEN floor({_POSITION} + 0.5) ELSE -1 END AS INT) AS parent FROM {_axis_sql(fx.FINE)}")
def subcell_map_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "clip")


@query(f"SELECT idx, CAST(floor({_POSITION} + 0.5) AS INT) AS parent FROM {_axis_sql(fx.FINE)}")
def subcell_map_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "half")


@query(f"SELECT 'lat' AS axis, CAST(7 - idx AS INT) AS idx, round(1.875 - 0.25 * idx, 6) AS coord, idx AS source_idx FROM {_axis_sql(fx.COARSE)}")
def axis_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis that comes in descending order."""
    return axes.ascending(_axis(spark, sf_dir, fx.COARSE, 1.875, -0.25))


_EDGE = "CASE WHEN {0} >= 2 AND {0} < 37 THEN CAST(floor(({0} - 2) / CAST(5 AS DOUBLE) + 0.5) AS INT) ELSE -1 END"
PLACED = f"(SELECT *, {_EDGE.format('iy')} AS cy, {_EDGE.format('ix')} AS cx FROM {N})"
MEANS = f"(SELECT day, cy AS iy, cx AS ix, avg(value) AS value FROM {PLACED} WHERE cy >= 0 AND cx >= 0 GROUP BY ALL)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.with_parents(fx.days(spark, sf_dir, fx.FINE), fx.FINE_GRID, fx.COARSE_GRID)


@query(f"SELECT * FROM {MEANS}")
def parent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.parent_mean(_placed(spark, sf_dir))


@query(f"SELECT d.day, d.iy, d.ix, d.value - m.value AS value FROM {C} d LEFT JOIN {MEANS} m USING (day, iy, ix)")
def residual_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.residual(fx.days(spark, sf_dir), regrid.parent_mean(_placed(spark, sf_dir)))


_MOVED = f"""(SELECT p.day, p.iy, p.ix, p.cy, p.cx, CASE WHEN p.cy < 0 OR p.cx < 0 THEN p.value ELSE p.value + (c.value - m.value) END AS value,
  CASE WHEN p.cy >= 0 AND p.cx >= 0 THEN c.value - m.value END AS delta FROM {PLACED} p
  LEFT JOIN {MEANS} m ON m.day = p.day AND m.iy = p.cy AND m.ix = p.cx LEFT JOIN {C} c ON c.day = p.day AND c.iy = p.cy AND c.ix = p.cx)"""


@query(f"SELECT * FROM {_MOVED}")
def delta_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.make_consistent(_placed(spark, sf_dir), fx.days(spark, sf_dir))


@query(f"SELECT * FROM {_MOVED}")
def delta_distribute_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table bucketed by tiles of 2 * 2 parents: fine rows stay where they lie."""
    placed = stage_bucketed(regrid.with_tiles(fx.days(spark, sf_dir, fx.FINE).select("day", "iy", "ix", "value"), fx.FINE_GRID, fx.COARSE_GRID, 2), "placed", "tile", 8)
    target = regrid.tile_of_parent(fx.days(spark, sf_dir), fx.COARSE_GRID, 2)
    with colocated(spark):
        return stage_bucketed(correct.make_consistent(placed, target, ["tile", "day"]), "moved", "tile", 8).drop("tile")


@query(f"""SELECT count(*) AS cells, max(abs(x.value - c.value)) < 1e-9 AS consistent FROM
  (SELECT day, cy AS iy, cx AS ix, avg(value) AS value FROM {_MOVED} WHERE cy >= 0 AND cx >= 0 AND value IS NOT NULL GROUP BY ALL) x JOIN {C} c USING (day, iy, ix)""")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = correct.make_consistent(_placed(spark, sf_dir), fx.days(spark, sf_dir))
    return correct.consistency_error(moved, fx.days(spark, sf_dir)).select("cells", (F.col("max_error") < 1e-9).alias("consistent"))


_LEFT = "least(CAST(floor((range - 2) / CAST(5 AS DOUBLE)) AS INT), 6)"
_TARGETS = f"(SELECT CAST(range AS INT) AS t, {_LEFT} AS c, round((range - 2) / CAST(5 AS DOUBLE) - {_LEFT}, 12) AS w FROM range(40) WHERE range BETWEEN 2 AND 37)"
_CORNERS = f"""(SELECT y.t AS iy, x.t AS ix, y.w AS wy, x.w AS wx, m.month, a.value AS v00, b.value AS v01, c.value AS v10, d.value AS v11
  FROM {_TARGETS} y CROSS JOIN {_TARGETS} x CROSS JOIN (SELECT DISTINCT month FROM {M}) m
  LEFT JOIN {M} a ON a.month = m.month AND a.iy = y.c AND a.ix = x.c LEFT JOIN {M} b ON b.month = m.month AND b.iy = y.c AND b.ix = x.c + 1
  LEFT JOIN {M} c ON c.month = m.month AND c.iy = y.c + 1 AND c.ix = x.c LEFT JOIN {M} d ON d.month = m.month AND d.iy = y.c + 1 AND d.ix = x.c + 1
  WHERE coalesce(a.value, b.value, c.value, d.value) IS NOT NULL)"""
_LINEAR = "(1 - wy) * ((1 - wx) * v00 + wx * v01) + wy * ((1 - wx) * v10 + wx * v11)"
_NEAREST = "CASE WHEN wy > 0.5 THEN CASE WHEN wx > 0.5 THEN v11 ELSE v10 END ELSE CASE WHEN wx > 0.5 THEN v01 ELSE v00 END END"


def _regrid(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    out = regrid.regrid(fx.monthly(spark, sf_dir), fx.COARSE_GRID, fx.FINE_GRID, ["month"], method)
    return out.withColumn("value", F.round("value", 6))


@query(f"SELECT month, iy, ix, round({_LINEAR}, 6) AS value FROM {_CORNERS}")
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regrid(spark, sf_dir, "linear")


@query(f"SELECT month, iy, ix, round({_NEAREST}, 6) AS value FROM {_CORNERS}")
def regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regrid(spark, sf_dir, "nearest")


@query(f"SELECT month, iy, ix, round(coalesce({_LINEAR}, {_NEAREST}), 6) AS value FROM {_CORNERS}")
def regrid_linear_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regrid(spark, sf_dir, "linear_nearest")


@query(f"SELECT month, iy, ix, CASE WHEN inside THEN value END AS value FROM {M} LEFT JOIN {MASK} USING (iy, ix)")
def mask_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.apply_mask(fx.monthly(spark, sf_dir), fx.coarse_mask(spark))


def _fill_sql(field: str, key: str = "day", mask: str = MASK) -> str:
    return f"""WITH dense AS MATERIALIZED (SELECT d.{key}, k.iy, k.ix, k.inside, CASE WHEN k.inside THEN f.value END AS value
    FROM (SELECT DISTINCT {key} FROM {field}) d CROSS JOIN {mask} k LEFT JOIN {field} f ON f.{key} = d.{key} AND f.iy = k.iy AND f.ix = k.ix
  ), near AS (SELECT m.{key}, m.iy, m.ix, arg_min(v.value, ((m.iy - v.iy) * (m.iy - v.iy) + (m.ix - v.ix) * (m.ix - v.ix)) * 1000000 + v.iy * 1000 + v.ix) AS value
    FROM (SELECT * FROM dense WHERE inside AND value IS NULL) m JOIN (SELECT * FROM dense WHERE value IS NOT NULL) v ON v.{key} = m.{key} GROUP BY m.{key}, m.iy, m.ix)
  SELECT d.{key}, d.iy, d.ix, CASE WHEN d.inside THEN coalesce(d.value, n.value, 0.0) END AS value
  FROM dense d LEFT JOIN near n USING ({key}, iy, ix)"""


@query(_fill_sql(C))
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.fill_pairs(fill.on_template(fx.days(spark, sf_dir), fx.coarse_mask(spark)))


@query(_fill_sql(C))
def nearest_fill_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.fill_planes(fill.on_template(fx.days(spark, sf_dir), fx.coarse_mask(spark)), fx.COARSE, fx.COARSE)


_MONTH_SUMS = f"(SELECT month, iy, ix, sum(value) AS value FROM {N} GROUP BY ALL)"


def _month_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.days(spark, sf_dir, fx.FINE).groupBy("month", "iy", "ix").agg(F.sum("value").alias("value"))


@query(_fill_sql(_MONTH_SUMS, "month", FINE_MASK))
def nearest_fill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly fields on the fine grid in bands of five rows and strips of five columns."""
    return fill.fill_blocks(_month_sums(spark, sf_dir), fx.fine_mask(spark), fx.FINE, fx.FINE, ["month"], cells=200)


@query(_fill_sql(f"(SELECT * FROM {C} WHERE iy = 0)"))
def masked_fill_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first row has values, two of its cells lie inside: most days fall back to 0."""
    return fill.fill_masked(fx.days(spark, sf_dir).filter("iy = 0"), fx.coarse_mask(spark), fx.COARSE, fx.COARSE)


@query(f"SELECT day, iy, ix, a.value + b.value AS value FROM {C} a JOIN {LOW} b USING (day, iy, ix)")
def field_add_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.add_aligned(fx.days(spark, sf_dir), fx.days(spark, sf_dir, agg=F.min))


@query(f"SELECT a.day, a.iy, a.ix, a.value + b.value AS value FROM {C} a JOIN (SELECT day, 7 - iy AS iy, ix, value FROM {LOW}) b USING (day, iy, ix)")
def field_add_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids whose axes run in opposite ways and differ by up to 0.00008: a band join of the axes leads the sum."""
    lat, turned = _axis(spark, sf_dir, fx.COARSE, 0.125, 0.25), _axis(spark, sf_dir, fx.COARSE, 1.875, -0.25)
    lon = lat.withColumn("axis", F.lit("lon"))
    shift = F.col("coord") + (F.col("idx") % 3 - 1) * 0.00008
    return correct.add_on_same_grid(fx.days(spark, sf_dir), fx.days(spark, sf_dir, agg=F.min), lat.unionByName(lon), turned.unionByName(lon).withColumn("coord", shift))


_THERE = "(SELECT DISTINCT year(o_orderdate) AS y FROM orders)"
_YEARS = f"""(SELECT CAST(range AS INT) AS year, CAST(CASE WHEN range <= 1985 AND EXISTS (SELECT 1 FROM {_THERE} WHERE y = 1985) THEN 1985
  WHEN range <= 1990 AND EXISTS (SELECT 1 FROM {_THERE} WHERE y = 1990) THEN 1990
  ELSE coalesce((SELECT max(y) FROM {_THERE} WHERE y <= range), (SELECT min(y) FROM {_THERE})) END AS INT) AS predictor_year FROM range(1961, 2016))"""


@query(f"SELECT * FROM {_YEARS}")
def predictor_year_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = fx.yearly_feature(spark, sf_dir).select("feature", "year")
    wanted = there.select("feature").distinct().select("feature", F.explode(F.sequence(F.lit(1961), F.lit(2015))).alias("year"))
    return axes.predictor_years(there, wanted).select("year", "predictor_year")


@query(f"SELECT feature, iy, ix, sum(value) / count(value) AS value FROM {_YEARS} m JOIN {fx.YEARLY_SQL} p ON p.year = m.predictor_year GROUP BY ALL")
def yearly_predictor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.yearly_mean(fx.yearly_feature(spark, sf_dir), 1961, 2015)


STATS = f"""(SELECT feature, coalesce(avg(value) FILTER (inside), 0) AS mean, CASE WHEN stddev_pop(value) FILTER (inside) >= 1e-6 THEN stddev_pop(value) FILTER (inside) ELSE 1.0 END AS std
  FROM {fx.STATIC_SQL} JOIN {MASK} USING (iy, ix) GROUP BY feature)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.feature_stats(fx.static_features(spark, sf_dir), fx.coarse_mask(spark))


@query(f"SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std FROM {STATS}")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"SELECT feature, iy, ix, round((value - mean) / std, 9) AS value FROM {fx.STATIC_SQL} JOIN {STATS} USING (feature)")
def feature_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.zscore(fx.static_features(spark, sf_dir), _stats(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(f"""SELECT iy, ix, size_top IS NOT NULL AND size_total IS NOT NULL AS valid, size_top, size_total FROM (SELECT iy, ix, max(value) FILTER (feature = 'size_top') AS size_top,
  max(value) FILTER (feature = 'size_total') AS size_total FROM {fx.STATIC_SQL} GROUP BY ALL)""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.feature_matrix(fx.static_features(spark, sf_dir), ["size_top", "size_total"])


@query(f"""WITH m AS (SELECT month, iy, ix, CASE WHEN inside THEN value END AS value FROM {M} LEFT JOIN {MASK} USING (iy, ix)), s AS (SELECT month, avg(value) AS mean, greatest(coalesce(stddev_pop(value), 1), 1e-6) AS std FROM m GROUP BY month)
  SELECT month, iy, ix, round(coalesce((value - mean) / std, 0), 9) AS value FROM m JOIN s USING (month)""")
def target_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.standardise_target(fx.monthly(spark, sf_dir), fx.coarse_mask(spark)).withColumn("value", F.round("value", 9))


@query(f"""WITH m AS (SELECT month, iy, ix, CASE WHEN inside THEN value END AS value FROM {M} LEFT JOIN {MASK} USING (iy, ix))
  SELECT month, iy, ix, round(coalesce(value, avg(value) OVER (PARTITION BY month)), 6) AS value FROM m""")
def target_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the target taken back to its own scale; what was missing is the month's mean."""
    masked = fill.apply_mask(fx.monthly(spark, sf_dir), fx.coarse_mask(spark))
    stats = predictors.feature_stats(masked, by=["month"])
    back = predictors.destandardise(predictors.zscore(masked, stats, ["month"]), stats)
    return back.select("month", "iy", "ix", F.round("value", 6).alias("value"))


_LAND_SQL = "(SELECT CAST(p_partkey // 8 % 8 AS INT) AS iy, CAST(p_partkey % 8 AS INT) AS ix, CAST(max(p_size) > 20 AS DOUBLE) AS value FROM part GROUP BY ALL)"


@query(f"""WITH f AS (SELECT * FROM {fx.STATIC_SQL} UNION ALL SELECT feature, iy, ix, sum(value) / count(value) AS value FROM {_YEARS} y JOIN {fx.YEARLY_SQL} p ON p.year = y.predictor_year GROUP BY ALL),
  s AS (SELECT feature, avg(f.value) FILTER (l.value > 0) AS mean, CASE WHEN stddev_pop(f.value) FILTER (l.value > 0) >= 1e-6 THEN stddev_pop(f.value) FILTER (l.value > 0) ELSE 1 END AS std FROM f LEFT JOIN {_LAND_SQL} l USING (iy, ix) GROUP BY feature)
  SELECT feature, iy, ix, round(coalesce((value - mean) / std, 0), 6) AS value FROM f JOIN s USING (feature)""")
def predictor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static and yearly layers told apart, the mask taken from the layer land_mask, scores by statistics inside it."""
    static = fx.static_features(spark, sf_dir)
    land = static.filter("feature = 'size_top'").select(F.lit("land_mask").alias("feature"), "iy", "ix", (F.col("value") > 20).cast("double").alias("value"))
    layers = static.unionByName(land).withColumn("step", F.lit(None).cast("int")).unionByName(fx.yearly_feature(spark, sf_dir).withColumnRenamed("year", "step"))
    scored, _, _, _ = predictors.load_predictors(layers, 1961, 2015, exclude=["land_mask"])
    return scored.withColumn("value", F.round("value", 6))


_ERRORS = """count(*) AS n, round(avg(abs(p - r)), 9) AS mae, round(sqrt(avg((p - r) * (p - r))), 9) AS rmse, round(avg(p - r), 9) AS bias,
  round(CASE WHEN count(*) > 1 AND var_pop(r) > 0 THEN 1 - sum((p - r) * (p - r)) / (var_pop(r) * count(*)) END, 9) AS r2"""
_PAIRS = f"(SELECT day, year, month, iy, ix, b.value AS p, a.value AS r FROM {C} a JOIN {LOW} b USING (day, year, month, iy, ix))"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH h AS (SELECT * FROM {_PAIRS} WHERE year BETWEEN {fx.HOLDOUT[0]} AND {fx.HOLDOUT[1]})
  SELECT month, {_ERRORS} FROM h GROUP BY month UNION ALL SELECT CAST(NULL AS INT), {_ERRORS} FROM h""")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.holdout(fx.days(spark, sf_dir, agg=F.min), fx.days(spark, sf_dir), *fx.HOLDOUT))


@query(f"SELECT month, {_ERRORS} FROM {_PAIRS} GROUP BY month")
def monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = fx.days(spark, sf_dir, agg=F.min).withColumnRenamed("value", "pred")
    pairs = fx.days(spark, sf_dir).withColumnRenamed("value", "ref").join(pred, ["day", "year", "month", "iy", "ix"])
    return _rounded(metrics.errors(pairs, ["month"]))


@query(f"SELECT month, avg(abs(p - r)) + 0.5 * avg((p - r) * (p - r)) AS loss FROM {_PAIRS} GROUP BY month")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = fx.days(spark, sf_dir, agg=F.min).withColumnRenamed("value", "pred")
    pairs = fx.days(spark, sf_dir).withColumnRenamed("value", "ref").join(pred, ["day", "year", "month", "iy", "ix"])
    return metrics.masked_loss(pairs, ["month"])


_STARTS = "(SELECT unnest([0, 12, 24]) AS s)"
_WEIGHT = "least(({i} - {s} + 1) / CAST(8 AS DOUBLE), (16 - ({i} - {s})) / CAST(8 AS DOUBLE), 1)"
_BLENDED = f"""SELECT month, iy, ix, round(sum((value + 2 * y0 + x0) * w) / greatest(sum(w), 1e-6), 6) AS value FROM (
  SELECT f.*, a.s AS y0, b.s AS x0, {_WEIGHT.format(i="f.iy", s="a.s")} * {_WEIGHT.format(i="f.ix", s="b.s")} AS w
  FROM {_MONTH_SUMS} f JOIN {_STARTS} a ON f.iy BETWEEN a.s AND a.s + 15 JOIN {_STARTS} b ON f.ix BETWEEN b.s AND b.s + 15) GROUP BY month, iy, ix"""


@query(_BLENDED)
def tile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that adds tile numbers to what it gets, on tiles of 16 with overlap 4."""
    cut = tiles.into_tiles(_month_sums(spark, sf_dir), fx.FINE, fx.FINE, 16, 4)
    made = tiles.blend(cut.withColumn("pred", F.col("value") + 2 * F.col("y0") + F.col("x0")), ["month"], overlap=4)
    return made.withColumn("value", F.round("value", 6))


@query(_BLENDED)
def tile_blend_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from blocks of 8 * 8 cells: each tile gathers the blocks it touches."""
    blocks = tiles.block_rows(_month_sums(spark, sf_dir), fx.FINE, fx.FINE, 8, ["month"])
    cut = tiles.halo_tiles(blocks, fx.FINE, fx.FINE, 8, 16, 4, ["month"])
    answer = F.transform("tile", lambda row: F.transform(row, lambda v: v + 2 * F.col("y0") + F.col("x0")))
    return tiles.blend_tiles(cut.withColumn("tile", answer), ["month"], 4).withColumn("value", F.round("value", 6))


@query(f"SELECT * FROM {CLIM} WHERE {MONTHS}")
def merge_month_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clim(spark, sf_dir)
    return clim.merge_month_parts(*[c.filter(F.col("month") == m) for m in (9, 5, 7, 6, 8)])


@query("""SELECT vec_id, CAST(i // 8 AS INT) AS iy, CAST(i % 8 AS INT) AS ix, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)""")
def plane_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fields.from_planes(fx.table(spark, sf_dir, "embeddings"), ["vec_id"], 8, "embedding")
    return fields.from_planes(fields.to_planes(cells, ["vec_id"], 8, 8), ["vec_id"], 8)


@query(f"SELECT * FROM {CLIM} WHERE {MONTHS}")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two months only; the others come from the source climatology."""
    c = _clim(spark, sf_dir)
    return clim.with_fallback(c.filter("month in (5, 6)"), c, on_missing_model="source")


@query(f"SELECT month, iy, ix, CASE WHEN {MONTHS} THEN value * 2 ELSE value END AS value FROM {CLIM}")
def clim_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clim(spark, sf_dir)
    return clim.assemble(c.withColumn("value", F.col("value") * 2), c)


@query("""SELECT count(*) FILTER (inside) AS n_land, count(*) FILTER (inside AND NOT test) AS n_train, count(*) FILTER (inside AND test) AS n_test
  FROM (SELECT max(p_size) > 20 AS inside, sum(p_size) % 2 = 1 AS test FROM part GROUP BY p_partkey // 8 % 8, p_partkey % 8)""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = predictors.feature_matrix(fx.static_features(spark, sf_dir), ["size_top", "size_total"])
    return metrics.split_counts(wide.select((F.col("size_top") > 20).alias("inside"), (F.col("size_total") % 2 == 1).alias("test")))


_IN_FILE = f"SELECT day, year, month, iy, ix, round(0.125 + 0.25 * iy, 6) AS lat, round(0.125 + 0.25 * ix, 6) AS lon, value FROM {C} WHERE {MONTHS}"


def _through_file(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    path = new_path(spark, layout)
    grid_nc.write_field_nc(fx.days(spark, sf_dir), path, fx.COARSE_AXIS, fx.COARSE_AXIS, "tmax", layout)
    return spark.read.format("grid_nc").load(path).filter(F.col("month").isin(5, 6, 7, 8, 9) & F.col("value").isNotNull())


@query(_IN_FILE)
def netcdf4_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily field written as deflated NetCDF-4 files by many tasks; slices of the output months read back."""
    return _through_file(spark, sf_dir, "netcdf4")


@query(_IN_FILE)
def netcdf_classic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through one classic file, written at places that the axes fix."""
    return _through_file(spark, sf_dir, "classic")


def _seen(name: str, table: str, day: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS rows, count(value) AS \"values\", min(value) AS low, max(value) AS high, {day.format('min')} AS first_day, {day.format('max')} AS last_day FROM {table}"


@query(f"""SELECT name, rows, "values", round(low, 4) AS low, round(high, 4) AS high, first_day, last_day FROM ({_seen("clim", CLIM, "CAST(NULL AS DATE)")} UNION ALL {_seen("anom", ANOM, "{}(day)")})""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed while two fields were written: counts, ranges, days."""
    root = new_path(spark, "recorded")
    store = fields.recorded(fields.write_field, lambda path: fields.load_field(spark, path), root, refine.DEFINITIONS)
    made = store("clim", _clim(spark, sf_dir))
    store("anom", clim.anomaly(clim.select_months(fx.days(spark, sf_dir)), made))
    found = spark.read.parquet(f"{root}/manifest")
    return found.select("name", "rows", "values", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "first_day", "last_day")


#: Small enough for a check on CPUs; the default Training is the full size.
QUICK = Training(epochs=20, patience=8, base=4, depth=3)
NAMES = ["size_top", "size_total"]


def _training(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Cells of the months to train on; ``daily``: the field of the tables, if it is at hand."""
    scored = predictors.zscore(fx.static_features(spark, sf_dir), _stats(spark, sf_dir))
    wide = predictors.feature_matrix(scored, NAMES)
    target = clim.select_months(_clim(spark, sf_dir) if daily is None else clim.climatology(daily, *fx.BASELINE))
    grid = fx.coarse_mask(spark).crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in (5, 6, 7, 8, 9)], "month int")))
    return grid.join(target, ["month", "iy", "ix"], "left").join(wide, ["iy", "ix"], "left")


@query()
def spatial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.split_cells(_training(spark, sf_dir), fx.COARSE, fx.COARSE, QUICK)


@query()
def unet_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stage(_training(spark, sf_dir), "cells")
    models = stage(learn.fit_models(cells, NAMES, fx.COARSE, fx.COARSE, QUICK), "models")
    fitted = learn.fitted_field(cells, models, NAMES, fx.COARSE, fx.COARSE, QUICK)
    return metrics.errors(fitted, ["month", "test"])


def _predicted(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Raw features on the fine grid, standardised by what came with the models."""
    models = stage(learn.fit_models(_training(spark, sf_dir, daily), NAMES, fx.COARSE, fx.COARSE, QUICK, _stats(spark, sf_dir)), "models")
    fine = regrid.regrid(fx.static_features(spark, sf_dir), fx.COARSE_GRID, fx.FINE_GRID, ["feature"], "linear_nearest")
    return learn.predict(predictors.feature_matrix(fine, NAMES), models, fx.fine_mask(spark), fx.FINE, fx.FINE, 24, 8, raw=True)


@query()
def unet_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir)


@query()
def importance_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.importance(learn.fit_models(_training(spark, sf_dir), NAMES, fx.COARSE, fx.COARSE, QUICK))


def _corners_sql(field: str, keys: str, targets: str = _TARGETS) -> str:
    on = lambda x: " AND ".join(f"{x}.{k} = m.{k}" for k in keys.split(", "))
    return f"""(SELECT y.t AS iy, x.t AS ix, y.w AS wy, x.w AS wx, {", ".join(f"m.{k}" for k in keys.split(", "))}, a.value AS v00, b.value AS v01, c.value AS v10, d.value AS v11
  FROM {targets} y CROSS JOIN {targets} x CROSS JOIN (SELECT DISTINCT {keys} FROM {field}) m
  LEFT JOIN {field} a ON {on("a")} AND a.iy = y.c AND a.ix = x.c LEFT JOIN {field} b ON {on("b")} AND b.iy = y.c AND b.ix = x.c + 1
  LEFT JOIN {field} c ON {on("c")} AND c.iy = y.c + 1 AND c.ix = x.c LEFT JOIN {field} d ON {on("d")} AND d.iy = y.c + 1 AND d.ix = x.c + 1
  WHERE coalesce(a.value, b.value, c.value, d.value) IS NOT NULL)"""


def _filled(name: str, field: str, mask: str = FINE_MASK) -> str:
    """CTEs that fill a daily field inside the mask, as ``_fill_sql`` does; the result is ``name``."""
    return f"""{name}_days AS MATERIALIZED (SELECT DISTINCT day FROM {field}), {name}_dense AS MATERIALIZED (SELECT d.day, k.iy, k.ix, k.inside, CASE WHEN k.inside THEN f.value END AS value
    FROM {name}_days d CROSS JOIN {mask} k LEFT JOIN {field} f ON f.day = d.day AND f.iy = k.iy AND f.ix = k.ix
  ), {name}_rows AS MATERIALIZED (SELECT day, iy, list({{'ix': ix, 'value': value}} ORDER BY ix) AS donors FROM {name}_dense WHERE value IS NOT NULL GROUP BY day, iy
  ), {name}_rownear AS (SELECT m.day, m.iy, m.ix, list_min(list_transform(r.donors, lambda v: ((m.iy - r.iy) * (m.iy - r.iy) + (m.ix - v.ix) * (m.ix - v.ix)) * 1000000 + r.iy * 1000 + v.ix)) AS code
    FROM {name}_dense m JOIN {name}_rows r ON r.day = m.day WHERE m.inside AND m.value IS NULL
  ), {name}_near AS (SELECT day, iy, ix, min(code) AS code FROM {name}_rownear GROUP BY ALL
  ), {name} AS MATERIALIZED (SELECT d.day, d.iy, d.ix, CASE WHEN d.inside THEN coalesce(d.value, v.value, 0.0) END AS value FROM {name}_dense d LEFT JOIN {name}_near n USING (day, iy, ix)
    LEFT JOIN {name}_dense v ON v.day = n.day AND v.iy = n.code % 1000000 // 1000 AND v.ix = n.code % 1000)"""


_BOTH = f"coalesce({_LINEAR}, {_NEAREST})"
_STEP = f"""WITH coarse AS MATERIALIZED (SELECT * FROM {C}), clim AS MATERIALIZED (SELECT month, iy, ix, avg(value) AS value FROM coarse WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
  anom AS MATERIALIZED (SELECT d.day, d.month, d.iy, d.ix, d.value - c.value AS value FROM coarse d LEFT JOIN clim c USING (month, iy, ix) WHERE d.{MONTHS}),
  fine_clim AS MATERIALIZED (SELECT month, iy, ix, {_BOTH} AS value FROM {_corners_sql("clim", "month")}),
  on_fine AS MATERIALIZED (SELECT day, iy, ix, {_BOTH} AS value FROM {_corners_sql("anom", "day")}), {_filled("anomaly", "on_fine")},
  raw AS MATERIALIZED (SELECT a.day, a.iy, a.ix, a.value + c.value AS value FROM anomaly a LEFT JOIN fine_clim c ON c.month = month(a.day) AND c.iy = a.iy AND c.ix = a.ix),
  means AS (SELECT day, cy AS iy, cx AS ix, avg(value) AS value FROM (SELECT *, {_EDGE.format('iy')} AS cy, {_EDGE.format('ix')} AS cx FROM raw) WHERE cy >= 0 AND cx >= 0 AND value IS NOT NULL GROUP BY ALL),
  residual AS MATERIALIZED (SELECT t.day, t.iy, t.ix, t.value - m.value AS value FROM coarse t LEFT JOIN means m USING (day, iy, ix) WHERE t.day IN (SELECT day FROM raw)),
  back_fine AS MATERIALIZED (SELECT day, iy, ix, {_BOTH} AS value FROM {_corners_sql("residual", "day")}), {_filled("back", "back_fine")},
  corrected AS MATERIALIZED (SELECT a.day, a.iy, a.ix, a.value + b.value AS value, {_EDGE.format('a.iy')} AS cy, {_EDGE.format('a.ix')} AS cx FROM raw a JOIN back b USING (day, iy, ix)),
  again AS (SELECT day, cy, cx, avg(value) AS value FROM corrected WHERE cy >= 0 AND cx >= 0 GROUP BY ALL),
  moved AS MATERIALIZED (SELECT p.day, p.iy, p.ix, CASE WHEN p.cy < 0 OR p.cx < 0 THEN p.value ELSE p.value + (t.value - m.value) END AS value FROM corrected p
    LEFT JOIN again m USING (day, cy, cx) LEFT JOIN coarse t ON t.day = p.day AND t.iy = p.cy AND t.ix = p.cx), {_filled("final", "moved")}
  SELECT day, iy, ix, round(value, 6) AS value FROM final"""


@query(_STEP)
def refine_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step from observed days to the consistent fine field, over all days of the output months."""
    daily = _observed(spark, sf_dir)
    # the source climatology on the fine grid stands for a prediction
    fine_clim = regrid.regrid(clim.climatology(daily, *fx.BASELINE), fx.COARSE_GRID, fx.FINE_GRID, ["month"], "linear_nearest")
    out = refine.refine(daily, fine_clim, fx.fine_mask(spark), fx.COARSE_GRID, fx.FINE_GRID, fx.BASELINE)
    return out["final"].withColumn("value", F.round("value", 6))


def _targets_sql(coarse: int, fine: int, ratio: int) -> str:
    """As ``_TARGETS``, of a grid ``ratio`` times as fine."""
    at = f"(range - {(ratio - 1) // 2}) / CAST({ratio} AS DOUBLE)"
    left = f"least(CAST(floor({at}) AS INT), {coarse - 2})"
    return f"(SELECT CAST(range AS INT) AS t, {left} AS c, round({at} - {left}, 12) AS w FROM range({fine}) WHERE {at} BETWEEN 0 AND {coarse - 1})"


def _parent_sql(index: str, coarse: int, ratio: int) -> str:
    at = f"({index} - {(ratio - 1) // 2}) / CAST({ratio} AS DOUBLE)"
    return f"CASE WHEN {at} >= 0 AND {at} < {coarse - 1} THEN CAST(floor({at} + 0.5) AS INT) ELSE -1 END"


def _step_sql(p: str, daily: str, fine_clim: str, mask: str, coarse: int, fine: int, ratio: int, fill_corrected: bool) -> str:
    """CTEs of one step from ``daily`` (day, month, year, iy, ix, value); the result is ``p``_final."""
    parent = lambda x: _parent_sql(x, coarse, ratio)
    spread = lambda field: f"(SELECT day, iy, ix, {_BOTH} AS value FROM {_corners_sql(field, 'day', _targets_sql(coarse, fine, ratio))})"
    added = f"{p}_added AS MATERIALIZED (SELECT a.day, a.iy, a.ix, a.value + b.value AS value FROM {p}_raw a JOIN {p}_back b USING (day, iy, ix))"
    corrected = f"{added}, {_filled(f'{p}_mended', f'{p}_added', mask)}" if fill_corrected else added
    held = f"{p}_mended" if fill_corrected else f"{p}_added"
    return f"""{p}_clim AS MATERIALIZED (SELECT month, iy, ix, avg(value) AS value FROM {daily} WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
  {p}_anom AS MATERIALIZED (SELECT d.day, d.iy, d.ix, d.value - c.value AS value FROM {daily} d LEFT JOIN {p}_clim c USING (month, iy, ix) WHERE d.{MONTHS}),
  {p}_on_fine AS MATERIALIZED {spread(f"{p}_anom")}, {_filled(f"{p}_anomaly", f"{p}_on_fine", mask)},
  {p}_raw AS MATERIALIZED (SELECT a.day, a.iy, a.ix, a.value + c.value AS value FROM {p}_anomaly a LEFT JOIN {fine_clim} c ON c.month = month(a.day) AND c.iy = a.iy AND c.ix = a.ix),
  {p}_means AS (SELECT day, {parent("iy")} AS iy, {parent("ix")} AS ix, avg(value) AS value FROM {p}_raw WHERE {parent("iy")} >= 0 AND {parent("ix")} >= 0 AND value IS NOT NULL GROUP BY ALL),
  {p}_residual AS MATERIALIZED (SELECT t.day, t.iy, t.ix, t.value - m.value AS value FROM {daily} t LEFT JOIN {p}_means m USING (day, iy, ix) WHERE t.day IN (SELECT day FROM {p}_raw)),
  {p}_back_fine AS MATERIALIZED {spread(f"{p}_residual")}, {_filled(f"{p}_back", f"{p}_back_fine", mask)}, {corrected},
  {p}_corrected AS MATERIALIZED (SELECT *, {parent("iy")} AS cy, {parent("ix")} AS cx FROM {held}),
  {p}_again AS (SELECT day, cy, cx, avg(value) AS value FROM {p}_corrected WHERE cy >= 0 AND cx >= 0 GROUP BY ALL),
  {p}_moved AS MATERIALIZED (SELECT p.day, p.iy, p.ix, CASE WHEN p.cy < 0 OR p.cx < 0 THEN p.value ELSE p.value + (t.value - m.value) END AS value FROM {p}_corrected p
    LEFT JOIN {p}_again m USING (day, cy, cx) LEFT JOIN {daily} t ON t.day = p.day AND t.iy = p.cy AND t.ix = p.cx), {_filled(f"{p}_final", f"{p}_moved", mask)}"""


#: Two steps of ratio 3: grids of 3, 9 and 27 points a side.
SIDES = (3, 9, 27)
CHAIN = [[round(first + step * i, 6) for i in range(n)] for n, first, step in zip(SIDES, (0.45, 0.15, 0.05), (0.9, 0.3, 0.1), strict=True)]
_MASK_27 = fx.mask_sql(27, 12)
_MASK_9 = f"(SELECT CAST(iy // 3 AS INT) AS iy, CAST(ix // 3 AS INT) AS ix, inside FROM {_MASK_27} WHERE iy % 3 = 1 AND ix % 3 = 1)"
_CHAIN = f"""WITH observed AS MATERIALIZED (SELECT * FROM {fx.days_sql(3)}), clim AS MATERIALIZED (SELECT month, iy, ix, avg(value) AS value FROM observed WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
  clim_9 AS MATERIALIZED (SELECT month, iy, ix, {_BOTH} AS value FROM {_corners_sql("clim", "month", _targets_sql(3, 9, 3))}),
  clim_27 AS MATERIALIZED (SELECT month, iy, ix, {_BOTH} AS value FROM {_corners_sql("clim", "month", _targets_sql(3, 27, 9))}),
  {_step_sql("one", "observed", "clim_9", _MASK_9, 3, 9, 3, False)},
  between AS MATERIALIZED (SELECT day, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, iy, ix, value FROM one_final),
  {_step_sql("two", "between", "clim_27", _MASK_27, 9, 27, 3, True)}
  SELECT day, iy, ix, round(value, 6) AS value FROM two_final"""


@query(_CHAIN)
def refine_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both steps in a row; climatologies come to the finer grids from twelve month slots, the middle mask from the fine one."""
    grids = [(a, a) for a in CHAIN]
    observed = _observed(spark, sf_dir, 3)
    slots = regrid.month_slots(clim.climatology(observed, *fx.BASELINE), 3, 3)
    clims = [stage(regrid.on_grid(slots, grids[0], g, ["month"], "linear_nearest"), "clim") for g in grids[1:]]
    fine = fx.mask(spark, 27, 12)
    masks = [regrid.mask_on_grid(fine, grids[2], g) for g in grids[1:]]
    out = refine.refine_twice(observed, clims, masks, grids, fx.BASELINE)
    return out[1]["final"].withColumn("value", F.round("value", 6))


@query()
def learned_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training, prediction of the fine climatology, and the whole step with it, as one chain."""
    daily = _observed(spark, sf_dir)
    predicted = stage(_predicted(spark, sf_dir, daily), "predicted")
    out = refine.refine(daily, predicted, fx.fine_mask(spark), fx.COARSE_GRID, fx.FINE_GRID, fx.BASELINE)
    return out["final"]
