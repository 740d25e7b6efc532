"""Grid files, CSV parts, fields on disk, streams, the command line."""

import datetime

import numpy as np
import pytest

from fieldloom import cli, fields, staging
from fieldloom.operators import climatology, metrics, regrid
from fieldloom.sources import grid_nc, tables
from fieldloom.streaming import daily as stream


def write_file(path, steps=5):
    lat, lon = np.array([2.0, 1.0, 0.0]), np.array([10.0, 11.0])
    values = np.arange(steps * 6, dtype=np.float32).reshape(steps, 3, 2)
    values[0, 0, 0] = -999
    grid_nc.write_grid_nc(
        str(path), {"time": steps, "lat": 3, "lon": 2},
        {"time": (("time",), np.arange(steps, dtype=np.float64), {"units": "days since 2001-07-01"}), "lat": (("lat",), lat, {}), "lon": (("lon",), lon, {}),
         "tmax": (("time", "lat", "lon"), values, {"units": "degC", "_FillValue": -999.0})}, {"title": "test"},
    )
    return values


def test_grid_file(spark, tmp_path):
    values = write_file(tmp_path / "a.nc")
    f = grid_nc.GridFile((tmp_path / "a.nc").read_bytes())
    assert f.attributes == {"title": "test"} and f.shape("tmax") == (5, 3, 2)
    grid_nc.register(spark)
    whole = grid_nc.read_grid_nc(spark, str(tmp_path / "*.nc"))
    sliced = spark.read.format("grid_nc").option("step_chunk", 2).load(str(tmp_path / "a.nc"))
    for df in (whole, sliced):
        rows = {(r["day"], r["iy"], r["ix"]): r["value"] for r in df.collect()}
        assert len(rows) == 30
        assert rows[datetime.date(2001, 7, 1), 2, 0] is None  # a fill value, and latitude turned to ascending
        assert rows[datetime.date(2001, 7, 2), 0, 1] == values[1, 2, 1]
    with pytest.raises(ValueError, match="NetCDF-4"):
        grid_nc.GridFile(b"\x89HDF\r\n\x1a\n")


def test_csv_parts(spark, tmp_path):
    one = spark.createDataFrame([(6, "b", 1.0)], "month int, feature string, v double")
    two = spark.createDataFrame([(5, "a", 2.0)], "month int, feature string, v double")
    assert tables.write_csv(one, f"{tmp_path}/p1") and tables.write_csv(two, f"{tmp_path}/p2")
    assert not tables.write_csv(one.filter("false"), f"{tmp_path}/p3")
    got = tables.read_csvs(spark, f"{tmp_path}/p*", ["month", "feature"]).collect()
    assert [r["month"] for r in got] == [5, 6]


def test_field_on_disk_prunes_months(spark, tmp_path):
    rows = [(datetime.date(2001, m, 1), 0, 0, float(m)) for m in range(1, 13)]
    fields.write_field(fields.daily(spark.createDataFrame(rows, "day date, iy int, ix int, value double")), f"{tmp_path}/f")
    df = climatology.select_months(fields.load_field(spark, f"{tmp_path}/f"), "5,6")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan.replace("isnotnull(month", "").replace("(", "") or "PartitionFilters: [" in plan
    assert sorted(r["value"] for r in df.collect()) == [5.0, 6.0]


def test_streams(spark, tmp_path):
    first = datetime.date(2001, 7, 1)
    rows = [(first + datetime.timedelta(days=d), 0, 0, float(d)) for d in range(4)]
    spark.createDataFrame(rows, stream.SCHEMA).write.parquet(f"{tmp_path}/in")
    clim = spark.createDataFrame([(7, 0, 0, 1.0)], "month int, iy int, ix int, value double")
    days = stream.read_days(spark, f"{tmp_path}/in")
    stream.write_days(stream.anomalies(days, clim), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [-1.0, 0.0, 1.0, 2.0]
    late = [(first + datetime.timedelta(days=100), 0, 0, 5.0)]
    spark.createDataFrame(late, stream.SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    q = stream.write_days(stream.monthly_means(stream.read_days(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/means", f"{tmp_path}/cp2")
    q.awaitTermination()
    assert [(r["first"], r["n"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/means").collect()] == [(first, 4, 1.5)]


def test_command_line(spark, tmp_path):
    write_file(tmp_path / "a.nc")
    do = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    do("import-nc", "--input", tmp_path / "a.nc", "--out", tmp_path / "daily")
    do("climatology", "--input", tmp_path / "daily", "--clim-out", tmp_path / "clim", "--anom-out", tmp_path / "anom", "--clim-start-year", 2001, "--clim-end-year", 2001)
    assert fields.load_field(spark, f"{tmp_path}/clim").count() == 6
    do("add", "--a", tmp_path / "anom", "--b", tmp_path / "anom", "--out", tmp_path / "sum")
    assert fields.load_field(spark, f"{tmp_path}/sum").count() == 30
    do("evaluate", "--pred", tmp_path / "daily", "--ref", tmp_path / "daily", "--out-csv", tmp_path / "m", "--eval-start-year", 2001, "--eval-end-year", 2001)
    assert tables.read_csvs(spark, f"{tmp_path}/m").filter("mae = 0").count() == 2


def write_layers(path):
    lat, lon = np.array([1.0, 0.0]), np.array([10.0, 11.0, 12.0])
    plane = np.arange(6, dtype=np.float64).reshape(2, 3)
    cube = np.stack([plane + 10 * k for k in range(3)])
    grid_nc.write_grid_nc(
        str(path), {"month": 3, "year": 2, "lat": 2, "lon": 3},
        {"lat": (("lat",), lat, {}), "lon": (("lon",), lon, {}), "month": (("month",), np.array([5, 6, 7], np.int32), {}), "year": (("year",), np.array([1985, 1990], np.int32), {}),
         "land_mask": (("lat", "lon"), (plane > 2).astype(np.float64), {}), "clim": (("month", "lat", "lon"), cube, {}), "pop": (("lat", "lon", "year"), cube[:2].transpose(1, 2, 0).copy(), {})},
    )


def test_masks_month_cubes_and_yearly_layers(spark, tmp_path):
    write_layers(tmp_path / "p.nc")
    rows = {(r["feature"], r["step"], r["iy"], r["ix"]): r["value"] for r in grid_nc.read_layers_nc(spark, f"{tmp_path}/p.nc").collect()}
    assert len(rows) == 6 * (1 + 3 + 2)
    assert rows["land_mask", None, 0, 0] == 1 and rows["land_mask", None, 1, 0] == 0  # latitude turned to ascending
    assert rows["clim", 6, 1, 2] == 12 and rows["pop", 1990, 0, 1] == 14
    one = grid_nc.read_layers_nc(spark, f"{tmp_path}/p.nc", exclude=["clim", "pop"])
    assert fields.inside_mask(one).filter("inside").count() == 3


def test_train_and_predict_from_raw_features(spark, tmp_path):
    write_layers(tmp_path / "p.nc")
    do = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    do("import-layers", "--input", tmp_path / "p.nc", "--out", tmp_path / "layers", "--vars", "land_mask,pop")
    do("prepare-predictors", "--input", tmp_path / "layers", "--features", "land_mask,pop", "--out", tmp_path / "wide")
    assert spark.read.parquet(f"{tmp_path}/wide").filter("pop between 0 and 16").count() == 6
    cells = [(m, i, j, float(i + j + m), True, 100.0 + i, 5.0 * j) for m in (5, 6) for i in range(8) for j in range(8)]
    spark.createDataFrame(cells, "month int, iy int, ix int, value double, inside boolean, a double, b double").write.parquet(f"{tmp_path}/cells")
    size = ["--ny", 8, "--nx", 8]
    do("train", "--cells", tmp_path / "cells", "--features", "a,b", *size, "--models-out", tmp_path / "models", "--metrics-csv", tmp_path / "m", "--importance-csv", tmp_path / "i", "--epochs", 5, "--base-channels", 2, "--depth", 2)
    got = tables.read_csvs(spark, f"{tmp_path}/m")
    assert got.columns[:6] == ["month", "n_land_total", "n_train", "n_test", "train_mae", "train_rmse"] and got.count() == 2 and got.filter("n_land_total = 64 and epochs = 5").count() == 2
    model = tables.read_models(spark, f"{tmp_path}/models").first()
    assert np.allclose(model["feature_means"], [103.5, 17.5]) and np.allclose(model["feature_stds"], [5.25**0.5, 5 * 5.25**0.5])
    spark.read.parquet(f"{tmp_path}/cells").filter("month = 5").select("iy", "ix", "a", "b").write.parquet(f"{tmp_path}/features")
    spark.range(64).selectExpr("cast(id div 8 as int) iy", "cast(id % 8 as int) ix", "1.0 value").write.parquet(f"{tmp_path}/mask")
    do("predict", "--features", tmp_path / "features", "--models", tmp_path / "models", "--mask", tmp_path / "mask", *size, "--out", tmp_path / "out", "--tile-size", 6, "--overlap", 2)
    assert fields.load_field(spark, f"{tmp_path}/out").filter("value is not null").count() == 128


def test_holdout_against_a_coarser_reference(spark):
    day = datetime.date(2001, 7, 1)
    axes = [0.5 + i for i in range(9)], [1.5 + 3 * i for i in range(3)]
    fine = fields.daily(spark.createDataFrame([(day, i, j, float(i)) for i in range(9) for j in range(9)], "day date, iy int, ix int, value double"))
    ref = fields.daily(spark.createDataFrame([(day, 1, 1, 5.0)], "day date, iy int, ix int, value double"))
    got = {r["month"]: r for r in metrics.holdout(fine, ref, 2001, 2001, fine=(axes[0], axes[0]), coarse=(axes[1], axes[1])).collect()}
    assert got[7]["n"] == 1 and abs(got[7]["bias"] + 1) < 1e-9


def test_all_months_have_a_slot(spark):
    some = spark.createDataFrame([(5, 0, 0, 1.0)], "month int, iy int, ix int, value double")
    slots = regrid.month_slots(some, 2, 2)
    assert slots.count() == 48 and slots.filter("value is not null").count() == 1


def test_scratch_tables_go_and_results_stay(spark):
    made = []
    with staging.scratch(spark, "outer") as keep:
        with staging.scratch(spark, "inner") as keep_inner:
            first = staging.stage(spark.range(5), "a")
            made += first.inputFiles()
            inner = keep_inner(first.filter("id > 1"))
        assert inner.count() == 3
        made += inner.inputFiles()
        out = keep(inner.selectExpr("id + 1 as id"))
    assert sorted(r["id"] for r in out.collect()) == [3, 4, 5]
    assert made and not any(staging.path_exists(spark, f) for f in made)
    with pytest.raises(ZeroDivisionError), staging.scratch(spark, "failed"):
        left = staging.stage(spark.range(1), "b").inputFiles()
        _ = 1 / 0
    assert not any(staging.path_exists(spark, f) for f in left)
