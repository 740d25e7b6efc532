"""Axes, regridding, filling, consistency: hand-made cases and invariants."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom import axes, config, fields
from fieldloom.operators import climatology, correct, fill, predictors, regrid, tiles
from fieldloom.plans import refine
from fieldloom.plans import fixtures as fx

DAY = datetime.date(2001, 7, 1)


def field(spark, plane, day=DAY):
    rows = [(day, int(y), int(x), None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "day date, iy int, ix int, value double")


def plane(df, ny, nx):
    out = np.full((ny, nx), np.nan)
    for r in df.collect():
        out[r["iy"], r["ix"]] = np.nan if r["value"] is None else r["value"]
    return out


def test_months():
    assert config.parse_months(" 7, 5,5") == [5, 7]
    assert config.parse_months("") == [5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        config.parse_months("5,5,13")
    with pytest.raises(ValueError):
        config.months_in([1, 2], "5")


def test_predictor_years():
    there = [1985, 1990, 1992, 1995, 2000, 2005, 2010, 2015]
    counts = np.unique([axes.predictor_year(y, there) for y in range(1961, 2016)], return_counts=True)[1]
    assert counts.tolist() == [25, 6, 3, 5, 5, 5, 5, 1] or counts.sum() == 55
    assert axes.predictor_year(1970, [2000, 2005]) == 2000


def test_parents_by_edge_mode():
    clip = axes.parents(fx.FINE_AXIS, fx.COARSE_AXIS)
    assert np.unique(clip, return_counts=True)[1].tolist() == [5, 3, 5, 5, 5, 5, 5, 5, 2]
    assert clip[37] == -1  # the last coarse centre itself
    assert (axes.parents(fx.FINE_AXIS, fx.COARSE_AXIS, "half") >= 0).all()
    with pytest.raises(ValueError):
        axes.edges(fx.COARSE_AXIS, "other")


def test_grid_checks():
    axes.check_same_grid(fx.COARSE_GRID, fx.COARSE_GRID)
    with pytest.raises(ValueError):
        axes.check_same_grid(fx.COARSE_GRID, ([c + 1 for c in fx.COARSE_AXIS], fx.COARSE_AXIS))


def test_linear_plane_is_exact(spark):
    y, x = np.meshgrid(fx.COARSE_AXIS, fx.COARSE_AXIS, indexing="ij")
    out = plane(regrid.regrid(field(spark, 3 * y - 2 * x + 1), fx.COARSE_GRID, fx.FINE_GRID), 40, 40)
    fy, fx_ = np.meshgrid(fx.FINE_AXIS, fx.FINE_AXIS, indexing="ij")
    inside = (fy >= 0.125) & (fy <= 1.875) & (fx_ >= 0.125) & (fx_ <= 1.875)
    assert np.array_equal(np.isfinite(out), inside)
    assert np.allclose(out[inside], (3 * fy - 2 * fx_ + 1)[inside])


def test_hole_nulls_linear_and_nearest_fills(spark):
    p = np.ones((8, 8))
    p[3, 3] = np.nan
    linear = plane(regrid.regrid(field(spark, p), fx.COARSE_GRID, fx.FINE_GRID), 40, 40)
    both = plane(regrid.regrid(field(spark, p), fx.COARSE_GRID, fx.FINE_GRID, method="linear_nearest"), 40, 40)
    assert np.isnan(linear[18, 18]) and np.nansum(both == 1) > np.nansum(linear == 1)


def test_all_missing_day_falls_back(spark):
    mask = fx.coarse_mask(spark)
    dense = field(spark, np.full((8, 8), np.nan)).join(mask, ["iy", "ix"])
    for out in (fill.fill_pairs(dense), fill.fill_planes(dense, 8, 8)):
        p = plane(out, 8, 8)
        assert set(p[np.isfinite(p)]) == {0.0} and np.isfinite(p).sum() == mask.filter("inside").count()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**6))
def test_nearest_donor_is_brute_force(ny, nx, seed):
    valid = np.random.default_rng(seed).random((ny, nx)) < 0.3
    valid.ravel()[seed % valid.size] = True
    by, bx = fill.nearest_donor(valid)
    donors = np.argwhere(valid)
    for y in range(ny):
        for x in range(nx):
            d, j, i = min(((y - j) ** 2 + (x - i) ** 2, j, i) for j, i in donors)
            assert (by[y, x], bx[y, x]) == (j, i)


def test_consistency_restores_parents(spark):
    rng = np.random.default_rng(1)
    fine, coarse = field(spark, rng.normal(size=(40, 40))), field(spark, rng.normal(size=(8, 8)))
    moved = correct.make_consistent(regrid.with_parents(fine, fx.FINE_GRID, fx.COARSE_GRID), coarse)
    row = correct.consistency_error(moved, coarse).first()
    assert row["cells"] == 64 and row["max_error"] < 1e-12
    kept = {(r["iy"], r["ix"]): r["value"] for r in fine.collect()}
    assert all(r["value"] == kept[r["iy"], r["ix"]] for r in moved.filter("cy < 0 or cx < 0").collect())


def test_missing_target_day_is_an_error(spark):
    with pytest.raises(ValueError):
        correct.restrict_days(field(spark, np.ones((2, 2))), field(spark, np.ones((2, 2)), datetime.date(2002, 1, 1)))
    with pytest.raises(ValueError):
        correct.add_aligned(field(spark, np.ones((2, 2))), field(spark, np.ones((3, 2))), check=True)


def test_finite(spark):
    df = spark.createDataFrame([(DAY, 0, 0, float("nan")), (DAY, 0, 1, float("inf")), (DAY, 0, 2, 1.0)], "day date, iy int, ix int, value double")
    assert [r["value"] for r in fields.daily(df).orderBy("ix").collect()] == [None, None, 1.0]


def test_resolve():
    held = {"tasmax": ("time", "lat", "lon"), "tmax": ("time", "lat", "lon"), "mask": ("lat", "lon")}
    assert fields.resolve_variable(held, ("time", "lat", "lon"), config.VARIABLE_NAMES["tmax"]) == "tmax"
    assert fields.resolve_variable(held, ("lat", "lon")) == "mask"
    with pytest.raises(KeyError):
        fields.resolve_variable(held, ("month", "lat", "lon"))
    assert "tasmax" not in config.VARIABLE_NAMES["tmin"]


def test_classify_predictors():
    held = {"dem": ("lat", "lon"), "ndvi": ("year", "lat", "lon"), "skip": ("lat", "lon"), "t": ("time", "lat", "lon")}
    assert predictors.classify(held, ["skip"]) == (["dem"], ["ndvi"])


def test_constant_feature_counts_as_one(spark):
    df = spark.createDataFrame([("f", 0, 0, 5.0), ("f", 0, 1, 5.0), ("g", 0, 0, None)], "feature string, iy int, ix int, value double")
    stats = {r["feature"]: (r["mean"], r["std"]) for r in predictors.feature_stats(df).collect()}
    assert stats == {"f": (5.0, 1.0), "g": (0.0, 1.0)}


@pytest.mark.parametrize("ny,nx,tile,overlap", [(40, 40, 16, 4), (40, 10, 16, 4), (8, 8, 16, 4), (17, 33, 16, 8)])
def test_blending_keeps_constants(spark, ny, nx, tile, overlap):
    cells = spark.range(ny * nx).selectExpr(f"cast(id div {nx} as int) iy", f"cast(id % {nx} as int) ix")
    cut = tiles.into_tiles(cells, ny, nx, tile, overlap)
    out = tiles.blend(cut.selectExpr("*", "7d as pred"), overlap=overlap)
    assert out.count() == ny * nx and out.filter("abs(value - 7) > 1e-9").isEmpty()
    assert cut.select("y0", "x0").distinct().count() == tiles.tile_table(spark, ny, nx, tile, overlap).count()


def test_baseline_and_months_must_exist(spark):
    daily = fields.daily(field(spark, np.ones((2, 2))))
    with pytest.raises(ValueError):
        climatology.select_years(daily, 1900, 1901, check=True)
    with pytest.raises(ValueError):
        climatology.select_months(daily, "1", check=True)
    with pytest.raises(KeyError):
        climatology.complete_months(climatology.climatology(daily, 2001, 2001), "6,7")


def test_step_is_consistent_with_its_target(spark):
    axes_ = [[round(0.5 * 5 + 5 * i, 6) for i in range(4)], [round(0.5 + i, 6) for i in range(20)]]
    grids = [(a, a) for a in axes_]
    rows = [(datetime.date(2001, 7, d), iy, ix, float(y + x + d)) for d in (1, 2) for iy, y in enumerate(axes_[0]) for ix, x in enumerate(axes_[0])]
    daily = fields.daily(spark.createDataFrame(rows, "day date, iy int, ix int, value double"))
    clims, masks = [], []
    for a in axes_[1:]:
        cells = [(7, i, j, float(y + x + 1.5), True) for i, y in enumerate(a) for j, x in enumerate(a)]
        df = spark.createDataFrame(cells, "month int, iy int, ix int, value double, inside boolean")
        clims.append(df.drop("inside"))
        masks.append(df.select("iy", "ix", "inside"))
    out = refine.refine(daily, clims[0], masks[0], grids[0], grids[1], (2001, 2001), [7], fill_corrected=True)
    assert np.isfinite(plane(out["final"].filter("day = '2001-07-01'"), 20, 20)).all()
    row = correct.consistency_error(regrid.with_parents(out["final"], grids[1], grids[0]), daily).first()
    assert row["cells"] == 32 and row["max_error"] < 1e-9
    assert out["delta"].count() == 32 and out["residual"].filter("value is null").isEmpty()


def test_fields_and_masks_come_to_another_grid(spark):
    mask = fx.coarse_mask(spark)
    same = regrid.mask_on_grid(mask, fx.COARSE_GRID, fx.COARSE_GRID)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, mask.collect()))
    held = {(r["iy"], r["ix"]): r["inside"] for r in mask.collect()}
    fine = {(r["iy"], r["ix"]): r["inside"] for r in regrid.mask_on_grid(mask, fx.COARSE_GRID, fx.FINE_GRID).collect()}
    assert len(fine) == 36 * 36 and fine[20, 20] is True and fine[2, 2] == held[0, 0]
    monthly = spark.createDataFrame([(5, i, j, float(i + j)) for i in range(8) for j in range(8)], "month int, iy int, ix int, value double")
    assert regrid.on_grid(monthly, fx.COARSE_GRID, fx.COARSE_GRID).count() == 64
    assert regrid.on_grid(monthly, fx.COARSE_GRID, fx.FINE_GRID).filter("iy = 7 and ix = 12").first()["value"] == 3.0
