"""Plans: what is shuffled, pruned and observed; joins of axes."""

import datetime
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import axes, fields, staging
from fieldloom.operators import correct, predictors, regrid, tiles
from fieldloom.plans import catalog, refine
from fieldloom.plans import fixtures as fx

DAY = datetime.date(2001, 7, 1)
SF = "/root/testdata/sf0.001"
GRIDS = fx.COARSE_GRID, fx.FINE_GRID


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def daily(spark, n, days=3, seed=0):
    v = np.random.default_rng(seed).normal(size=(days, n, n)).round(3)
    rows = [(DAY + datetime.timedelta(days=d), i, j, None if (d + i * j) % 13 == 5 else float(v[d, i, j])) for d in range(days) for i in range(n) for j in range(n)]
    return fields.daily(spark.createDataFrame(rows, "day date, iy int, ix int, value double"))


def step(spark):
    clim = spark.createDataFrame([(7, i, j, 20.0 + i - j) for i in range(40) for j in range(40)], "month int, iy int, ix int, value double")
    return daily(spark, 8), clim, fx.fine_mask(spark), *GRIDS, (2001, 2001), [7]


@pytest.mark.parametrize(("size", "fill"), [(2, False), (3, True)])
def test_colocated_step_equals_the_plain_one(spark, size, fill):
    a = refine.refine(*step(spark), fill_corrected=fill)
    b = refine.refine_colocated(*step(spark), fill_corrected=fill, size=size, buckets=3)
    for name in ("raw", "residual", "corrected", "final"):
        x, y = ({(r["day"], r["iy"], r["ix"]): r["value"] for r in out[name].select("day", "iy", "ix", "value").collect()} for out in (a, b))
        assert x.keys() == y.keys()
        assert all(x[k] is y[k] or abs(x[k] - y[k]) < 1e-9 for k in x), name


def test_fine_rows_of_a_stored_step_are_not_shuffled(spark):
    """Aggregate, sum, consistency and the join with the climatology: every exchange is one of coarse rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        field = daily(spark, 40, 2).select("day", "iy", "ix", "value")
        one, two = (staging.stage_bucketed(regrid.with_tiles(f, GRIDS[1], GRIDS[0], 2), name, "tile", 3) for f, name in ((field, "a"), (field.withColumn("value", F.col("value") * 2), "b")))
        clim = staging.stage_bucketed(regrid.with_tiles(field.filter(F.col("day") == DAY), GRIDS[1], GRIDS[0], 2).select("tile", F.lit(7).alias("month"), "iy", "ix", F.col("value").alias("clim")), "c", "tile", 3)
        target = staging.stage(regrid.tile_of_parent(daily(spark, 8, 2).select("day", "iy", "ix", "value"), GRIDS[0], 2), "t")
        with staging.colocated(spark):
            key, cell = ["tile", "day"], ["tile", "day", "iy", "ix"]
            means = regrid.parent_mean(one, key)
            assert "Exchange" not in explained(means)
            assert "Exchange" not in explained(correct.add_aligned(one, two, cell))
            assert "Exchange" not in explained(one.withColumn("month", F.month("day")).join(clim, ["tile", "month", "iy", "ix"], "left"))
            for df, most in ((correct.residual(target, means, cell), 1), (correct.make_consistent(one, target, key), 1)):
                plan = explained(df)
                assert len(re.findall(r"\bExchange hashpartitioning", plan)) == most
                # what is exchanged is the target alone
                below = plan.split("Exchange hashpartitioning")[1]
                assert "Bucketed: true" in plan and "Bucketed: true" not in below.split("\n", 1)[1].split("+- ")[1].split(":-")[0]
            assert correct.make_consistent(one, target, key).count() == field.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiles_keep_children_together(spark):
    placed = regrid.with_tiles(daily(spark, 40, 1), GRIDS[1], GRIDS[0], 3)
    assert placed.filter("cy >= 0 AND cx >= 0").groupBy("cy", "cx").agg(F.count_distinct("tile").alias("n")).filter("n > 1").isEmpty()
    both = placed.filter("cy >= 0 AND cx >= 0").select("cy", "cx", "tile").distinct()
    parents = regrid.tile_of_parent(daily(spark, 8, 1), GRIDS[0], 3).select(F.col("iy").alias("cy"), F.col("ix").alias("cx"), F.col("tile").alias("of_parent"))
    assert both.join(parents, ["cy", "cx"]).filter("tile <> of_parent").isEmpty()


def test_days_prune_the_target_by_year_and_month(spark, tmp_path):
    rows = [(datetime.date(2001 + k // 12, 1 + k % 12, d), 0, 0, 1.0) for k in range(24) for d in (1, 2)]
    fields.write_field(fields.daily(spark.createDataFrame(rows, "day date, iy int, ix int, value double")), f"{tmp_path}/f")
    spark.createDataFrame([(datetime.date(2001, 7, 1),), (datetime.date(2002, 3, 2),), (datetime.date(2002, 3, 2),)], "day date").write.parquet(f"{tmp_path}/d")
    out = correct.semi_join_days(fields.load_field(spark, f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/d"))
    assert "dynamicpruning" in explained(out).lower()
    assert out.count() == 2

    def files_read(plan):
        found = []
        todo = [plan]
        while todo:
            p = todo.pop()
            if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(p.executedPlan())
                continue
            if p.getClass().getSimpleName().endswith("QueryStageExec"):
                todo.append(p.plan())
            if "FileSourceScan" in p.getClass().getSimpleName() and "year" in p.toString():
                found.append(p.metrics().apply("numFiles").value())
            for k in range(p.children().size()):
                todo.append(p.children().apply(k))
        return found

    execution = out._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    assert len(spark.read.parquet(f"{tmp_path}/f").inputFiles()) == 24
    assert set(files_read(execution.executedPlan())) == {4}  # years and months prune each for itself


def axis(spark, points, name="lat"):
    return spark.createDataFrame([(name, i, float(c)) for i, c in enumerate(points)], "axis string, idx int, coord double")


@pytest.mark.parametrize("outer", ["clip", "half"])
def test_parent_map_is_parents(spark, outer):
    rng = np.random.default_rng(1)
    for fine, coarse in ((fx.FINE_AXIS, fx.COARSE_AXIS), (np.sort(rng.uniform(0, 10, 50)).round(3), np.sort(rng.uniform(1, 9, 7)).round(2)), ([0.125, 0.25, 1.875, 2.0, 0.5], fx.COARSE_AXIS)):
        got = axes.parent_map(axis(spark, fine), axis(spark, coarse), outer).collect()
        assert [r["parent"] for r in sorted(got, key=lambda r: r["idx"])] == axes.parents(fine, coarse, outer).tolist()


def test_axes_that_agree_within_tolerance(spark):
    a = np.linspace(-30, 60, 91)
    noise = np.random.default_rng(2).uniform(-9e-5, 9e-5, 91)
    pairs = axes.aligned(axis(spark, a), axis(spark, (a + noise)[::-1])).collect()
    assert sorted((r["idx_a"], r["idx_b"]) for r in pairs) == [(k, 90 - k) for k in range(91)]
    for wrong in (a[:-1], a + np.where(np.arange(91) == 40, 0.01, 0), np.append(a, 61)):
        with pytest.raises(ValueError, match="grids differ in lat"):
            axes.same_grid_map(axis(spark, a), axis(spark, wrong))
    dense = np.arange(10) * 1e-5  # several within the tolerance: the nearest counts
    assert all(r["idx_a"] == r["idx_b"] for r in axes.same_grid_map(axis(spark, dense), axis(spark, dense + 1e-6)).collect())
    assert axes.aligned(axis(spark, a), axis(spark, a).limit(0)).count() == 0


def test_sum_on_axes_that_differ_by_little(spark):
    a, b = daily(spark, 4, 2, 1).select("day", "iy", "ix", "value"), daily(spark, 4, 2, 2).select("day", "iy", "ix", "value")
    lat, lon = axis(spark, range(4)), axis(spark, range(4), "lon")
    turned = axis(spark, [3.00009, 2.0, 0.99995, 0.0]).unionByName(axis(spark, [0, 1, 2, 3.00005], "lon"))
    got = {(r["day"], r["iy"], r["ix"]): r["value"] for r in correct.add_on_same_grid(a, b, lat.unionByName(lon), turned).collect()}
    x, y = ({(r["day"], r["iy"], r["ix"]): r["value"] for r in f.collect()} for f in (a, b))
    want = {k: None if x[k] is None or y[k[0], 3 - k[1], k[2]] is None else x[k] + y[k[0], 3 - k[1], k[2]] for k in x}
    assert got == want
    with pytest.raises(ValueError, match="lon"):
        correct.add_on_same_grid(a, b, lat.unionByName(lon), lat.unionByName(axis(spark, [0, 1, 2, 3.01], "lon")))


def test_predictor_years_as_of(spark):
    there = {"a": [1985, 1990, 1992, 2000], "b": [1990, 1995], "c": [2005], "d": [1979, 1984, 1986]}
    rows = spark.createDataFrame([(f, y) for f, ys in there.items() for y in ys for _ in range(2)], "feature string, year int")
    wanted = spark.createDataFrame([(f, y) for f in there for y in range(1961, 2016)], "feature string, year int")
    got = {(r["feature"], r["year"]): r["predictor_year"] for r in axes.predictor_years(rows, wanted).collect()}
    assert got == {(f, y): axes.predictor_year(y, ys) for f, ys in there.items() for y in range(1961, 2016)}


def test_predictors_with_the_mask_among_them(spark):
    layers = [("land_mask", None, i, j, float(i)) for i in range(3) for j in range(3)] + [("dem", None, i, j, 10.0 * i + j) for i in range(3) for j in range(3)] + [("pop", y, i, j, float(y)) for y in (1985, 2000) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(layers, "feature string, step int, iy int, ix int, value double")
    scored, names, stats, mask = predictors.load_predictors(df, 1984, 2000, exclude=["land_mask"])
    assert names == ["dem", "pop"] and mask.filter("inside").count() == 6
    found = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    assert found["dem"][0] == 16.0 and found["pop"] == (pytest.approx((16 * 1985 + 2000) / 17), 1.0)
    assert scored.filter("feature = 'dem' AND iy = 1 AND ix = 1").first()["value"] == pytest.approx((11 - 16) / found["dem"][1])
    again, _, _, all_in = predictors.load_predictors(df.filter("feature = 'dem'"), 1984, 2000, names=["dem"], stats=stats)
    assert all_in.filter("inside").count() == 9 and again.count() == 9
    with pytest.raises(KeyError, match="nothing"):
        predictors.load_predictors(df, 1984, 2000, names=["nothing"])


def test_every_stored_stage_is_recorded_in_its_own_pass(spark, tmp_path):
    root = f"{tmp_path}/out"
    jobs = []

    def write(df, path):
        jobs.append(path)
        fields.write_field(fields.daily(df) if "day" in df.columns else df, path)

    out = refine.refine(*step(spark), store=fields.recorded(write, lambda path: fields.load_field(spark, path), root, refine.DEFINITIONS))
    rows = {r["name"]: r for r in spark.read.parquet(f"{root}/manifest").collect()}
    assert set(rows) == set(refine.DEFINITIONS) == {p.rsplit("/", 1)[1] for p in jobs} and len(jobs) == len(rows)
    for name, r in rows.items():
        have = out[name].agg(F.count("*"), F.count("value"), F.min("value"), F.max("value")).first()
        assert (r["rows"], r["values"]) == tuple(have[:2]) and np.allclose((r["low"], r["high"]), have[2:], atol=1e-4)
        assert (r["definition"], tuple(r["inputs"])) == (refine.DEFINITIONS[name][0], refine.DEFINITIONS[name][1]) and r["created_at"] is not None
    assert rows["final"]["first_day"] == DAY and rows["clim"]["first_day"] is None


@pytest.mark.parametrize(("ny", "nx", "side", "tile", "overlap"), [(40, 40, 8, 16, 4), (23, 31, 5, 12, 6), (9, 7, 4, 96, 24), (50, 10, 7, 20, 3)])
def test_halo_tiles_equal_tiles_of_cells(spark, ny, nx, side, tile, overlap):
    rng = np.random.default_rng(ny)
    rows = [(k, i, j, float(rng.integers(99))) for k in (1, 2) for i in range(ny) for j in range(nx) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k int, iy int, ix int, value double")
    cut = tiles.halo_tiles(tiles.block_rows(df, ny, nx, side, ["k"]), ny, nx, side, tile, overlap, ["k"])
    got = {(r["k"], r["y0"], r["x0"], r["y0"] + a, r["x0"] + b): v for r in cut.collect() for a, line in enumerate(r["tile"]) for b, v in enumerate(line) if v is not None}
    want = {(r["k"], r["y0"], r["x0"], r["iy"], r["ix"]): r["value"] for r in tiles.into_tiles(df, ny, nx, tile, overlap).collect()}
    assert got == want and all(len(r["tile"]) == r["y0_size"] for r in cut.collect())
    back = {(r["k"], r["iy"], r["ix"]): r["value"] for r in tiles.blend_tiles(cut, ["k"], overlap).collect()}
    assert back.keys() == {r[:3] for r in rows} and all(abs(back[r[:3]] - r[3]) < 1e-9 for r in rows)
    assert json.dumps(sorted(cut.columns))


@pytest.mark.parametrize("name", ["learned_step", "refine_step"])
def test_a_step_reads_its_days_from_a_stored_table(spark, monkeypatch, name):
    read, plain = [], catalog.clim.climatology

    def noted(df, *a):
        read.append(df)
        return plain(df, *a)

    def step_of(df, *a):
        read.append(df)
        return {"final": df}

    monkeypatch.setattr(catalog.clim, "climatology", noted)
    monkeypatch.setattr(catalog.refine, "refine", step_of)
    catalog.QUERIES[name](spark, SF)
    assert len(read) == 2
    for df in read:
        assert not any("lineitem" in f for f in df.inputFiles())
