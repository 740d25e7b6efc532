"""Command line: ``python -m fieldloom.cli COMMAND ...``; tables are Parquet folders."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldloom import config, fields
from fieldloom.operators import climatology, correct, fill, learn, metrics, predictors, regrid
from fieldloom.plans import refine
from fieldloom.sources import grid_nc, tables
from fieldloom.staging import stage


def _axis(text: str) -> list[float]:
    """'first:step:n' or a comma list of coordinates."""
    if ":" in text:
        first, step, n = text.split(":")
        return [round(float(first) + float(step) * i, 6) for i in range(int(n))]
    return [float(x) for x in text.split(",")]


def _grid(text: str) -> tuple[list[float], list[float]]:
    lat, lon = text.split("/")
    return _axis(lat), _axis(lon)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fieldloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *names: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for n in names:
            p.add_argument(f"--{n}", required=True)
        return p

    command("import-nc", "read gridded files into a field", "input", "out").add_argument("--var")
    p = command("climatology", "monthly climatology and daily anomalies", "input", "clim-out", "anom-out")
    p.add_argument("--clim-start-year", type=int, default=config.BASELINE_YEARS[0])
    p.add_argument("--clim-end-year", type=int, default=config.BASELINE_YEARS[1])
    p.add_argument("--months", default=None)
    p = command("import-layers", "read masks, month cubes and predictors into a table", "input", "out")
    p.add_argument("--vars")
    p = command("prepare-predictors", "features as one column each; yearly ones as means over the years", "input", "features", "out")
    p.add_argument("--first-year", type=int, default=config.BASELINE_YEARS[0])
    p.add_argument("--last-year", type=int, default=config.BASELINE_YEARS[1])
    p = command("train", "fit a model per month; cells: month, iy, ix, value, inside and raw features", "cells", "features", "ny", "nx", "models-out", "metrics-csv", "importance-csv")
    for flag, kind, default in (("epochs", int, 800), ("patience", int, 80), ("lr", float, 1e-3), ("weight-decay", float, 1e-4), ("base-channels", int, 64), ("depth", int, 5), ("test-size", float, 0.2), ("random-state", int, 42)):
        p.add_argument(f"--{flag}", type=kind, default=default)
    p.add_argument("--month", type=int)
    p = command("predict", "monthly climatology on another grid", "features", "models", "mask", "ny", "nx", "out")
    p.add_argument("--tile-size", type=int, default=96)
    p.add_argument("--overlap", type=int, default=24)
    p = command("regrid", "regrid a daily field and fill it inside a mask", "input", "mask", "coarse", "fine", "out")
    p.add_argument("--method", choices=regrid.METHODS, default="linear_nearest")
    command("add", "sum of two aligned fields", "a", "b", "out")
    command("residual", "target less parent means", "raw", "target", "coarse", "fine", "agg-out", "res-out")
    command("consistent", "shift children to their parents' targets, then fill", "input", "target", "mask", "coarse", "fine", "out")
    p = command("refine", "a whole step", "input", "fine-clim", "mask", "coarse", "fine", "out")
    p.add_argument("--clim-start-year", type=int, default=config.BASELINE_YEARS[0])
    p.add_argument("--clim-end-year", type=int, default=config.BASELINE_YEARS[1])
    p.add_argument("--months", default=None)
    p.add_argument("--fill-corrected", action="store_true")
    p = command("export-nc", "a daily field as NetCDF files in a mounted folder", "input", "grid", "var", "out")
    p.add_argument("--layout", default="netcdf4", choices=["netcdf4", "classic"])
    p.add_argument("--step-chunk", type=int, default=30)
    p = command("evaluate", "errors over the hold-out years", "pred", "ref", "out-csv")
    p.add_argument("--eval-start-year", type=int, default=config.HOLDOUT_YEARS[0])
    p.add_argument("--eval-end-year", type=int, default=config.HOLDOUT_YEARS[1])
    p.add_argument("--coarse", help="grid of the reference, if coarser than the prediction's")
    p.add_argument("--fine", help="grid of the prediction")
    command("merge-csv", "CSV parts as one", "pattern", "out").add_argument("--sort-by", default="month,feature")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    load = lambda path: fields.load_field(spark, path)
    mask = fields.inside_mask(spark.read.parquet(args.mask)) if getattr(args, "mask", None) else None
    coarse, fine = (_grid(g) if (g := getattr(args, n, None)) else None for n in ("coarse", "fine"))
    match args.command:
        case "import-nc":
            fields.write_field(fields.daily(grid_nc.read_grid_nc(spark, args.input, args.var)), args.out)
        case "import-layers":
            grid_nc.read_layers_nc(spark, args.input, args.vars.split(",") if args.vars else None).write.parquet(args.out)
        case "prepare-predictors":
            layers = spark.read.parquet(args.input)
            static = layers.filter("step is null").select("feature", "iy", "ix", "value")
            yearly = layers.filter("step is not null").select("feature", F.col("step").alias("year"), "iy", "ix", "value")
            both = static if yearly.isEmpty() else static.unionByName(predictors.yearly_mean(yearly, args.first_year, args.last_year))
            predictors.feature_matrix(both, args.features.split(",")).write.parquet(args.out)
        case "climatology":
            daily = load(args.input)
            climatology.select_years(daily, args.clim_start_year, args.clim_end_year, check=True)
            fields.write_field(climatology.climatology(daily, args.clim_start_year, args.clim_end_year), args.clim_out)
            clim = load(args.clim_out)
            fields.write_field(climatology.anomaly(climatology.select_months(daily, args.months, check=True), clim), args.anom_out)
        case "train":
            names, size = args.features.split(","), (int(args.ny), int(args.nx))
            how = learn.unet.Training(args.epochs, args.patience, args.lr, args.weight_decay, args.base_channels, args.depth, args.test_size, args.random_state)
            cells = spark.read.parquet(args.cells)
            stats = stage(learn.wide_stats(cells, names), "feature-stats")
            cells = learn.scored(cells if args.month is None else cells.filter(F.col("month") == args.month), stats, names)
            tables.write_models(learn.fit_models(cells, names, *size, how, stats), args.models_out)
            models = tables.read_models(spark, args.models_out)
            fitted = stage(learn.fitted_field(cells, models, names, *size, how), "fitted")
            tables.write_csv(learn.training_metrics(fitted, models, how, args.models_out), args.metrics_csv)
            tables.write_csv(learn.importance(models), args.importance_csv)
        case "predict":
            out = learn.predict(spark.read.parquet(args.features), tables.read_models(spark, args.models), mask, int(args.ny), int(args.nx), args.tile_size, args.overlap, raw=True)
            fields.write_field(out, args.out)
        case "regrid":
            on_fine = regrid.regrid(load(args.input), coarse, fine, ["day"], args.method)
            fields.write_field(fields.daily(fill.fill_masked(on_fine, mask, len(fine[0]), len(fine[1]))), args.out)
        case "add":
            fields.write_field(fields.daily(correct.add_aligned(load(args.a), load(args.b), check=True)), args.out)
        case "residual":
            raw = load(args.raw).select("day", "iy", "ix", "value")
            mean = regrid.parent_mean(regrid.with_parents(raw, fine, coarse))
            fields.write_field(fields.daily(mean), args.agg_out)
            fields.write_field(fields.daily(correct.residual(correct.restrict_days(load(args.target), raw), load(args.agg_out))), args.res_out)
        case "consistent":
            placed = regrid.with_parents(load(args.input).select("day", "iy", "ix", "value"), fine, coarse)
            moved = correct.make_consistent(placed, correct.restrict_days(load(args.target), placed))
            fields.write_field(fields.daily(fill.fill_masked(moved, mask, len(fine[0]), len(fine[1]))), args.out)
        case "refine":
            write = lambda df, path: fields.write_field(fields.daily(df) if "day" in df.columns else df, path)
            refine.refine(load(args.input), load(args.fine_clim), mask, coarse, fine, (args.clim_start_year, args.clim_end_year), args.months, args.fill_corrected, fields.recorded(write, load, args.out, refine.DEFINITIONS))
        case "export-nc":
            grid_nc.write_field_nc(load(args.input), args.out, *_grid(args.grid), args.var, args.layout, args.step_chunk)
        case "evaluate":
            tables.write_csv(metrics.holdout(load(args.pred), load(args.ref), args.eval_start_year, args.eval_end_year, fine=fine, coarse=coarse), args.out_csv)
        case "merge-csv":
            tables.write_csv(tables.read_csvs(spark, args.pattern, args.sort_by.split(",")), args.out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("fieldloom").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    main()
