"""Overlapping tiles and their blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import axes


def offsets(n: int, tile: int, overlap: int) -> list[int]:
    """First cells of the tiles along an axis; the last tile is flush with the border."""
    stride = max(1, tile - overlap)
    return sorted({*range(0, max(1, n - tile + 1), stride), max(0, n - tile)})


def count(ny: int, nx: int, tile: int = 96, overlap: int = 24) -> int:
    """How many tiles a grid is cut into."""
    return 1 if max(ny, nx) <= tile else len(offsets(ny, tile, overlap)) * len(offsets(nx, tile, overlap))


def tile_table(spark: SparkSession, ny: int, nx: int, tile: int = 96, overlap: int = 24) -> DataFrame:
    """(tile, y0, x0, h, w); one tile if the grid fits in it."""
    if max(ny, nx) <= tile:
        rows = [(0, 0, 0, ny, nx)]
    else:
        spots = [(y, x) for y in offsets(ny, tile, overlap) for x in offsets(nx, tile, overlap)]
        rows = [(k, y, x, min(tile, ny - y), min(tile, nx - x)) for k, (y, x) in enumerate(spots)]
    return axes.small(spark.createDataFrame(rows, "tile int, y0 int, x0 int, h int, w int"), len(rows))


def axis_tiles(spark: SparkSession, n: int, other: int, tile: int, overlap: int, index: str, first: str) -> DataFrame:
    """(index, first, size of the tile): the tiles along one axis that hold each cell."""
    starts = [0] if max(n, other) <= tile else offsets(n, tile, overlap)
    rows = [(i, s, min(tile, n - s)) for s in starts for i in range(s, min(n, s + tile))]
    return axes.small(spark.createDataFrame(rows, f"{index} int, {first} int, {first}_size int"), len(rows))


def into_tiles(cells: DataFrame, ny: int, nx: int, tile: int = 96, overlap: int = 24) -> DataFrame:
    """``cells`` once for each tile that holds them, with y0, x0 and the tile's size; two broadcast joins."""
    spark = cells.sparkSession
    return cells.join(axis_tiles(spark, ny, nx, tile, overlap, "iy", "y0"), "iy").join(axis_tiles(spark, nx, ny, tile, overlap, "ix", "x0"), "ix")


def block_rows(field: DataFrame, ny: int, nx: int, side: int, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(keys, by, bx, block): the field as arrays of side * side values in row order, null where it has no row or the grid ends."""
    at = ((F.col("iy") % side) * side + F.col("ix") % side).cast("int")
    spot = [F.floor(F.col(c) / side).cast("int").alias(b) for c, b in (("iy", "by"), ("ix", "bx"))]
    held = field.filter(F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1)).select(*keys, *spot, F.struct(at.alias("at"), "value").alias("cell"))
    held = held.groupBy(*keys, "by", "bx").agg(F.map_from_entries(F.collect_list("cell")).alias("held"))
    return held.select(*keys, "by", "bx", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.try_element_at("held", i)).alias("block"))


def halo_tiles(blocks: DataFrame, ny: int, nx: int, side: int, tile: int = 96, overlap: int = 24, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(keys, y0, x0, y0_size, x0_size, tile): overlapping tiles as arrays of rows, cut from ``block_rows``.

    A tile gathers the few blocks it touches, so what is exchanged is a block per tile
    that needs it, its halo, instead of a row per cell and tile.
    """
    spark = blocks.sparkSession
    one = max(ny, nx) <= tile

    def touched(n: int, block: str, first: str) -> DataFrame:
        rows = [(b, s, min(tile, n - s)) for s in ([0] if one else offsets(n, tile, overlap)) for b in range(s // side, -(-min(n, s + tile) // side))]
        return axes.small(spark.createDataFrame(rows, f"{block} int, {first} int, {first}_size int"), len(rows))

    sent = blocks.join(touched(ny, "by", "y0"), "by").join(touched(nx, "bx", "x0"), "bx")
    spot = ["y0", "x0", "y0_size", "x0_size"]
    wide = -(-nx // side) + 1
    held = sent.groupBy(*keys, *spot).agg(F.map_from_entries(F.collect_list(F.struct((F.col("by") * wide + F.col("bx")).alias("at"), "block"))).alias("held"))

    def value(y, x):
        block = F.try_element_at("held", (F.floor(y / side) * wide + F.floor(x / side)).cast("int"))
        return F.try_element_at(block, ((y % side) * side + x % side + 1).cast("int"))

    row = lambda y: F.transform(F.sequence(F.col("x0"), F.col("x0") + F.col("x0_size") - 1), lambda x: value(y, x))
    return held.select(*keys, *spot, F.transform(F.sequence(F.col("y0"), F.col("y0") + F.col("y0_size") - 1), row).alias("tile"))


def blend_tiles(made: DataFrame, keys: Sequence[str] = ("day",), overlap: int = 24, value: str = "tile") -> DataFrame:
    """(keys, iy, ix, value): tiles of predictions (``halo_tiles``' columns) as one field; missing predictions weigh nothing."""
    spot = ["y0", "x0", "y0_size", "x0_size"]
    rows = made.select(*keys, *spot, F.posexplode(value).alias("r", "row")).select(*keys, *spot, "r", F.posexplode("row").alias("c", "pred"))
    cells = rows.select(*keys, *spot, (F.col("y0") + F.col("r")).alias("iy"), (F.col("x0") + F.col("c")).alias("ix"), "pred")
    return blend(cells.filter("pred IS NOT NULL"), keys, overlap)


def ramp(i, n, edge: int):
    """Weight of cell i of n: linear from 1 / e at either end to 1, e = edge or half the length."""
    e = F.least(F.lit(edge), F.greatest(F.lit(1), F.floor(n / 2)))
    return F.least((i + 1) / e, (n - i) / e, F.lit(1.0)) if edge > 0 else F.lit(1.0)


def blend_weight(overlap: int = 24):
    """Weight of a cell in its tile, from columns iy, ix, y0, x0, y0_size, x0_size."""
    edge = max(8, overlap // 2)
    c = F.col
    return ramp(c("iy") - c("y0"), c("y0_size"), edge) * ramp(c("ix") - c("x0"), c("x0_size"), edge)


def blend(predictions: DataFrame, keys: Sequence[str] = (), overlap: int = 24) -> DataFrame:
    """(keys, iy, ix, value): predictions of overlapping tiles as one field."""
    w = blend_weight(overlap)
    return predictions.groupBy(*keys, "iy", "ix").agg((F.sum(F.col("pred") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("value"))
