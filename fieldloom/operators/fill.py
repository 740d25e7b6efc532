"""Masks and nearest-neighbour filling inside them.

Distances are Euclidean in index space; among equally near donors the smaller row, then
the smaller column counts. ``fill_pairs`` joins missing cells to donors day by day and
suits small grids; ``fill_planes`` handles one day's plane per group in NumPy.
``fill_blocks`` cuts planes of any size: the exact distance is separable, so bands of
rows find each cell's nearest donor within its row, and strips of columns then the best
of a column's rows. Neither holds more than ``BLOCK_CELLS`` cells, or one row or column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import ship_package

#: Cells of a grid up to which missing cells are paired with donors.
PAIR_CELLS = 256
#: Cells of a band of rows, and of a strip of columns, that one task holds.
BLOCK_CELLS = 1 << 20
#: Bytes up to which a mask, a bit a cell, is broadcast.
MASK_BYTES = 32 << 20


def apply_mask(field: DataFrame, mask: DataFrame) -> DataFrame:
    """``field`` with null outside the mask (iy, ix, inside); cells that the mask lacks are outside."""
    m = mask.select("iy", "ix", "inside")
    return field.join(m, ["iy", "ix"], "left").withColumn("value", F.when(F.col("inside"), F.col("value"))).drop("inside").select(*field.columns)


def on_template(field: DataFrame, mask: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(keys, iy, ix, inside, value): a row for every cell of the mask at every key, as many as the dense field has."""
    grid = field.select(*keys).distinct().crossJoin(mask.select("iy", "ix", "inside"))
    return grid.join(field.select(*keys, "iy", "ix", "value"), [*keys, "iy", "ix"], "left")


def fill_pairs(dense: DataFrame, keys: Sequence[str] = ("day",), fallback: float = 0.0) -> DataFrame:
    """(keys, iy, ix, value) of ``on_template``'s rows: null outside; missing inside from the nearest donor, or ``fallback``."""
    masked = dense.withColumn("value", F.when(F.col("inside"), F.col("value")))
    missing = masked.filter("inside and value is null").select(*keys, "iy", "ix")
    donors = masked.filter("value is not null").select(*keys, F.col("iy").alias("jy"), F.col("ix").alias("jx"), F.col("value").alias("donor"))
    dy, dx = F.col("iy") - F.col("jy"), F.col("ix") - F.col("jx")
    near = missing.join(donors, list(keys)).groupBy(*keys, "iy", "ix").agg(F.min_by("donor", F.struct((dy * dy + dx * dx).alias("d"), "jy", "jx")).alias("near"))
    filled = F.coalesce("value", F.when(F.col("inside"), F.coalesce("near", F.lit(float(fallback)))))
    return masked.join(near, [*keys, "iy", "ix"], "left").select(*keys, "iy", "ix", filled.alias("value"))


def row_donors(valid: np.ndarray) -> np.ndarray:
    """Column of the nearest valid cell in each cell's own row, ties to the left; -1 in rows without one."""
    nx = valid.shape[1]
    cols = np.arange(nx)
    left = np.maximum.accumulate(np.where(valid, cols, -(1 << 30)), axis=1)
    right = np.minimum.accumulate(np.where(valid, cols, 1 << 30)[:, ::-1], axis=1)[:, ::-1]
    return np.where(valid.any(axis=1)[:, None], np.where(cols - left <= right - cols, left, right), -1)


def column_donors(near: np.ndarray, first_column: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Row whose donor (``near``: its column per row, -1 for none) is nearest to each cell (rows, columns); ties to the smaller row, -1 without any."""
    ny, far = len(near), np.int64(1) << 60
    along = np.where(near >= 0, np.square(near.astype(np.int64) - first_column - np.arange(near.shape[1])), far)
    best, by, open_ = along[rows, columns], np.where(near[rows, columns] >= 0, rows, -1), np.arange(len(rows))
    for step in range(1, ny):
        open_ = open_[best[open_] >= step * step]  # an equal distance may still be in a smaller row
        if not len(open_):
            break
        for other in (rows[open_] - step, rows[open_] + step):
            there = (other >= 0) & (other < ny)
            at, row = open_[there], other[there]
            d = along[row, columns[at]]
            d = np.where(d < far, d + step * step, far)
            better = (d < best[at]) | ((d == best[at]) & (d < far) & (row < by[at]))
            best[at[better]], by[at[better]] = d[better], row[better]
    return by


def nearest_donor(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the nearest valid cell of each cell; at least one must be valid."""
    ny, nx = valid.shape
    cols = np.arange(nx)
    left = np.maximum.accumulate(np.where(valid, cols, -(1 << 30)), axis=1)
    right = np.minimum.accumulate(np.where(valid, cols, 1 << 30)[:, ::-1], axis=1)[:, ::-1]
    take_left = (cols - left) <= (right - cols)
    near = np.where(take_left, left, right)  # in the own row; ties to the left
    along = np.where(valid.any(axis=1)[:, None], np.abs(near - cols).astype(np.int64), 1 << 30)
    best, by, bx = along**2, np.repeat(np.arange(ny)[:, None], nx, axis=1), near.copy()
    for step in range(1, ny):
        if step * step > best.max():
            break
        for to, frm in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            d = along[frm] ** 2 + step * step
            row = np.repeat(np.arange(ny)[frm][:, None], nx, axis=1)
            better = (d < best[to]) | ((d == best[to]) & (row < by[to]))
            best[to] = np.where(better, d, best[to])
            by[to] = np.where(better, row, by[to])
            bx[to] = np.where(better, near[frm], bx[to])
    return by, bx


def _fill_plane(ny: int, nx: int, keys: Sequence[str], fallback: float):
    def run(rows: pa.Table) -> pa.Table:
        iy, ix = rows["iy"].to_numpy(), rows["ix"].to_numpy()
        value = np.full((ny, nx), np.nan)
        inside = np.zeros((ny, nx), bool)
        value[iy, ix] = rows["value"].to_numpy()
        inside[iy, ix] = rows["inside"].to_numpy()
        valid = inside & np.isfinite(value)
        if valid.any():
            by, bx = nearest_donor(valid)
            out = np.where(inside, value[by, bx], np.nan)
        else:
            out = np.where(inside, fallback, np.nan)
        out = out[iy, ix]
        return pa.table([rows[k] for k in keys] + [rows["iy"], rows["ix"], pa.array(out, mask=np.isnan(out))], names=[*keys, "iy", "ix", "value"])

    return run


def fill_planes(dense: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("day",), fallback: float = 0.0) -> DataFrame:
    """The same as ``fill_pairs``, plane by plane; a group is one grid, whatever the number of days."""
    ship_package(dense.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in dense.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["iy int", "ix int", "value double"])
    return dense.select(*keys, "iy", "ix", "inside", "value").groupBy(*keys).applyInArrow(_fill_plane(ny, nx, keys, fallback), schema)


def _mask_bands(mask: DataFrame, h: int, nx: int) -> DataFrame:
    """(band, inside): a bit a cell of each band of h rows that has a cell inside."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(h * nx, bool)
        bits[(rows["iy"].to_numpy() % h) * nx + rows["ix"].to_numpy()] = True
        return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), "inside": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return mask.filter("inside").select("iy", "ix", F.floor(F.col("iy") / h).cast("int").alias("band")).groupBy("band").applyInArrow(run, "band int, inside binary")


def _band_pass(ny: int, nx: int, h: int, w: int, keys: Sequence[str], fallback: float):
    """Rows (keys, band, held, inside) to parts of strips or, where one band is the plane, to its cells."""
    strips = -(-nx // w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            for i in range(batch.num_rows):
                band, held, bits = column("band")[i].as_py(), column("held")[i], column("inside")[i].as_py()
                n = min(h, ny - band * h)
                inside = np.unpackbits(np.frombuffer(bits, np.uint8), count=h * nx)[: n * nx].reshape(n, nx).astype(bool) if bits else np.zeros((n, nx), bool)
                value = np.full((n, nx), np.nan)
                if held.is_valid:
                    value.ravel()[held.values.field(0).to_numpy()] = held.values.field(1).to_numpy()
                value[~inside] = np.nan
                near = row_donors(np.isfinite(value))
                same = lambda k, c: c.take(pa.array(np.full(k, i)))  # noqa: B023, E731
                if n == ny:
                    out = _settled(near, np.take_along_axis(value, np.maximum(near, 0), 1), inside, 0, fallback)
                    iy, ix = np.divmod(np.arange(ny * nx), nx)
                    yield pa.RecordBatch.from_arrays([*(same(ny * nx, column(k)) for k in keys), pa.array(iy, pa.int32()), pa.array(ix, pa.int32()), pa.array(out.ravel(), mask=np.isnan(out.ravel()))], [*keys, "iy", "ix", "value"])
                    continue
                donor = np.where(near >= 0, np.take_along_axis(value, np.maximum(near, 0), 1), np.nan)
                cut = lambda a, s: np.ascontiguousarray(a[:, s * w : (s + 1) * w]).tobytes()
                parts = [[cut(a, s) for s in range(strips)] for a in (near.astype(np.int32), donor, inside)]
                yield pa.RecordBatch.from_arrays([*(same(strips, column(k)) for k in keys), pa.array(range(strips), pa.int32()), same(strips, column("band")), *(pa.array(x, pa.binary()) for x in parts)], [*keys, "strip", "band", "near", "donor", "inside"])

    return run


def _settled(near: np.ndarray, donor: np.ndarray, inside: np.ndarray, first_column: int, fallback: float) -> np.ndarray:
    """Values of a strip of whole columns: null outside, inside from the cell's own row or the best other one."""
    own = near == first_column + np.arange(near.shape[1])
    out = np.where(inside & own, donor, np.nan)
    rows, columns = np.nonzero(inside & ~own)
    if len(rows):
        by = column_donors(near, first_column, rows, columns)
        out[rows, columns] = np.where(by >= 0, donor[np.maximum(by, 0), columns], fallback)
    return out


def _strip_pass(ny: int, nx: int, h: int, w: int, keys: Sequence[str], fallback: float):
    """Cells of each strip, from rows that come by key, strip and band: all bands of a strip are there."""
    bands = -(-ny // h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            for i, (strip, *held) in enumerate(zip(*(column(c).to_pylist() for c in ("strip", "near", "donor", "inside")), strict=True)):
                parts.append(held)
                if len(parts) < bands:
                    continue
                first, width = strip * w, min(w, nx - strip * w)
                near, donor, inside = (np.concatenate([np.frombuffer(b, t).reshape(-1, width) for b in x]) for x, t in zip(zip(*parts, strict=True), (np.int32, np.float64, bool), strict=True))
                parts = []
                out = _settled(near, donor, inside, first, fallback).ravel()
                iy, ix = np.divmod(np.arange(ny * width), width)
                same = pa.array(np.full(len(out), i))
                yield pa.RecordBatch.from_arrays([*(column(k).take(same) for k in keys), pa.array(iy, pa.int32()), pa.array(ix + first, pa.int32()), pa.array(out, mask=np.isnan(out))], [*keys, "iy", "ix", "value"])

    return run


def _together(run, rows: int = 1 << 16):
    """``run`` with its small batches put together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows or len(held) >= 1024:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return task


def fill_blocks(field: DataFrame, mask: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("day",), fallback: float = 0.0, cells: int = BLOCK_CELLS) -> DataFrame:
    """(keys, iy, ix, value) of the whole ny * nx grid at every key, as ``fill_pairs`` gives it, in bands of rows and strips of columns.

    The field comes as it is, without a row per missing cell, and is shuffled once by
    band; a strip gets, per cell, the nearest column of each row and its value. A plane
    that is one band is done within it.
    """
    spark = field.sparkSession
    ship_package(spark)
    h, w = max(1, min(ny, cells // nx)), max(1, min(nx, cells // ny))
    kinds = dict(field.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    cell = F.struct(((F.col("iy") % h) * nx + F.col("ix")).cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    held = field.filter("value is not null").groupBy(*keys, F.floor(F.col("iy") / h).cast("int").alias("band")).agg(F.collect_list(cell).alias("held"))
    every = field.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(-(-ny // h) - 1))).alias("band"))
    bands = _mask_bands(mask, h, nx)
    joined = every.join(held, [*keys, "band"], "left").join(F.broadcast(bands) if ny * nx <= 8 * MASK_BYTES else bands, "band", "left").select(*keys, "band", "held", "inside")
    out = f"{key_schema}, iy int, ix int, value double"
    if h >= ny:
        return joined.mapInArrow(_together(_band_pass(ny, nx, h, w, keys, fallback)), out)
    parts = joined.mapInArrow(_together(_band_pass(ny, nx, h, w, keys, fallback), 64), f"{key_schema}, strip int, band int, near binary, donor binary, inside binary")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "strip").sortWithinPartitions(*keys, "strip", "band")
    return dealt.mapInArrow(_together(_strip_pass(ny, nx, h, w, keys, fallback)), out)


def fill_masked(field: DataFrame, mask: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("day",), fallback: float = 0.0) -> DataFrame:
    """(keys, iy, ix, value) over the whole mask grid, by whichever way suits its size."""
    return fill_pairs(on_template(field, mask, keys), keys, fallback) if ny * nx <= PAIR_CELLS else fill_blocks(field, mask, ny, nx, keys, fallback)
