"""Filling by bands and strips against pairs of all cells."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.operators import fill

DAY = datetime.date(2001, 7, 1)
SCHEMA = "day date, iy int, ix int, value double"


def cells(spark, planes, mask):
    rows = [(DAY + datetime.timedelta(days=d), int(y), int(x), None if np.isnan(v) else float(v)) for d, p in enumerate(planes) for (y, x), v in np.ndenumerate(p)]
    inside = [(int(y), int(x), bool(v)) for (y, x), v in np.ndenumerate(mask)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(inside, "iy int, ix int, inside boolean")


def random_planes(ny, nx, seed):
    rng = np.random.default_rng(seed)
    planes = [np.where(rng.random((ny, nx)) < share, rng.integers(0, 99, (ny, nx)), np.nan) for share in (0.02, 0.3, 0.9)]
    planes.append(np.where(np.arange(nx) == nx - 1, planes[2], np.nan))  # donors in one column
    planes.append(np.where(np.arange(ny)[:, None] == 0, planes[1], np.nan))  # in one row
    planes.append(np.full((ny, nx), np.nan))
    return planes, rng.random((ny, nx)) < 0.8


@pytest.mark.parametrize(("ny", "nx", "blocks"), [(13, 9, 20), (13, 9, 1), (7, 16, 48), (1, 9, 4), (9, 1, 4), (13, 9, 1 << 20)])
def test_equals_pairs(spark, ny, nx, blocks):
    planes, mask = random_planes(ny, nx, ny + nx + blocks % 7)
    field, inside = cells(spark, planes, mask)
    key = lambda df: sorted(map(tuple, df.collect()))
    got = {r[:3]: r[3] for r in map(tuple, fill.fill_blocks(field.filter("value is not null or iy = 0"), inside, ny, nx, cells=blocks, fallback=-1.0).collect())}
    assert len(got) == 6 * ny * nx
    assert got == {r[:3]: r[3] for r in map(tuple, fill.fill_pairs(fill.on_template(field, inside), fallback=-1.0).collect())}
    assert key(field.limit(0)) == [] and fill.fill_blocks(field.limit(0), inside, ny, nx, cells=blocks).count() == 0


def test_a_mask_without_cells(spark):
    field, inside = cells(spark, [np.ones((4, 4))], np.zeros((4, 4), bool))
    assert fill.fill_blocks(field, inside, 4, 4, cells=8).filter("value is not null").count() == 0
    assert fill.fill_blocks(field, inside.limit(0), 4, 4, cells=8).count() == 16


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 10_000))
def test_passes_equal_the_whole_plane(ny, nx, seed):
    valid = np.random.default_rng(seed).random((ny, nx)) < 0.15
    if not valid.any():
        valid[ny // 2, nx // 2] = True
    near = fill.row_donors(valid)
    rows, columns = np.nonzero(np.ones((ny, nx), bool))
    for first in range(0, nx, 3):
        part = near[:, first : first + 3]
        r, c = np.nonzero(np.ones(part.shape, bool))
        by = fill.column_donors(part, first, r, c).reshape(part.shape)
        want_y, want_x = (a[:, first : first + 3] for a in fill.nearest_donor(valid))
        assert np.array_equal(by, want_y) and np.array_equal(np.take_along_axis(near, want_x * 0 + first + np.arange(part.shape[1]), 1)[by, c.reshape(part.shape)], want_x)
    del rows, columns


def test_no_task_holds_more_than_its_block(spark, monkeypatch):
    """Parts of a plane of 60 * 60 in blocks of 180 cells: three rows, or three columns, at a time."""
    planes, mask = random_planes(60, 60, 5)
    field, inside = cells(spark, planes[:1], mask)
    made = fill._band_pass(60, 60, 3, 3, ["day"], 0.0)
    held = fill.fill_blocks(field, inside, 60, 60, cells=180)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert callable(made) and held.count() == 3600
    sizes = []
    settled = fill._settled
    monkeypatch.setattr(fill, "_settled", lambda near, *a: sizes.append(near.size) or settled(near, *a))
    strip = fill._strip_pass(60, 60, 3, 3, ["day"], 0.0)
    import pyarrow as pa

    rows = [{"day": DAY, "strip": 4, "band": b, "near": np.full((3, 3), 12 + b, np.int32).tobytes(), "donor": np.full((3, 3), float(b)).tobytes(), "inside": np.ones((3, 3), bool).tobytes()} for b in range(20)]
    assert sum(b.num_rows for b in strip(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=7)))) == 180 and sizes == [180]
