"""NetCDF-4 files: layouts of earlier and later libraries, slices, predicates, and the distributed sink."""

import datetime
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom import fields
from fieldloom.sources import grid_nc, hdf5
from fieldloom.sources.hdf5 import UNDEFINED, Hdf5Grid, lookup3

DAY = datetime.date(2001, 7, 1)


def sample(steps=70, ny=5, nx=7, seed=0):
    v = np.random.default_rng(seed).normal(size=(steps, ny, nx)).astype(np.float32)
    v[0, 0, 0], v[1, 2, 3] = np.nan, -999
    return v


def nc4(path, v, chunk=None, dtype="f4", **axes):
    lat, lon = axes.get("lat", np.arange(v.shape[1])[::-1] * 1.0), np.arange(v.shape[2]) * 1.0
    hdf5.write_hdf5_grid(
        str(path), {"time": np.arange(len(v)) * 1.0, "lat": lat, "lon": lon}, {"residual": (("time", "lat", "lon"), dtype, {"_FillValue": -999.0, "units": "degC"}, lambda k: v[k])},
        {"title": "test"}, {"time": {"units": "days since 2001-07-01", "calendar": "proleptic_gregorian"}}, chunk,
    )


def classic(path, v):
    grid_nc.write_grid_nc(
        str(path), {"time": len(v), "lat": v.shape[1], "lon": v.shape[2]},
        {"time": (("time",), np.arange(len(v)) * 1.0, {"units": "days since 2001-07-01"}), "lat": (("lat",), np.arange(v.shape[1])[::-1] * 1.0, {}), "lon": (("lon",), np.arange(v.shape[2]) * 1.0, {}),
         "residual": (("time", "lat", "lon"), v, {"_FillValue": -999.0})},
    )


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_checksum_is_the_published_one():
    assert lookup3(b"") == 0xDEADBEEF and lookup3(b"Four score and seven years ago") == 0x17770551


@pytest.mark.parametrize("chunk", [None, (1, 5, 7), (4, 2, 3), (100, 5, 7)])
def test_slices_of_chunks(tmp_path, chunk):
    v = sample()
    nc4(tmp_path / "a.nc", v, chunk)
    f = Hdf5Grid((tmp_path / "a.nc").read_bytes())
    want = np.where(v == -999, np.nan, v)
    for a, b in ((0, None), (0, 1), (33, 41), (69, 70), (70, 70)):
        assert np.array_equal(f.read("residual", a, b), want[a:b], equal_nan=True)
    assert f.variables["residual"][0] == ("time", "lat", "lon") and f.attributes == {"title": "test"} and f.shape("residual") == v.shape
    if chunk == (4, 2, 3):
        assert len(list(f.chunks("residual", 33, 41))) == 3 * 3 * 3  # of 18 times 9


def test_an_index_of_several_levels(tmp_path):
    v = np.arange(5000, dtype=np.float32).reshape(5000, 1, 1)
    nc4(tmp_path / "a.nc", v, (1, 1, 1))
    f = Hdf5Grid((tmp_path / "a.nc").read_bytes())
    assert np.array_equal(f.read("residual"), v) and [c[0][0] for c in f.chunks("residual", 4321, 4323)] == [4321, 4322]


def old_style(v):
    """Superblock 0, a symbol table, version 1 headers with a continuation, version 1 filters, big-endian floats, Fletcher-32."""
    out = bytearray(b"\0" * 96)

    def put(raw):
        at = len(out)
        out.extend(raw + b"\0" * (-len(raw) % 8))
        return at

    def header(messages, split=False):
        body = [struct.pack("<HHB3x", k, len(m) + -len(m) % 8, 0) + m + b"\0" * (-len(m) % 8) for k, m in messages]
        first, more = (body[:1], body[1:]) if split else (body, [])
        if split:
            tail = b"".join(more)
            first.append(struct.pack("<HHB3x", 0x10, 16, 0) + struct.pack("<QQ", put(tail), len(tail)))
        raw = b"".join(first)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(raw)) + raw)

    space = lambda shape: struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    text = lambda s: struct.pack("<BBBBI", 0x13, 0, 0, 0, len(s))
    attribute = lambda n, s: struct.pack("<BxHHH", 1, len(n) + 1, 8, 8) + pad(n + b"\0") + pad(text(s)) + pad(struct.pack("<BBB5x", 1, 0, 0)) + s
    double = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
    places = {}
    for name, values in (("lat", np.arange(v.shape[1]) * 1.0), ("lon", np.arange(v.shape[2]) * 1.0), ("time", np.arange(len(v)) * 1.0)):
        held = [(12, attribute(b"CLASS", b"DIMENSION_SCALE"))] + [(12, attribute(b"units", b"days since 2001-07-01"))] * (name == "time")
        places[name] = header([(1, space(values.shape)), (3, double), (8, struct.pack("<BBQQ", 3, 1, put(values.tobytes()), values.nbytes)), *held], split=name == "time")
    chunks = []
    for k, plane in enumerate(v):
        raw = np.frombuffer(plane.astype(">f4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes()
        raw = raw if k == 1 else zlib.compress(raw)  # one chunk leaves deflate out
        chunks.append((k, put(raw + b"ABCD"), len(raw) + 4, 2 if k == 1 else 0))
    key = lambda n, mask, k: struct.pack("<IIQQQQ", n, mask, k, 0, 0, 0)
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(v), UNDEFINED, UNDEFINED) + b"".join(key(n, m, k) + struct.pack("<Q", at) for k, at, n, m in chunks) + key(0, 0, len(v)))
    filters = struct.pack("<BB6x", 1, 3) + struct.pack("<HHHHII", 2, 0, 1, 1, 4, 0) + struct.pack("<HHHH8sII", 1, 8, 1, 1, b"deflate\0", 4, 0) + struct.pack("<HHHH", 3, 0, 1, 0)
    refs = [struct.pack("<HHIQQ", k + 1, 1, 0, 8, places[d]) for k, d in enumerate(("time", "lat", "lon"))]
    heap = put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + 72) + b"".join(refs))
    listed = struct.pack("<BxHHH", 1, 15, 16, 16) + pad(b"DIMENSION_LIST\0") + struct.pack("<BBBBIBBBBI", 0x19, 0, 0, 0, 16, 0x17, 0, 0, 0, 8) + space((3,)) + b"".join(struct.pack("<IQI", 1, heap, k + 1) for k in range(3))
    big = struct.pack("<BBBBIHHBBBBI", 0x11, 0x21, 31, 0, 4, 0, 32, 23, 8, 0, 23, 127)
    fill = struct.pack("<BBBBI", 2, 2, 2, 1, 4) + np.array(-1, ">f4").tobytes()
    layout = struct.pack("<BBBQ4I", 3, 2, 4, tree, 1, *v.shape[1:], 4)
    places["tmax"] = header([(1, space(v.shape)), (3, big), (5, fill), (8, layout), (11, filters), (12, listed)])
    names, at = b"\0" * 8, {}
    for n in sorted(places):
        at[n], names = len(names), names + pad(n.encode() + b"\0")
    local = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), UNDEFINED, put(names)))
    node = put(b"SNOD" + struct.pack("<BxH", 1, len(places)) + b"".join(struct.pack("<QQIIQQ", at[n], places[n], 0, 0, 0, 0) for n in sorted(places)))
    group = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, node, at[max(places)]))
    root = header([(0x11, struct.pack("<QQ", group, local))])
    out[:96] = hdf5.MAGIC + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", 0, UNDEFINED, len(out), UNDEFINED) + struct.pack("<QQIIQQ", 0, root, 1, 0, group, local)
    return bytes(out)


def test_files_of_earlier_libraries():
    v = sample(9, 4, 6)
    f = Hdf5Grid(old_style(v))
    assert f.variables["tmax"][0] == ("time", "lat", "lon") and f.variables["time"][3]["units"] == "days since 2001-07-01"
    assert np.array_equal(f.read("tmax"), v, equal_nan=True) and np.array_equal(f.read("tmax", 1, 3), v[1:3], equal_nan=True)
    with pytest.raises(ValueError, match="superblock version 9"):
        Hdf5Grid(hdf5.MAGIC + b"\x09" + b"\0" * 90)
    with pytest.raises(ValueError, match="not an HDF5"):
        Hdf5Grid(b"CDF\x01" + b"\0" * 90)


def test_many_variables_lie_in_a_heap(tmp_path):
    """Links beyond eight go to a fractal heap of two direct blocks, listed by a B-tree of two levels."""
    n, out = 60, bytearray(b"\0" * 48)

    def put(raw):
        at = len(out)
        out.extend(raw)
        return at

    space, kind = hdf5._space_message((2,)), hdf5._type_message(np.dtype("i4"))
    objects = [put(hdf5._header([(1, space), (3, kind), (8, struct.pack("<BBQQ", 3, 1, put(struct.pack("<ii", k, -k)), 8))])) for k in range(n)]
    links = [struct.pack("<BBB", 1, 0, 4) + f"v{k:03d}".encode() + struct.pack("<Q", at) for k, at in enumerate(objects)]
    size, head = 512, 4 + 1 + 8 + 4
    blocks, ids = [bytearray(b"FHDB" + b"\0" * (head - 4)) for _ in range(2)], []
    for k, link in enumerate(links):
        b = 0 if len(blocks[0]) + len(link) <= size and len(blocks) and not any(i >= size for i, _ in ids) else 1
        ids.append((b * size + len(blocks[b]), len(link)))
        blocks[b] += link
    # the second block is of the second column, the table two wide
    places = [put(bytes(b).ljust(2 * size, b"\0")[: max(size, len(b))]) for b in blocks]
    wide = struct.pack("<HQQHHQH", 2, size, 65536, 32, 1, 0, 1)
    root = put(b"FHIB" + b"\0" * (1 + 8 + 4) + struct.pack("<QQ", *places))
    wide = struct.pack("<HQQHHQH", 2, size, 65536, 32, 1, root, 1)
    heap = put(b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + b"\0" * 96 + wide)
    records = [struct.pack("<IBIH", k, 0, at, length) for k, (at, length) in enumerate(ids)]
    leaf = lambda rows: put((b"BTLF" + b"\0\x05" + b"".join(rows)).ljust(512, b"\0"))
    left, right = leaf(records[:30]), leaf(records[31:])
    top = put((b"BTIN" + b"\0\x05" + records[30] + struct.pack("<QBQB", left, 30, right, n - 31)).ljust(512, b"\0"))
    index = put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, 512, 11, 1, 98, 40, top, 1, n))
    group = put(hdf5._header([(2, struct.pack("<BBQQ", 0, 0, heap, index))]))
    out[:48] = hdf5.MAGIC + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, UNDEFINED, len(out), group, 0)
    f = Hdf5Grid(bytes(out))
    assert list(f.variables) == [f"v{k:03d}" for k in range(n)] and all(f.read(f"v{k:03d}").tolist() == [k, -k] for k in range(n))


def test_same_rows_as_the_classic_form(spark, tmp_path):
    v = sample()
    classic(tmp_path / "c.nc", v)
    nc4(tmp_path / "n.nc", v, (7, 2, 3))
    grid_nc.register(spark)
    want = table(grid_nc.read_grid_nc(spark, str(tmp_path / "c.nc")))
    assert len(want) == v.size and sum(r[-1] is None for r in want) == 2
    assert table(grid_nc.read_grid_nc(spark, str(tmp_path / "n.nc"))) == want
    sliced = spark.read.format("grid_nc").option("step_chunk", 10).load(str(tmp_path / "n.nc"))
    assert sliced.rdd.getNumPartitions() == 5  # 14 steps each: whole chunks
    assert table(sliced) == want


def test_predicates_on_time_cut_slices(spark, tmp_path):
    nc4(tmp_path / "n.nc", sample(400))
    grid_nc.register(spark)
    whole = spark.read.format("grid_nc").option("step_chunk", 10).load(str(tmp_path / "n.nc"))
    assert whole.rdd.getNumPartitions() == 40
    some = whole.filter((F.col("month").isin(8)) & (F.col("year") == 2001) & (F.col("ix") > 2))
    assert some.rdd.getNumPartitions() == 4
    assert some.select("day").distinct().count() == 31 and some.count() == 31 * 5 * 4
    one = whole.filter(F.col("day") == DAY + datetime.timedelta(days=25))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 35
    span = whole.filter(F.col("day").between(DAY, DAY + datetime.timedelta(days=29)) & (F.col("day") > DAY) & (F.col("day") < datetime.date(2001, 7, 12)))
    assert span.rdd.getNumPartitions() == 2 and span.count() == 350
    assert whole.filter("year = 1900").count() == 0
    reader = grid_nc.GridReader({"path": str(tmp_path / "n.nc")})
    assert len(list(reader.pushFilters([grid_nc.EqualTo(("iy",), 1), grid_nc.In(("month",), (7,))]))) == 1


def field(spark, days=100, ny=4, nx=6):
    rng = np.random.default_rng(1)
    rows = [(DAY + datetime.timedelta(days=d), i, j, None if (d + i + j) % 9 == 0 else float(np.float32(rng.normal()))) for d in range(days) if d % 10 for i in range(ny) for j in range(nx) if (d * i + j) % 5]
    return rows, fields.daily(spark.createDataFrame(rows, "day date, iy int, ix int, value double")).repartition(7)


AXES = [round(0.1 + 0.5 * k, 3) for k in range(4)], [round(10.2 + 0.5 * k, 3) for k in range(6)]


def content(path):
    names = sorted(os.listdir(path)) if os.path.isdir(path) else [""]
    return [(n, open(os.path.join(path, n) if n else path, "rb").read()) for n in names]


@pytest.mark.parametrize("layout", ["netcdf4", "classic"])
def test_sink(spark, tmp_path, layout):
    rows, df = field(spark)
    path = f"{tmp_path}/out"
    grid_nc.write_field_nc(df, path, *AXES, "tmax", layout, 16, attributes={"title": "t"})
    want = {r[:3]: r[3] for r in rows if r[3] is not None}
    back = spark.read.format("grid_nc").load(path)
    assert {(r["day"], r["iy"], r["ix"]): r["value"] for r in back.filter("value is not null").collect()} == want
    assert back.count() == 90 * 24 and back.select("lat").distinct().count() == 4
    assert len(content(path)) == (6 if layout == "netcdf4" else 1) and os.listdir(tmp_path) == ["out"]
    first = content(path)
    with pytest.raises(Exception, match="there already"):
        grid_nc.write_field_nc(df, path, *AXES, "tmax", layout, 16)
    grid_nc.write_field_nc(df.repartition(3, "ix"), path, *AXES, "tmax", layout, 16, attributes={"title": "t"}, overwrite=True)
    assert content(path) == first


@pytest.mark.parametrize("layout", ["netcdf4", "classic"])
def test_a_task_that_dies_is_repeated_to_the_same_bytes(tmp_path, layout):
    import json

    days = [(DAY - grid_nc.EPOCH).days + k for k in range(40)]
    v = sample(40, 4, 6, seed=3)

    def batches(block, dies=False):
        for k in range(10 * block, 10 * block + 10):
            if dies and k % 10 == 5:
                raise RuntimeError("executor lost")
            iy, ix = np.divmod(np.arange(24), 6)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(24, block, np.int32)), pa.array(np.full(24, days[k], np.int32)).cast(pa.date32()), pa.array(iy.astype(np.int32)), pa.array(ix.astype(np.int32)), pa.array(v[k].ravel().astype(float))], ["block", "day", "iy", "ix", "value"])

    def written(name, order, dying=()):
        made = grid_nc.GridWriter({"path": f"{tmp_path}/{name}", "run": name, "layout": layout, "variable": "t", "step_chunk": "10", "lat": json.dumps(AXES[0]), "lon": json.dumps(AXES[1]), "days": json.dumps(days)}, False)
        for block in dying:
            with pytest.raises(RuntimeError):
                made.write(batches(block, dies=True))
        made.commit([made.write(batches(b)) for b in order])
        return content(f"{tmp_path}/{name}")

    assert written("a", (0, 1, 2, 3)) == written("b", (2, 0, 3, 1), dying=(1, 2))
    lacking = written("c", (0, 3))
    if layout == "classic":
        f = grid_nc.open_grid(lacking[0][1])
        assert np.isnan(f.read("t", 10, 30)).all() and np.array_equal(f.read("t", 30, 40), v[30:], equal_nan=True)
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]


def test_sink_needs_a_mounted_folder(spark):
    with pytest.raises(Exception, match="mounted"):
        grid_nc.write_field_nc(field(spark, 3)[1], "hdfs://x/y", *AXES, "t")
