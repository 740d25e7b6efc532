"""Gridded files: classic NetCDF (versions 1 and 2), and NetCDF-4 by ``hdf5``, without further libraries.

``read_grid_nc`` reads files through Spark (any store), a file per task. The data source
``grid_nc`` reads the files of a shared folder in slices of their first dimension, whole
chunks at a time; predicates on day, year and month cut slices before a byte of them is
read. It writes such files too (``write_field_nc``): each task writes its own days.
"""

from __future__ import annotations

import datetime
import glob
import itertools
import json
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from fieldloom.config import LAT_NAMES, LON_NAMES, TIME_NAMES
from fieldloom.fields import resolve_coordinate, resolve_variable
from fieldloom.session import ship_package
from fieldloom.sources.hdf5 import Hdf5Grid, write_hdf5_grid

_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


class GridFile:
    """Header of a classic file, and its variables as arrays."""

    def __init__(self, data: bytes | np.memmap):
        self.data, self.at = data, 4
        head = bytes(data[:4])
        if head == b"\x89HDF":
            raise ValueError("this is a NetCDF-4 (HDF5) file: open_grid reads it")
        if head[:3] != b"CDF" or head[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.wide = head[3] == 2
        self.records = self._int()
        self.dims = [(self._name(), self._int()) for _ in range(self._count(_DIMENSION))]
        self.attributes = self._attributes()
        self.variables: dict[str, tuple[tuple[str, ...], str, int, dict]] = {}
        sizes = {}
        for _ in range(self._count(_VARIABLE)):
            name = self._name()
            ids = [self._int() for _ in range(self._int())]
            attributes, kind, size = self._attributes(), self._int(), self._unpack(">I", 4)
            begin = self._unpack(">q", 8) if self.wide else self._int()
            self.variables[name] = (tuple(self.dims[i][0] for i in ids), _KINDS[kind], begin, attributes)
            sizes[name] = size
        self.record_dim = next((n for n, k in self.dims if k == 0), None)
        own = [n for n, v in self.variables.items() if v[0][:1] == (self.record_dim,)]
        self.stride = sum(sizes[n] for n in own) if len(own) != 1 else self._slice_bytes(own[0])

    def _unpack(self, form: str, n: int) -> int:
        self.at += n
        return struct.unpack(form, bytes(self.data[self.at - n : self.at]))[0]

    def _int(self) -> int:
        return self._unpack(">i", 4)

    def _count(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError("damaged header")
        return n

    def _name(self) -> str:
        n = self._int()
        raw = bytes(self.data[self.at : self.at + n])
        self.at += -(-n // 4) * 4
        return raw.decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._count(_ATTRIBUTE)):
            name, kind, n = self._name(), np.dtype(_KINDS[self._int()]), self._int()
            raw = bytes(self.data[self.at : self.at + n * kind.itemsize])
            self.at += -(-n * kind.itemsize // 4) * 4
            out[name] = raw.decode() if kind.kind == "S" else np.frombuffer(raw, kind).tolist()
        return out

    def chunk_shape(self, name: str) -> tuple[int, ...]:
        """What lies together: a slice of the first dimension."""
        return (1, *self.shape(name)[1:])

    def shape(self, name: str) -> tuple[int, ...]:
        sizes = dict(self.dims)
        return tuple(self.records if sizes[d] == 0 else sizes[d] for d in self.variables[name][0])

    def _slice_bytes(self, name: str) -> int:
        return int(np.prod(self.shape(name)[1:], dtype=np.int64)) * np.dtype(self.variables[name][1]).itemsize

    def read(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """The variable, or its slices first..last - 1 along its first dimension; fill values become NaN in float fields."""
        dims, kind, begin, attributes = self.variables[name]
        shape, kind = self.shape(name), np.dtype(kind)
        if not shape:
            return np.frombuffer(bytes(self.data[begin : begin + kind.itemsize]), kind)[0]
        last = shape[0] if last is None else min(last, shape[0])
        each = self._slice_bytes(name)
        if dims[0] == self.record_dim:
            raw = b"".join(bytes(self.data[begin + k * self.stride : begin + k * self.stride + each]) for k in range(first, last))
        else:
            raw = bytes(self.data[begin + first * each : begin + last * each])
        out = np.frombuffer(raw, kind).reshape(last - first, *shape[1:])
        if kind.kind == "f":
            out = out.astype(kind.newbyteorder("="))
            for key in ("_FillValue", "missing_value"):
                if key in attributes:
                    out[out == np.float64(attributes[key][0]).astype(out.dtype)] = np.nan
        return out


def open_grid(data: bytes | np.memmap) -> GridFile | Hdf5Grid:
    return Hdf5Grid(data) if bytes(data[:4]) == b"\x89HDF" else GridFile(data)


def days_of(values: np.ndarray, units: str) -> list[datetime.date]:
    """Dates of a time axis in days or hours since a date."""
    found = re.match(r"\s*(days|hours)\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})", units or "")
    if not found:
        raise ValueError(f"time units {units!r} are not understood")
    start, step = datetime.datetime(*map(int, found.groups()[1:])), {"days": 86400, "hours": 3600}[found[1]]
    return [(start + datetime.timedelta(seconds=float(v) * step)).date() for v in values]


def classic_head(dims: dict[str, int], variables: dict[str, tuple[Sequence[str], np.ndarray | np.dtype, dict]], attributes: dict | None = None) -> bytes:
    """Header of a classic file (64-bit offsets) of fixed dimensions, with the bodies of all variables but a last one that is given as a type."""
    names = list(dims)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def attribute(key: str, value) -> bytes:
        if isinstance(value, str):
            return text(key) + struct.pack(">ii", 2, len(value.encode())) + pad(value.encode())
        return text(key) + struct.pack(">iid", 6, 1, float(value))

    def listed(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if parts else 0, len(parts)) + b"".join(parts)

    def attribute_list(held: dict) -> bytes:
        return listed(_ATTRIBUTE, [attribute(k, v) for k, v in held.items()])

    heads, bodies = [], []
    for name, (over, array, held) in variables.items():
        shape = tuple(dims[d] for d in over)
        kind = array.str[1:] if isinstance(array, np.dtype) else np.asarray(array).dtype.str[1:]
        if kind not in _CODES or (not isinstance(array, np.dtype) and np.shape(array) != shape):
            raise ValueError(f"variable {name}: type {kind} or shape {np.shape(array)} does not fit")
        body = b"" if isinstance(array, np.dtype) else pad(np.asarray(array).astype(f">{kind}").tobytes())
        size = -(-int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize // 4) * 4
        heads.append(text(name) + struct.pack(f">i{len(over)}i", len(over), *[names.index(d) for d in over]) + attribute_list(held) + struct.pack(">iI", _CODES[kind], min(size, (1 << 32) - 1)))
        bodies.append(body)
    start = b"CDF\x02" + struct.pack(">i", 0) + listed(_DIMENSION, [text(n) + struct.pack(">i", k) for n, k in dims.items()]) + attribute_list(attributes or {})
    at = len(start) + 8 + sum(len(h) + 8 for h in heads)
    out = [start + struct.pack(">ii", _VARIABLE if heads else 0, len(heads))]
    for head, body in zip(heads, bodies, strict=True):
        out.append(head + struct.pack(">q", at))
        at += len(body)
    return b"".join(out + bodies)


def write_grid_nc(path: str, dims: dict[str, int], variables: dict[str, tuple[Sequence[str], np.ndarray, dict[str, str]]], attributes: dict[str, str] | None = None) -> None:
    """A classic file of arrays that are at hand; attributes are strings or numbers."""
    with open(path, "wb") as out:
        out.write(classic_head(dims, {n: (over, np.asarray(a), held) for n, (over, a, held) in variables.items()}, attributes))


SCHEMA = "day date, year int, month int, iy int, ix int, lat double, lon double, value double"
_ARROW = pa.schema([("day", pa.date32()), ("year", pa.int32()), ("month", pa.int32()), ("iy", pa.int32()), ("ix", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())])


def _plan(f: GridFile | Hdf5Grid, name: str | None, preferred: Sequence[str]):
    time, lat, lon = (resolve_coordinate(list(f.variables), c) for c in (TIME_NAMES, LAT_NAMES, LON_NAMES))
    dims = {n: v[0] for n, v in f.variables.items()}
    value = resolve_variable(dims, (time, lat, lon), preferred, name)
    return time, lat, lon, value, dims[value]


def _rows(f: GridFile | Hdf5Grid, name: str | None, preferred: Sequence[str], steps: Iterable[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of one step each, on ascending axes; the variable's first dimension is time."""
    time, lat, lon, value, dims = _plan(f, name, preferred)
    if dims[0] != time:
        raise ValueError(f"{value} does not start with {time}")
    days = days_of(f.read(time), f.variables[time][3].get("units", ""))
    y, x = f.read(lat).astype(float), f.read(lon).astype(float)
    oy, ox = np.argsort(y, kind="stable"), np.argsort(x, kind="stable")
    iy, ix = np.repeat(np.arange(len(y)), len(x)).astype(np.int32), np.tile(np.arange(len(x)), len(y)).astype(np.int32)
    together, begin, held = f.chunk_shape(value)[0], -1, None
    for t in range(len(days)) if steps is None else steps:
        if held is None or not begin <= t < begin + together:
            begin = t - t % together  # a chunk of several steps is inflated once
            held = f.read(value, begin, begin + together)
        plane = held[t - begin].astype(float)
        plane = (plane if dims[1] == lat else plane.T)[np.ix_(oy, ox)].ravel()
        same = lambda v, t: pa.array(np.full(len(plane), v), t)  # noqa: B023, E731
        flat = [pa.array([days[t]] * len(plane), pa.date32()), same(days[t].year, pa.int32()), same(days[t].month, pa.int32()), pa.array(iy), pa.array(ix), pa.array(y[oy][iy]), pa.array(x[ox][ix])]
        yield pa.RecordBatch.from_arrays([*flat, pa.array(plane, mask=~np.isfinite(plane))], schema=_ARROW)


STEPS = ("month", "year")
LAYERS = "feature string, step int, iy int, ix int, lat double, lon double, value double"
_LAYERS = pa.schema([("feature", pa.string()), ("step", pa.int32()), ("iy", pa.int32()), ("ix", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())])


def _layers(f: GridFile | Hdf5Grid, names: Sequence[str] | None, exclude: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each plane of the variables over (lat, lon), alone or with a month or year first or last, on ascending axes."""
    lat, lon = (resolve_coordinate(list(f.variables), c) for c in (LAT_NAMES, LON_NAMES))
    y, x = f.read(lat).astype(float), f.read(lon).astype(float)
    oy, ox = np.argsort(y, kind="stable"), np.argsort(x, kind="stable")
    iy, ix = np.repeat(np.arange(len(y)), len(x)).astype(np.int32), np.tile(np.arange(len(x)), len(y)).astype(np.int32)
    for name, (dims, _, _, _) in f.variables.items():
        step = next((d for d in dims if d in STEPS), None)
        if name in exclude or (names is not None and name not in names) or set(dims) != {lat, lon} | ({step} - {None}):
            continue
        steps = [None] if step is None else (f.read(step).tolist() if step in f.variables else range(1, dict(f.dims)[step] + 1))
        cube = np.transpose(f.read(name).astype(float), [dims.index(d) for d in ([step] if step else []) + [lat, lon]]).reshape(len(steps), len(y), len(x))
        for at, plane in zip(steps, cube, strict=True):
            flat = plane[np.ix_(oy, ox)].ravel()
            rest = [pa.array([name] * len(flat)), pa.array([None if at is None else int(at)] * len(flat), pa.int32()), pa.array(iy), pa.array(ix), pa.array(y[oy][iy]), pa.array(x[ox][ix])]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(flat, mask=~np.isfinite(flat))], schema=_LAYERS)


def read_layers_nc(spark: SparkSession, path: str, names: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(feature, step, iy, ix, lat, lon, value) of the planes in the files at ``path``: masks, month cubes, static and yearly predictors.

    step is the month or year of a plane, null where the variable has neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _layers(open_grid(content.as_py()), names, exclude)

    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, LAYERS)


def read_grid_nc(spark: SparkSession, path: str, variable: str | None = None, preferred: Sequence[str] = ()) -> DataFrame:
    """(day, year, month, iy, ix, lat, lon, value) of the files at ``path`` (a glob too), through Spark's readers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _rows(open_grid(content.as_py()), variable, preferred)

    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


class GridSource(DataSource):
    """``spark.read.format("grid_nc").option("variable", ...).option("step_chunk", 30).load(path)``; a path may be a folder or a pattern."""

    @classmethod
    def name(cls) -> str:
        return "grid_nc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return GridWriter(self.options, overwrite)


def _local(path: str) -> str:
    """A path in a folder that driver and executors have mounted."""
    if re.match(r"[a-z][a-z0-9+.-]*://", path) and not path.startswith("file://"):
        raise ValueError(f"{path} is not in a mounted folder; read_grid_nc reads it through Spark")
    return re.sub(r"^file:(//)?", "", path)


def _test(f: Filter):
    """(column, predicate) of a filter on the time of a slice; None for any other."""
    if not isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull)) or f.attribute not in (("day",), ("year",), ("month",)):
        return None
    match f:
        case IsNotNull():
            return f.attribute[0], lambda x: True
        case In():
            return f.attribute[0], lambda x: x in f.value
        case EqualTo() | EqualNullSafe():
            return f.attribute[0], lambda x: x == f.value
        case GreaterThan():
            return f.attribute[0], lambda x: f.value is not None and x > f.value
        case GreaterThanOrEqual():
            return f.attribute[0], lambda x: f.value is not None and x >= f.value
        case LessThan():
            return f.attribute[0], lambda x: f.value is not None and x < f.value
    return f.attribute[0], lambda x: f.value is not None and x <= f.value


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable, self.chunk = _local(options["path"]), options.get("variable"), int(options.get("step_chunk", 30))
        self.preferred = [p for p in options.get("preferred", "").split(",") if p]
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Predicates on time are dealt with here, whole; the others go back to Spark."""
        for f in filters:
            if (test := _test(f)) is not None:
                self.tests.append(test)
            else:
                yield f

    def _files(self) -> list[str]:
        found = sorted(glob.glob(os.path.join(self.path, "*.nc")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not found:
            raise FileNotFoundError(f"no file at {self.path}")
        return found

    def partitions(self) -> list[InputPartition]:
        """(file, steps) of up to ``step_chunk`` steps, rounded up to whole chunks of the file; only steps that pass the predicates."""
        out = []
        for path in self._files():
            f = open_grid(np.memmap(path, np.uint8, "r"))
            time, _, _, value, _ = _plan(f, self.variable, self.preferred)
            days = days_of(f.read(time), f.variables[time][3].get("units", ""))
            of = {"day": lambda d: d, "year": lambda d: d.year, "month": lambda d: d.month}
            wanted = [t for t, d in enumerate(days) if all(test(of[c](d)) for c, test in self.tests)]
            together = f.chunk_shape(value)[0]
            each = -(-self.chunk // together) * together
            runs: dict[int, list[int]] = {}
            for t in wanted:
                runs.setdefault(t // each, []).append(t)
            out += [InputPartition((path, steps)) for steps in runs.values()]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            path, steps = partition.value
            yield from _rows(open_grid(np.memmap(path, np.uint8, "r")), self.variable, self.preferred, steps)


@dataclass
class PartWritten(WriterCommitMessage):
    """Blocks of days that a task has written: block number -> staged file, or None for a place in the one file."""

    parts: dict[int, str | None]


EPOCH = datetime.date(1970, 1, 1)


class GridWriter(DataSourceArrowWriter):
    """Rows (block, day, iy, ix, value) of whole blocks of days, sorted; see ``write_field_nc``.

    ``netcdf4``: a file per block, deflated; staged under a name of the attempt's own and
    renamed by the commit. ``classic``: one file in which the axes fix every plane's
    place, so that each attempt of a task writes the same bytes to the same places; the
    commit writes the header and gives it its name. Nothing but names reaches the driver.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = _local(options["path"]), overwrite, options["run"]
        self.layout, self.variable, self.chunk = options.get("layout", "netcdf4"), options["variable"], int(options["step_chunk"])
        self.lat, self.lon = np.array(json.loads(options["lat"])), np.array(json.loads(options["lon"]))
        self.days = np.array(json.loads(options["days"]), np.int64)
        self.attributes = json.loads(options.get("attributes", "{}"))
        self.staged = f"{self.path}.staged-{self.run}"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"{self.path} is there already")
        self.head, self.plane = b"", 4 * len(self.lat) * len(self.lon)
        if self.layout == "classic":
            self.head = self._classic_head()
        elif self.layout != "netcdf4":
            raise ValueError(f"unknown layout {self.layout!r}")

    def _axes(self, days: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, dict]]:
        held = {"time": {"units": f"days since {EPOCH}", "calendar": "proleptic_gregorian"}, "lat": {"long_name": "latitude", "units": "degrees_north"}, "lon": {"long_name": "longitude", "units": "degrees_east"}}
        return {"time": days.astype(np.float64), "lat": self.lat, "lon": self.lon}, held

    def _classic_head(self) -> bytes:
        axes, held = self._axes(self.days)
        dims = {n: len(v) for n, v in axes.items()}
        return classic_head(dims, {**{n: ((n,), v, held[n]) for n, v in axes.items()}, self.variable: (tuple(dims), np.dtype("f4"), {"_FillValue": float("nan")})}, self.attributes)

    def _planes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(block, step, plane) of every step of the blocks that come, days without rows included."""
        ny, nx = len(self.lat), len(self.lon)
        block, step, plane = None, 0, None
        empty = lambda: np.full((ny, nx), np.nan, np.float32)

        def rest(until: int) -> Iterator[tuple[int, int, np.ndarray]]:
            nonlocal step, plane
            while step < until:
                yield block, step, plane if plane is not None else empty()
                step, plane = step + 1, None

        for batch in batches:
            at = np.searchsorted(self.days, batch.column(1).cast(pa.int32()).to_numpy())
            blocks, iy, ix = (batch.column(k).to_numpy() for k in (0, 2, 3))
            values = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float32)
            for a in np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else ():
                end = a + int(np.searchsorted(at[a:], at[a], "right"))
                if block != int(blocks[a]):
                    if block is not None:
                        yield from rest(min((block + 1) * self.chunk, len(self.days)))
                    block, plane = int(blocks[a]), None
                    step = block * self.chunk
                yield from rest(int(at[a]))
                plane = empty() if plane is None else plane
                plane[iy[a:end], ix[a:end]] = values[a:end]
        if block is not None:
            yield from rest(min((block + 1) * self.chunk, len(self.days)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        parts: dict[int, str | None] = {}
        if self.layout == "classic":
            os.makedirs(os.path.dirname(self.staged) or ".", exist_ok=True)
            at = os.open(self.staged, os.O_CREAT | os.O_WRONLY)
            try:
                for block, step, plane in self._planes(batches):
                    os.pwrite(at, plane.astype(">f4").tobytes(), len(self.head) + step * self.plane)
                    parts[block] = None
            finally:
                os.close(at)
            return PartWritten(parts)
        os.makedirs(self.staged, exist_ok=True)
        for block, planes in itertools.groupby(self._planes(batches), lambda x: x[0]):
            name = f"{self.staged}/{block:06d}-{uuid.uuid4().hex}"
            axes, held = self._axes(self.days[block * self.chunk : (block + 1) * self.chunk])
            write_hdf5_grid(name, axes, {self.variable: (tuple(axes), "f4", {"_FillValue": float("nan")}, lambda k, planes=planes: next(planes)[2])}, self.attributes, held)
            parts[block] = name
        return PartWritten(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = {k: v for m in messages if m is not None for k, v in m.parts.items()}
        old = f"{self.path}.old-{self.run}"
        if self.layout == "classic":
            at = os.open(self.staged, os.O_CREAT | os.O_WRONLY)
            os.pwrite(at, self.head, 0)
            nothing = np.full((len(self.lat), len(self.lon)), np.nan, ">f4").tobytes()
            for step in range(len(self.days)):
                if step // self.chunk not in parts:
                    os.pwrite(at, nothing, len(self.head) + step * self.plane)
            os.close(at)
        else:
            os.makedirs(self.staged, exist_ok=True)
            for block, name in parts.items():
                os.replace(name, f"{self.staged}/part-{block:06d}.nc")
            for left in glob.glob(f"{self.staged}/*-*"):
                if not left.endswith(".nc"):
                    os.unlink(left)  # of attempts that did not count
        if os.path.exists(self.path):
            os.replace(self.path, old)
        os.replace(self.staged, self.path)
        if os.path.isdir(old):
            shutil.rmtree(old)
        elif os.path.exists(old):
            os.unlink(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.isdir(self.staged):
            shutil.rmtree(self.staged, ignore_errors=True)
        elif os.path.exists(self.staged):
            os.unlink(self.staged)


def write_field_nc(field: DataFrame, path: str, lat: Sequence[float], lon: Sequence[float], variable: str, layout: str = "netcdf4", step_chunk: int = 30, days: Sequence[datetime.date] | None = None, attributes: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """A daily field (day, iy, ix, value) as NetCDF in a mounted folder: float32, missing values NaN.

    ``netcdf4`` makes a folder of deflated files of ``step_chunk`` days, ``classic`` one
    file. Days are those of the field (one date a day goes to the driver) or ``days``.
    A block of days is one task's work, which holds one plane; the file appears under its
    name only when all are there, and the same field gives the same bytes however often
    tasks were repeated. Rows outside the axes, or without a day, are an error or ignored.
    """
    spark = field.sparkSession
    register(spark)
    there = sorted(r[0] for r in field.select("day").distinct().filter("day IS NOT NULL").collect()) if days is None else sorted(days)
    numbers = [(d - EPOCH).days for d in there]
    steps = spark.createDataFrame([(d, k // step_chunk) for k, d in enumerate(there)], "day date, block int")
    rows = field.select("day", "iy", "ix", F.col("value").cast("double").alias("value")).join(F.broadcast(steps), "day").select("block", "day", "iy", "ix", "value")
    blocks = -(-len(there) // step_chunk)
    rows = rows.repartitionByRange(max(1, blocks), "block").sortWithinPartitions("block", "day", "iy", "ix")
    held = {"run": uuid.uuid4().hex, "layout": layout, "variable": variable, "step_chunk": str(step_chunk), "lat": json.dumps(list(map(float, lat))), "lon": json.dumps(list(map(float, lon))), "days": json.dumps(numbers), "attributes": json.dumps(attributes or {})}
    rows.write.format("grid_nc").options(**held).mode("overwrite" if overwrite else "append").save(path)


def register(spark: SparkSession) -> None:
    """Makes ``grid_nc`` known to the session, and lets Spark hand it predicates."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
