"""Grids in HDF5 files as NetCDF-4 lays them out: metadata and chunks, with the standard library's zlib.

``Hdf5Grid`` has the same face as ``grid_nc.GridFile``. It reads what gridded files use:
superblocks 0 to 3, both kinds of object headers and of groups, links and attributes in
headers or in fractal heaps, whole numbers, floats and strings, contiguous, compact and
chunked layouts (version 3 with its B-tree; of version 4 the single chunk), and the
filters deflate, shuffle and Fletcher-32. Anything else is an error that says what.

``write_hdf5_grid`` writes a file of its own: fixed dimensions as dimension scales and
variables in deflated, shuffled chunks, one slice at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import numpy as np

MAGIC = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
#: Children of a node of a chunk index are at most twice this; the format's default.
INDEX_K = 32


class Hdf5Grid:
    def __init__(self, data: bytes | np.memmap):
        self.data = data
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not an HDF5 file")
        version = int(data[8])
        if version in (0, 1):
            if data[13] != 8 or data[14] != 8:
                raise ValueError("only files with 8-byte addresses are read")
            root = self._int(24 + 4 * (version == 1) + 32 + 8)
        elif version in (2, 3):
            root = self._int(36)
        else:
            raise ValueError(f"superblock version {version} is not known")
        self.root = self._messages(root)
        self.places = {}
        self.objects: dict[str, list[tuple[int, bytes]]] = {}
        for name, at in self._links(self.root):
            self.places[at], self.objects[name] = name, self._messages(at)
        self.attributes = self._attributes(self.root)
        found = {name: self._variable(m) for name, m in self.objects.items() if any(k == 0x08 for k, _ in m)}
        self._layouts = {name: v for name, v in found.items()}
        sizes: dict[str, int] = {}
        self.variables: dict[str, tuple[tuple[str, ...], str, int, dict]] = {}
        for name, v in found.items():
            dims = self._dims(name, v)
            sizes |= dict(zip(dims, v["shape"], strict=True))
            self.variables[name] = (dims, v["type"].str if v["type"] is not None else "S1", 0, v["attributes"])
        # a dimension without values is a scale without being a variable
        for name, v in found.items():
            if str(v["attributes"].get("NAME", "")).startswith("This is a netCDF dimension but not a netCDF variable"):
                self.variables.pop(name)
        self.dims = list(sizes.items())

    def _int(self, at: int, n: int = 8) -> int:
        return int.from_bytes(bytes(self.data[at : at + n]), "little")

    def _messages(self, at: int) -> list[tuple[int, bytes]]:
        """(type, body) of an object header's messages."""
        out: list[tuple[int, bytes]] = []
        if bytes(self.data[at : at + 4]) == b"OHDR":
            flags = int(self.data[at + 5])
            start = at + 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            blocks = [(start + width, self._int(start, width))]
            head = 6 if flags & 0x04 else 4
            for begin, size in blocks:
                p, end = begin, begin + size
                while p + head <= end:
                    kind, n = int(self.data[p]), self._int(p + 1, 2)
                    body = bytes(self.data[p + head : p + head + n])
                    if kind == 0x10:
                        where, length = struct.unpack("<QQ", body[:16])
                        blocks.append((where + 4, length - 8))  # without signature and checksum
                    elif kind:
                        out.append((kind, self._shared(int(self.data[p + 3]), kind, body)))
                    p += head + n
            return out
        if self.data[at] != 1:
            raise ValueError("damaged object header")
        blocks = [(at + 16, self._int(at + 8, 4))]
        for begin, size in blocks:
            p = begin
            while p + 8 <= begin + size:
                kind, n = self._int(p, 2), self._int(p + 2, 2)
                body = bytes(self.data[p + 8 : p + 8 + n])
                if kind == 0x10:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                elif kind:
                    out.append((kind, self._shared(int(self.data[p + 4]), kind, body)))
                p += 8 + n
        return out

    def _shared(self, flags: int, kind: int, body: bytes) -> bytes:
        """A message that lies in another object's header (a named type) instead of here."""
        if not flags & 2 or kind == 0x0C:
            return body
        at = struct.unpack_from("<Q", body, 8 if body[0] == 1 else 2)[0]
        return next(b for k, b in self._messages(at) if k == kind)

    def _links(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        for kind, body in messages:
            if kind == 0x06:
                if (link := self._link(body)) is not None:
                    yield link
            elif kind == 0x02:
                p = 2 + 8 * (body[1] & 1)
                heap, index = struct.unpack_from("<QQ", body, p)
                if heap != UNDEFINED:
                    for entry in self._heap_objects(heap, index, 4):
                        if (link := self._link(entry)) is not None:
                            yield link
            elif kind == 0x11:
                tree, heap = struct.unpack_from("<QQ", body)
                names = self._int(heap + 24)
                yield from self._symbols(tree, names)

    def _link(self, body: bytes) -> tuple[str, int] | None:
        flags, p, kind = body[1], 2, 0
        if flags & 0x08:
            kind, p = body[p], p + 1
        p += 8 * bool(flags & 0x04) + bool(flags & 0x10)
        width = 1 << (flags & 3)
        n, p = int.from_bytes(body[p : p + width], "little"), p + width
        name = body[p : p + n].decode()
        return (name, struct.unpack_from("<Q", body, p + n)[0]) if kind == 0 else None

    def _symbols(self, at: int, names: int) -> Iterator[tuple[str, int]]:
        if bytes(self.data[at : at + 4]) == b"TREE":
            for k in range(self._int(at + 6, 2)):
                yield from self._symbols(self._int(at + 24 + 8 + 16 * k), names)
            return
        for k in range(self._int(at + 6, 2)):
            entry = at + 8 + 40 * k
            start = names + self._int(entry)
            yield bytes(self.data[start : start + 4096]).split(b"\0", 1)[0].decode(), self._int(entry + 8)

    # fractal heaps and the B-trees (version 2) that list their objects

    def _heap_objects(self, heap: int, index: int, skip: int) -> Iterator[bytes]:
        """The objects of a heap in the order of its index, whose records begin with ``skip`` bytes or, for attributes, the id."""
        length = self._int(heap + 5, 2)
        if self._int(heap + 7, 2):
            raise ValueError("filtered heaps are not read")
        width, first, most, bits, root, now = (self._int(heap + o, n) for o, n in ((110, 2), (112, 8), (120, 8), (128, 2), (132, 8), (140, 2)))
        offset_bytes = -(-bits // 8)
        length_bytes = min(-(-(most.bit_length()) // 8), -(-(self._int(heap + 10, 4).bit_length()) // 8))

        def block_of(offset: int) -> tuple[int, int]:
            """(address, first offset) of the direct block that holds an offset; offsets count the blocks' heads."""
            if now == 0:
                return root, 0
            return inside(root, now, 0, offset)

        def inside(at: int, count: int, begin: int, offset: int) -> tuple[int, int]:
            direct = max(0, (most.bit_length() - first.bit_length()) + 2)
            p, here = at + 5 + 8 + offset_bytes, begin
            for row in range(count):
                size = first << max(0, row - 1)
                for _ in range(width):
                    if here <= offset < here + size:
                        child = self._int(p)
                        if row < direct:
                            return child, here
                        return inside(child, (size // (first * width)).bit_length(), here, offset)
                    here, p = here + size, p + 8
            raise ValueError("damaged heap")

        for record in self._records(index):
            key = record[skip : skip + length]
            if key[0] >> 4:
                raise ValueError("huge and tiny heap objects are not read")
            offset = int.from_bytes(key[1 : 1 + offset_bytes], "little")
            size = int.from_bytes(key[1 + offset_bytes : 1 + offset_bytes + length_bytes], "little")
            at, begin = block_of(offset)
            yield bytes(self.data[at + offset - begin : at + offset - begin + size])

    def _records(self, at: int) -> Iterator[bytes]:
        node, size, depth = self._int(at + 6, 4), self._int(at + 10, 2), self._int(at + 12, 2)
        root, n = self._int(at + 16), self._int(at + 24, 2)
        most = [(node - 10) // size]  # records of a node of each level, and of all below it
        whole, count_bytes = [most[0]], lambda x: -(-max(1, x.bit_length()) // 8)
        for level in range(1, depth + 1):
            pointer = 8 + count_bytes(most[0]) + (count_bytes(whole[level - 1]) if level > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            whole.append((most[level] + 1) * whole[level - 1] + most[level])

        def walk(at: int, n: int, level: int) -> Iterator[bytes]:
            held = [bytes(self.data[at + 6 + size * k : at + 6 + size * (k + 1)]) for k in range(n)]
            if level == 0:
                yield from held
                return
            p, own, all_below = at + 6 + size * n, count_bytes(most[0]), count_bytes(whole[level - 1]) if level > 1 else 0
            for k in range(n + 1):
                yield from walk(self._int(p), self._int(p + 8, own), level - 1)
                p += 8 + own + all_below
                if k < n:
                    yield held[k]

        if root != UNDEFINED:
            yield from walk(root, n, depth)

    # attributes, types and variables

    def _attributes(self, messages: list[tuple[int, bytes]]) -> dict:
        out = {}
        for kind, body in messages:
            if kind == 0x0C:
                out |= self._attribute(body)
            elif kind == 0x15:
                heap, index = struct.unpack_from("<QQ", body, 2 + 2 * (body[1] & 1))
                if heap != UNDEFINED:
                    for entry in self._heap_objects(heap, index, 0):
                        out |= self._attribute(entry)
        return out

    def _attribute(self, body: bytes) -> dict:
        version = body[0]
        n_name, n_type, n_space = struct.unpack_from("<HHH", body, 2)
        p = 9 if version == 3 else 8
        grown = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name, p = body[p : p + n_name].split(b"\0", 1)[0].decode(), p + grown(n_name)
        kind, p = body[p : p + n_type], p + grown(n_type)
        shape, p = self._space(body[p : p + n_space]), p + grown(n_space)
        if version > 1 and body[1] & 1:
            return {}  # of a named type
        count = int(np.prod(shape, dtype=np.int64))
        raw = body[p:]
        if kind[0] & 15 == 9:
            parts = [self._global(*struct.unpack_from("<IQI", raw, 16 * k)) for k in range(count)]
            return {name: parts[0].split(b"\0", 1)[0].decode(errors="replace") if kind[1] & 15 == 1 and count else parts}
        if kind[0] & 15 == 3:
            return {name: raw[: self._width(kind)].split(b"\0", 1)[0].decode(errors="replace")}
        form = self._type(kind)
        return {name: np.frombuffer(raw, form, count).tolist()} if form is not None else {}

    def _global(self, n: int, heap: int, index: int) -> bytes:
        """An object of a global heap."""
        p, end = heap + 16, heap + self._int(heap + 8)
        while p < end and (number := self._int(p, 2)):
            size = self._int(p + 8)
            if number == index:
                return bytes(self.data[p + 16 : p + 16 + size])
            p += 16 + -(-size // 8) * 8
        return b""

    @staticmethod
    def _width(kind: bytes) -> int:
        return struct.unpack_from("<I", kind, 4)[0]

    def _type(self, kind: bytes) -> np.dtype | None:
        order, width = ">" if kind[1] & 1 else "<", self._width(kind)
        match kind[0] & 15:
            case 0 if width in (1, 2, 4, 8):
                return np.dtype(f"{order}{'i' if kind[1] & 8 else 'u'}{width}")
            case 1 if width in (2, 4, 8):
                return np.dtype(f"{order}f{width}")
            case 3:
                return np.dtype(f"S{width}")
        return None

    @staticmethod
    def _space(body: bytes) -> tuple[int, ...]:
        rank = body[1]
        return struct.unpack_from(f"<{rank}Q", body, 8 if body[0] == 1 else 4)

    def _variable(self, messages: list[tuple[int, bytes]]) -> dict:
        out = {"attributes": self._attributes(messages), "filters": [], "type": None, "fill": None, "shape": ()}
        for kind, body in messages:
            match kind:
                case 0x01:
                    out["shape"] = self._space(body)
                case 0x03:
                    out["type"] = self._type(body)
                case 0x0B:
                    out["filters"] = self._filters(body)
                case 0x08:
                    out["layout"] = body
                case 0x05:
                    out["fill"] = body
        if out["fill"] is not None and out["type"] is not None:
            body, p = out["fill"], None
            if body[0] < 3 and (body[0] == 1 or body[3]):
                p = 4
            elif body[0] == 3 and body[1] & 0x20:
                p = 2
            size = struct.unpack_from("<I", body, p)[0] if p else 0
            out["fill"] = np.frombuffer(body, out["type"], 1, p + 4)[0] if size == out["type"].itemsize else None
        else:
            out["fill"] = None
        return out

    @staticmethod
    def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        version, n, out = body[0], body[1], []
        p = 8 if version == 1 else 2
        for _ in range(n):
            number = struct.unpack_from("<H", body, p)[0]
            p += 2
            n_name = 0
            if version == 1 or number >= 256:
                n_name, p = struct.unpack_from("<H", body, p)[0], p + 2
            _, count = struct.unpack_from("<HH", body, p)
            p += 4 + (-(-n_name // 8) * 8 if version == 1 else n_name)
            out.append((number, struct.unpack_from(f"<{count}I", body, p)))
            p += 4 * count + 4 * (version == 1 and count % 2)
        return out

    def _dims(self, name: str, v: dict) -> tuple[str, ...]:
        listed = v["attributes"].get("DIMENSION_LIST")
        if listed and len(listed) == len(v["shape"]) and all(len(x) >= 8 for x in listed):
            at = [struct.unpack_from("<Q", x)[0] for x in listed]
            if all(a in self.places for a in at):
                return tuple(self.places[a] for a in at)
        if len(v["shape"]) == 1 and v["attributes"].get("CLASS") == "DIMENSION_SCALE":
            return (name,)
        return tuple(f"{name}_{k}" for k in range(len(v["shape"])))

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self._layouts[name]["shape"])

    def chunk_shape(self, name: str) -> tuple[int, ...]:
        """A chunk's extents; the whole shape where there are no chunks."""
        v = self._layouts[name]
        body, rank = v["layout"], len(v["shape"])
        if body[0] == 3 and body[1] == 2:
            return struct.unpack_from(f"<{rank}I", body, 11)
        if body[0] == 4 and body[1] == 2:
            width = body[4]
            return tuple(int.from_bytes(body[5 + width * k : 5 + width * (k + 1)], "little") for k in range(rank))
        return tuple(v["shape"])

    def chunks(self, name: str, first: int = 0, last: int | None = None) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, stored bytes, filters left out) of the chunks that hold slices first..last - 1."""
        v = self._layouts[name]
        body, rank, size = v["layout"], len(v["shape"]), self.chunk_shape(name)
        last = v["shape"][0] if last is None else last
        if body[0] == 4:
            flags, p = body[2], 5 + body[4] * (rank + 1)
            if body[p] != 1:
                raise ValueError(f"chunk index type {body[p]} is not read; repack the file with an earlier format (nccopy, h5repack)")
            plain = int(np.prod(size, dtype=np.int64)) * v["type"].itemsize
            stored, mask, p = (*struct.unpack_from("<QI", body, p + 1), p + 13) if flags & 2 else (plain, 0, p + 1)
            at = struct.unpack_from("<Q", body, p)[0]
            if at != UNDEFINED:
                yield (0,) * rank, at, stored, mask
            return
        root = struct.unpack_from("<Q", body, 3)[0]
        step = 8 + 8 * (rank + 1)

        def walk(at: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
            level, n = int(self.data[at + 5]), self._int(at + 6, 2)
            for k in range(n):
                p = at + 24 + (step + 8) * k
                begin, following = self._int(p + 8), self._int(p + step + 8 + 8)  # first offset of this key and of the next
                if begin >= last or (level and k + 1 < n and following + size[0] <= first) or (not level and begin + size[0] <= first):
                    continue
                child = self._int(p + step)
                if level:
                    yield from walk(child)
                else:
                    stored, mask = struct.unpack("<II", bytes(self.data[p : p + 8]))
                    yield tuple(self._int(p + 8 + 8 * j) for j in range(rank)), child, stored, mask

        if root != UNDEFINED:
            yield from walk(root)

    def _unpacked(self, v: dict, at: int, stored: int, mask: int) -> bytes:
        raw = bytes(self.data[at : at + stored])
        for k in range(len(v["filters"]) - 1, -1, -1):
            if mask >> k & 1:
                continue
            number, values = v["filters"][k]
            if number == 1:
                raw = zlib.decompress(raw)
            elif number == 2:
                width = values[0] if values else v["type"].itemsize
                n = len(raw) // width
                raw = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T.tobytes() + raw[n * width :]
            elif number == 3:
                raw = raw[:-4]
            else:
                raise ValueError(f"filter {number} is not read")
        return raw

    def read(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """The variable, or its slices first..last - 1 along its first dimension; fill values become NaN in float fields."""
        v = self._layouts[name]
        shape, kind, body = v["shape"], v["type"], v["layout"]
        if kind is None:
            raise ValueError(f"the type of {name} is not read")
        count = int(np.prod(shape, dtype=np.int64))
        chunked = (body[0] == 3 and body[1] == 2) or (body[0] == 4 and body[1] == 2)
        if not chunked:
            if body[0] not in (3, 4):
                raise ValueError(f"layout version {body[0]} is not read")
            if body[1] == 0:
                out = np.frombuffer(body, kind, count, 4).reshape(shape)
            else:
                at = struct.unpack_from("<Q", body, 2)[0]
                each = count // max(1, shape[0]) if shape else 1
                a, b = (0, 1) if not shape else (first, min(shape[0], shape[0] if last is None else last))
                if at == UNDEFINED:
                    out = np.full((b - a) * each, 0 if v["fill"] is None else v["fill"], kind)
                else:
                    out = np.frombuffer(bytes(self.data[at + a * each * kind.itemsize : at + b * each * kind.itemsize]), kind)
                out = out.reshape(b - a, *shape[1:]) if shape else out[0]
                first, last = 0, None
            if shape and body[1] == 0:
                out = out[first:last]
        else:
            size = self.chunk_shape(name)
            last = shape[0] if last is None else min(last, shape[0])
            out = np.full((last - first, *shape[1:]), 0 if v["fill"] is None else v["fill"], kind)
            for offsets, at, stored, mask in self.chunks(name, first, last):
                part = np.frombuffer(self._unpacked(v, at, stored, mask), kind, int(np.prod(size, dtype=np.int64))).reshape(size)
                low = max(offsets[0], first)
                high = min(offsets[0] + size[0], last)
                inner = tuple(slice(o, min(o + s, n)) for o, s, n in zip(offsets[1:], size[1:], shape[1:], strict=True))
                if low < high and all(x.start < x.stop for x in inner):
                    out[(slice(low - first, high - first), *inner)] = part[(slice(low - offsets[0], high - offsets[0]), *(slice(0, x.stop - x.start) for x in inner))]
        if kind.kind == "f":
            out = np.array(out, kind.newbyteorder("="))
            for key in ("_FillValue", "missing_value"):
                if isinstance(held := v["attributes"].get(key), list) and held:
                    out[out == np.float64(held[0]).astype(out.dtype)] = np.nan
        return out


def lookup3(data: bytes) -> int:
    """The checksum of HDF5's metadata: the public hash lookup3 with initial value 0."""
    m, n = 0xFFFFFFFF, len(data)
    a = b = c = (0xDEADBEEF + n) & m
    rot = lambda x, k: ((x << k) | (x >> (32 - k))) & m
    p = 0
    while n - p > 12:
        x, y, z = struct.unpack_from("<III", data, p)
        a, b, c = (a + x) & m, (b + y) & m, (c + z) & m
        for k, (i, j) in zip((4, 6, 8, 16, 19, 4), ((0, 2), (1, 0), (2, 1)) * 2, strict=True):
            v = [a, b, c]
            v[i] = ((v[i] - v[j]) & m) ^ rot(v[j], k)
            v[j] = (v[j] + v[3 - i - j]) & m
            a, b, c = v
        p += 12
    if n - p:
        x, y, z = struct.unpack("<III", data[p:].ljust(12, b"\0"))
        a, b, c = (a + x) & m, (b + y) & m, (c + z) & m
        for k, (i, j) in zip((14, 11, 25, 16, 4, 14, 24), ((2, 1), (0, 2), (1, 0), (2, 1), (0, 2), (1, 0), (2, 1)), strict=True):
            v = [a, b, c]
            v[i] = ((v[i] ^ v[j]) - rot(v[j], k)) & m
            a, b, c = v
    return c


def _type_message(kind: np.dtype) -> bytes:
    width = kind.itemsize
    if kind.kind == "f":
        sign, exponent, mantissa, bias = {4: (31, 8, 23, 127), 8: (63, 11, 52, 1023)}[width]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, width, 0, 8 * width, mantissa, exponent, 0, mantissa, bias)
    if kind.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 * (kind.kind == "i"), 0, 0, width, 0, 8 * width)
    return struct.pack("<BBBBI", 0x13, 0, 0, 0, width)


def _space_message(shape: Sequence[int]) -> bytes:
    return struct.pack(f"<BBBB{len(shape)}Q", 2, len(shape), 0, 1 if shape else 0, *shape)


def _attribute_message(name: str, kind: bytes, space: bytes, raw: bytes) -> bytes:
    label = name.encode() + b"\0"
    return struct.pack("<BBHHHB", 3, 0, len(label), len(kind), len(space), 0) + label + kind + space + raw


def _plain_attribute(name: str, value) -> bytes:
    if isinstance(value, str):
        raw = value.encode() or b"\0"
        return _attribute_message(name, _type_message(np.dtype(f"S{len(raw)}")), _space_message(()), raw)
    value = np.asarray(value)
    value = value.astype(value.dtype.newbyteorder("<")).reshape(-1)
    return _attribute_message(name, _type_message(value.dtype), _space_message(value.shape), value.tobytes())


def _header(messages: Sequence[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<BHB", kind, len(raw), 0) + raw for kind, raw in messages)
    head = b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body
    return head + struct.pack("<I", lookup3(head))


def _chunk_index(out: BinaryIO, rank: int, entries: list[tuple[tuple[int, ...], int, int]], shape: Sequence[int], item: int) -> int:
    """Writes the nodes of a version 1 B-tree over (offsets, address, bytes), and returns its root's address."""
    end = struct.pack(f"<II{rank + 1}Q", 0, 0, *shape, item)
    level, nodes = 0, [(struct.pack(f"<II{rank + 1}Q", n, 0, *offsets, 0), at) for offsets, at, n in entries]
    while level == 0 or len(nodes) > 1:
        above, size = [], 24 + 2 * INDEX_K * 8 + (2 * INDEX_K + 1) * len(end)
        groups = [nodes[k : k + 2 * INDEX_K] for k in range(0, len(nodes), 2 * INDEX_K)]
        start = out.seek(0, 2)
        for k, group in enumerate(groups):
            left, right = (start + size * (k - 1) if k else UNDEFINED), (start + size * (k + 1) if k + 1 < len(groups) else UNDEFINED)
            close = groups[k + 1][0][0] if k + 1 < len(groups) else end
            raw = b"TREE" + struct.pack("<BBHQQ", 1, level, len(group), left, right) + b"".join(key + struct.pack("<Q", at) for key, at in group) + close
            out.write(raw.ljust(size, b"\0"))
            above.append((group[0][0], start + size * k))
        nodes, level = above, level + 1
    return nodes[0][1]


def write_hdf5_grid(path: str, dims: dict[str, np.ndarray], variables: dict[str, tuple[Sequence[str], np.dtype, dict, Callable[[int], np.ndarray]]], attributes: dict | None = None, dim_attributes: dict[str, dict] | None = None, chunk: Sequence[int] | None = None, level: int = 4) -> None:
    """A NetCDF-4 file: ``dims`` are coordinate variables; a variable is (dims, type, attributes, slice k along its first dimension).

    Values lie in deflated, shuffled chunks, by default one slice of 512 cells a side each; one slice is held at a time.
    """
    with open(path, "wb") as out:
        out.write(b"\0" * 48)
        places: dict[str, int] = {}

        def put(raw: bytes) -> int:
            at = out.seek(0, 2)
            out.write(raw + b"\0" * (-len(raw) % 8))
            return at

        for k, (name, values) in enumerate(dims.items()):
            values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
            data = put(values.tobytes())
            held = {"CLASS": "DIMENSION_SCALE", "NAME": name, "_Netcdf4Dimid": np.int32(k), **(dim_attributes or {}).get(name, {})}
            layout = struct.pack("<BBQQ", 3, 1, data, values.nbytes)
            places[name] = put(_header([(1, _space_message(values.shape)), (3, _type_message(values.dtype)), (5, struct.pack("<BB", 3, 0x0A)), (8, layout), *((12, _plain_attribute(a, v)) for a, v in held.items())]))
        for name, (over, kind, held, slice_of) in variables.items():
            kind = np.dtype(kind).newbyteorder("<")
            shape = [len(dims[d]) for d in over]
            size = list(chunk) if chunk is not None else [1, *(min(n, 512) for n in shape[1:])]
            entries: list[tuple[tuple[int, ...], int, int]] = []
            for begin in range(0, shape[0], size[0]):
                block = np.stack([slice_of(k) for k in range(begin, min(begin + size[0], shape[0]))]).astype(kind)
                for inner in np.ndindex(*(-(-n // s) for n, s in zip(shape[1:], size[1:], strict=True))):
                    offsets = (begin, *(i * s for i, s in zip(inner, size[1:], strict=True)))
                    part = np.zeros(size, kind)
                    cut = block[(slice(None), *(slice(o, o + s) for o, s in zip(offsets[1:], size[1:], strict=True)))]
                    part[tuple(slice(0, n) for n in cut.shape)] = cut
                    raw = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, kind.itemsize).T.tobytes(), level)
                    entries.append((offsets, put(raw), len(raw)))
            root = _chunk_index(out, len(shape), entries, shape, kind.itemsize) if entries else UNDEFINED
            pipeline = struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 2, 1, 1, kind.itemsize) + struct.pack("<HHHI", 1, 1, 1, level)
            refs = b"".join(struct.pack("<HHIQQ", k + 1, 1, 0, 8, places[d]) for k, d in enumerate(over))
            room = max(4096, 32 + len(refs))
            free = struct.pack("<HHIQ", 0, 0, 0, room - 16 - len(refs))
            heap = put((b"GCOL" + struct.pack("<B3xQ", 1, room) + refs + free).ljust(room, b"\0"))
            reference = struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
            listed = _attribute_message("DIMENSION_LIST", struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + reference, _space_message((len(over),)), b"".join(struct.pack("<IQI", 1, heap, k + 1) for k in range(len(over))))
            layout = struct.pack(f"<BBBQ{len(shape) + 1}I", 3, 2, len(shape) + 1, root, *size, kind.itemsize)
            fill = struct.pack("<BB", 3, 0x0A)
            if "_FillValue" in held:
                fill = struct.pack("<BBI", 3, 0x2A, kind.itemsize) + np.asarray(held["_FillValue"], kind).tobytes()
            own = {a: np.asarray(v, kind) if a == "_FillValue" else v for a, v in held.items()}
            places[name] = put(_header([(1, _space_message(shape)), (3, _type_message(kind)), (5, fill), (8, layout), (11, pipeline), (12, listed), *((12, _plain_attribute(a, v)) for a, v in own.items())]))
        links = [(6, struct.pack("<BBB", 1, 0, len(name.encode())) + name.encode() + struct.pack("<Q", at)) for name, at in places.items()]
        root = put(_header([(2, struct.pack("<BBQQ", 0, 0, UNDEFINED, UNDEFINED)), (10, struct.pack("<BB", 0, 0)), *links, *((12, _plain_attribute(a, v)) for a, v in (attributes or {}).items())]))
        end = out.seek(0, 2)
        head = MAGIC + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, UNDEFINED, end, root)
        out.seek(0)
        out.write(head + struct.pack("<I", lookup3(head)))
