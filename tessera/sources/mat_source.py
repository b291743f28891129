"""MATLAB level-5 files: ``spark.read.format("mat")``, and bytes written from rows.

A row is an array of a file: ``variable`` is its place (``x``, ``s.field``, ``s(2).field`` in
an array of structures, ``c{3}`` in a cell), ``class`` its MATLAB class, ``dims`` its size,
``values`` its numbers, first dimension fastest, ``imag`` those of the imaginary part, and
``text`` a character array's rows, parted by line ends. Sparse arrays come whole. Option
``variables`` (names parted by commas) leaves other variables unread: their elements are
stepped over, of deflated ones only the beginning is inflated. ``name_of`` is a variable's own
name. ``bytes_read``
is what was fetched of the file so far. A file that can't be read, or an element that is
damaged, is a row with its ``error`` after the arrays before it.

Cases: an empty array has dims and no values; logical arrays are numbers 0 and 1; objects and
function handles are rows without values; files of both byte orders and elements in the
short form are understood; level 4 and HDF5 (7.3) files are errors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from tessera.plans.runtime import ship
from tessera.sources.nifti_source import OPEN_COST, PARTITION_BYTES, Files, listed, store_of

SCHEMA = "path string, name string, name_of string, variable string, class string, dims array<int>, values array<double>, imag array<double>, text string, error string, bytes_read long"
#: Fixed values of the format: element types with their numpy types, and array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, DEFLATED = 14, 15
CLASSES = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64", 16: "function_handle"}
HEAD = 128
#: Bytes of an element in which its name is looked for first.
PEEK = 1 << 10


class Elements:
    """The data elements of a run of bytes, one after the other."""

    def __init__(self, raw: bytes, order: str):
        self.raw, self.order, self.at = raw, order, 0

    def next(self) -> tuple[int, bytes]:
        """Type and data; elements begin at multiples of eight bytes."""
        if self.at + 8 > len(self.raw):
            raise ValueError("an element ends before its data")
        word, size = struct.unpack_from(self.order + "2I", self.raw, self.at)
        if word >> 16:  # the short form: size and type in one word, up to four bytes of data
            kind, size, start, step = word & 0xFFFF, word >> 16, self.at + 4, 8
        else:
            kind, start, step = word, self.at + 8, 8 + size + (-size % 8 if word != DEFLATED else 0)
        if start + size > len(self.raw):
            raise ValueError("an element ends before its data")
        self.at += step
        return kind, self.raw[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        if kind not in TYPES:
            raise ValueError(f"element type {kind} where numbers should be")
        return np.frombuffer(data, self.order + TYPES[kind], len(data) // np.dtype(TYPES[kind]).itemsize)

    def text(self) -> str:
        kind, data = self.next()
        return data.decode({16: "utf-8", 17: "utf-16-le" if self.order == "<" else "utf-16-be", 18: "utf-32-le" if self.order == "<" else "utf-32-be", 4: "utf-16-le" if self.order == "<" else "utf-16-be"}.get(kind, "latin-1"), errors="replace")


def _head(elements: Elements) -> tuple[int, int, list[int], str]:
    flags = elements.numbers()
    dims = [int(n) for n in elements.numbers()]
    return int(flags[0]) & 0xFF, int(flags[0]) >> 8 & 0xFF, dims, elements.text().rstrip("\0")


def arrays_of(raw: bytes, order: str, place: str | None = None) -> Iterator[dict]:
    """Rows of a matrix element: itself, or the arrays in a cell or structure."""
    if not raw:  # an empty field
        yield {"variable": place, "class": "double", "dims": [0, 0], "values": np.zeros(0)}
        return
    e = Elements(raw, order)
    kind, flags, dims, name = _head(e)
    place, count = place if place is not None else name, int(np.prod(dims))
    row = {"variable": place, "class": "logical" if flags & 2 else CLASSES.get(kind, f"class {kind}"), "dims": dims}
    if kind == 1:
        for n in range(count):
            yield from arrays_of(e.next()[1], order, f"{place}{{{n + 1}}}")
    elif kind == 2:
        width = int(e.numbers()[0])
        names = e.text()
        fields = [names[a : a + width].split("\0")[0] for a in range(0, len(names), width)] if width else []
        for n in range(count):
            for field in fields:
                yield from arrays_of(e.next()[1], order, f"{place}.{field}" if count == 1 else f"{place}({n + 1}).{field}")
    elif kind == 4:
        letters = e.text()
        rows = dims[0] if dims else 0
        yield row | {"text": "\n".join(letters[r::rows] for r in range(rows))}
    elif kind == 5:
        at, ends = e.numbers(), e.numbers()
        parts = [e.numbers() for _ in range(2 if flags & 8 else 1)]
        columns = np.repeat(np.arange(dims[1]), np.diff(ends))
        whole = []
        for part in parts:
            full = np.zeros((dims[1], dims[0]))
            full[columns, at[: len(columns)]] = part[: len(columns)]
            whole.append(full.ravel())
        yield row | dict(zip(("values", "imag"), whole, strict=False))
    elif kind in CLASSES and 6 <= kind <= 15:
        parts = [e.numbers().astype(float) for _ in range(2 if flags & 8 else 1)]
        if any(len(x) != count for x in parts):
            raise ValueError(f"{place} has {len(parts[0])} values for dimensions {dims}")
        yield row | dict(zip(("values", "imag"), parts, strict=False))
    else:
        yield row


class MatReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder = options.get("path") or ""
        if not self.folder:
            raise ValueError("the option path is missing")
        self.patterns = [p.strip() for p in options.get("pattern", "*.mat").split(",")]
        self.target, self.schema = int(options.get("partitionBytes", PARTITION_BYTES)), schema
        self.names = {n.strip() for n in options["variables"].split(",")} if "variables" in options else None

    def partitions(self):
        store, folder = store_of(self.folder)
        out, items, cost = [], [], 0
        for held in listed(store, folder.rstrip("/"), self.patterns, False):
            if items and cost + OPEN_COST + held.size > self.target:
                out.append(Files(items))
                items, cost = [], 0
            items.append((held, 0, 1))
            cost += OPEN_COST + held.size
        return [*out, Files(items)] if items or not out else out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.folder)
        for held, _, _ in partition.items:
            base, fetched = {"path": held.places[-1], "name": held.name}, [0]
            rows = []
            try:
                with store.open_input_file(held.places[-1]) as f:
                    for row in self._arrays(f, held.size, fetched):
                        rows.append(base | row | {"bytes_read": fetched[0]})
                        if sum(len(r.get("values", ())) for r in rows) > 1 << 20:
                            yield self._batch(rows)
                            rows = []
            except Exception as e:
                rows.append(base | {"error": f"{type(e).__name__}: {e}", "bytes_read": fetched[0]})
            if rows:
                yield self._batch(rows)

    def _arrays(self, f, size: int, fetched: list[int]) -> Iterator[dict]:
        def get(at: int, n: int) -> bytes:
            out = f.read_at(n, at)
            fetched[0] += len(out)
            return out

        head = get(0, HEAD)
        order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
        if order is None or struct.unpack_from(order + "H", head, 124)[0] >> 8 != 1:
            raise ValueError("not a level-5 file")
        at = HEAD
        while at + 8 <= size:
            word, n = struct.unpack(order + "2I", get(at, 8))
            if word not in (MATRIX, DEFLATED):
                raise ValueError(f"element type {word} where an array should be")
            if at + 8 + n > size:
                raise ValueError("the file ends before its arrays do")
            first = get(at + 8, min(n, PEEK))
            # Of a deflated element the matrix's own tag comes first.
            start = zlib.decompressobj().decompress(first, PEEK)[8:] if word == DEFLATED else first
            name = self._name(start, order)
            if name is None or self.names is None or name in self.names:
                raw = first + (get(at + 8 + len(first), n - len(first)) if n > len(first) else b"")
                if word == DEFLATED:
                    kind, raw = Elements(zlib.decompress(raw), order).next()
                    if kind != MATRIX:
                        raise ValueError(f"element type {kind} where an array should be")
                own = _head(Elements(raw, order))[3]
                if self.names is None or own in self.names:
                    for row in arrays_of(raw, order):
                        yield row | {"name_of": own}
            at += 8 + n + (-n % 8 if word == MATRIX else 0)

    @staticmethod
    def _name(start: bytes, order: str) -> str | None:
        try:
            return _head(Elements(start, order))[3]
        except ValueError:  # longer than what was looked at
            return None

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"dims": pa.list_(pa.int32()), "values": pa.list_(pa.float64()), "imag": pa.list_(pa.float64()), "bytes_read": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.schema.names], self.schema.names)


class MatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatReader:
        return MatReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(MatSource)


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<2I", kind, len(data)) + data + bytes(-len(data) % 8)


def _matrix(name: str, value) -> bytes:
    """A matrix element of a number, text, array, mapping (a structure) or list (a cell)."""
    def made(kind: int, dims, *parts: bytes, flags: int = 0) -> bytes:
        head = _element(6, struct.pack("<2I", kind | flags << 8, 0)) + _element(5, struct.pack(f"<{len(dims)}i", *dims)) + _element(1, name.encode())
        return _element(MATRIX, head + b"".join(parts))

    if isinstance(value, Mapping):
        width = 32
        names = b"".join(k.encode()[: width - 1].ljust(width, b"\0") for k in value)
        return made(2, (1, 1), _element(5, struct.pack("<i", width)), _element(1, names), *(_matrix("", v) for v in value.values()))
    if isinstance(value, list):
        return made(1, (1, len(value)), *(_matrix("", v) for v in value))
    if isinstance(value, str):
        units = value.encode("utf-16-le")
        return made(4, (1 if units else 0, len(units) // 2), _element(4, units))
    x = np.asarray(value)
    x = x.reshape(1, -1) if x.ndim < 2 else x
    if x.dtype == bool:
        return made(9, x.shape, _element(2, x.astype("u1").tobytes("F")), flags=2)
    if np.iscomplexobj(x):
        return made(6, x.shape, *(_element(9, p.astype("<f8").tobytes("F")) for p in (x.real, x.imag)), flags=8)
    kind = {v: k for k, v in CLASSES.items()}.get({"float64": "double", "float32": "single"}.get(x.dtype.name, x.dtype.name), 6)
    element = {np.dtype(t).name: k for k, t in TYPES.items() if k < 16}.get(x.dtype.name, 9)
    return made(kind, x.shape, _element(element, x.astype(x.dtype.newbyteorder("<") if element != 9 else "<f8").tobytes("F")))


def write_mat(variables: Mapping[str, object], compress: bool = False) -> bytes:
    """A level-5 file of these variables."""
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for name, value in variables.items():
        raw = _matrix(name, value)
        if compress:
            packed = zlib.compress(raw)
            raw = struct.pack("<2I", DEFLATED, len(packed)) + packed
        out.append(raw)
    return b"".join(out)
