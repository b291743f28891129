"""``spark.read.format("nifti")`` and ``df.write.format("nifti")``.

**Reading.** The planner lists a folder and packs files into partitions by what will be read
of them. A row is a volume, or with option ``layout`` = ``slices`` a slice ``k`` (counted over
the third and all later axes). Only the columns of the schema that the reader is given are
made (``.schema(HEADERS)``): without ``data`` no more than a header's 352 bytes of a file are
read, or the deflated bytes that hold them; with slices, only the header and the bytes of the
slices that filters on ``k`` leave (``spark.sql.python.filterPushdown.enabled``, which
``register`` turns on), where a file is not deflated. Filters on ``name`` leave whole files
out. Large files of a slice layout are split among partitions. ``bytes_read`` tells what was
fetched for a row's file. A file that can't be read is a row with its ``error``.

**Writing** rows of ``name``, ``dim``, ``affine``, ``data`` (options ``kind``, ``compress``).
Tasks write below a staging folder of the job, each attempt apart. Committing first puts
down, in one rename, an *intent* with all files of all tasks: from then on the new set is the
folder's set. Files are then moved to their names, the manifest replaced, and intent and
staging folder removed. A job that fails before leaves nothing, one that dies after is
finished by the next writer (or ``recover``), and readers find every file in either place.
``append`` adds to the set or replaces files of the same name, ``overwrite`` replaces the set.

**Streams.** ``spark.readStream.format("nifti")`` reads a folder that jobs write sets to. The
offset is the set's version, and every file of the set knows the version it was last written
in: a micro-batch has the files written after its start, so a stream that is stopped and
started again gives each volume once, and a volume that is written again comes again. A file
that is replaced between planning and reading is read as it is then, and comes again.

Paths are those that ``pyarrow.fs`` opens (local, ``file://``, ``hdfs://``, ``s3://``, ``gs://``);
``volume_files.scan`` reads others through Spark.

Cases: an empty folder gives no rows; a row to be written without a name, grid or voxels, or
whose voxels don't fit, fails the job, as do two rows of one name; an empty set is a manifest
without files.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.plans.runtime import ship
from tessera.sources.volume_files import HEADER_BYTES, nifti_header, scaled_voxels, write_nifti

HEADERS = "path string, name string, dim array<int>, affine array<double>, dtype string, scl_slope double, scl_inter double, error string, bytes_read long"
VOLUMES = HEADERS + ", data array<float>"
SLICES = HEADERS + ", k int, data array<float>"
_TYPES = {"path": pa.string(), "name": pa.string(), "dim": pa.list_(pa.int32()), "affine": pa.list_(pa.float64()), "dtype": pa.string(), "scl_slope": pa.float64(), "scl_inter": pa.float64(), "error": pa.string(), "bytes_read": pa.int64(), "k": pa.int32(), "data": pa.list_(pa.float32())}
#: What opening a file counts for when partitions are packed, and bytes of a partition. Of
#: very many files the opening counts for less, so that it makes no more than so many partitions.
OPEN_COST, PARTITION_BYTES, OPEN_PARTITIONS = 1 << 20, 64 << 20, 256
MANIFEST = "_manifest.json"
#: Rows of headers in a batch, voxels of slices in a batch, and files moved at once.
BATCH_ROWS, BATCH_VOXELS, MOVERS = 1000, 1 << 20, 32


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(NiftiSource)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it. ``file:/x`` counts as ``file:///x``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _read_json(store: fs.FileSystem, path: str) -> dict | None:
    try:
        with store.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _put_json(store: fs.FileSystem, path: str, value: dict) -> None:
    """Appears whole, by a rename."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(value).encode())
    store.move(part, path)


@dataclass(frozen=True)
class Held:
    """A file of a set: its name, size, and where it is found first and next."""

    name: str
    size: int
    places: tuple[str, ...]


def _intents(store: fs.FileSystem, folder: str) -> list[dict]:
    found = [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if posixpath.basename(f.path).startswith("_intent-") and f.path.endswith(".json")]
    read = [(p, _read_json(store, p)) for p in sorted(found)]
    return sorted(({"path": p} | x for p, x in read if x is not None), key=lambda x: x["version"])


def current_set(store: fs.FileSystem, folder: str) -> dict[str, Held] | None:
    """The files of the folder's set by name: of the last intent that stands, else of the
    manifest; None if the folder has neither."""
    intents = _intents(store, folder)
    manifest = intents[-1] if intents else _read_json(store, f"{folder}/{MANIFEST}")
    if manifest is None:
        return None
    staged = manifest.get("staged", {})
    return {n: Held(n, size, tuple(f"{folder}/{p}" for p in (staged.get(n), n) if p)) for n, size in manifest["files"].items()}


def versions(store: fs.FileSystem, folder: str) -> tuple[int, dict[str, int]]:
    """The set's version, and that in which each of its files was last written."""
    intents = _intents(store, folder)
    held = (intents[-1] if intents else _read_json(store, f"{folder}/{MANIFEST}")) or {"version": 0, "files": {}}
    return held["version"], {n: held.get("since", {}).get(n, held["version"]) for n in held["files"]}


def listed(store: fs.FileSystem, folder: str, patterns: Sequence[str], use_manifest: bool = True) -> list[Held]:
    """Files of the set, or all below a folder that has none, by name."""
    held = current_set(store, folder) if use_manifest else None
    if held is None:
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        held = {}
        for f in found:
            name = posixpath.relpath(f.path, folder)
            if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in name.split("/")):
                held[name] = Held(name, f.size, (f.path,))
    return [held[n] for n in sorted(held) if any(fnmatch.fnmatch(posixpath.basename(n), p) for p in patterns)]


class Bytes:
    """Reads of one file, from its start on or by range, with what they fetched."""

    def __init__(self, store: fs.FileSystem, places: Sequence[str]):
        for n, place in enumerate(places):
            try:
                self.file = store.open_input_file(place)
                break
            except FileNotFoundError:
                if n == len(places) - 1:
                    raise
        self.fetched = 0
        first = self.file.read_at(HEADER_BYTES, 0)
        self.fetched += len(first)
        self.deflated, self.first = first[:2] == b"\x1f\x8b", first
        self._inflate, self._plain, self._at = zlib.decompressobj(31), b"", len(first)
        if self.deflated:
            self._plain = self._inflate.decompress(first)

    def until(self, end: int) -> None:
        """Inflate so that the first ``end`` bytes are there, or all there are."""
        while len(self._plain) < end:
            if self._inflate.eof:
                if not self._inflate.unused_data:
                    return
                rest, self._inflate = self._inflate.unused_data, zlib.decompressobj(31)  # another member
                self._plain += self._inflate.decompress(rest)
                continue
            raw = self.file.read_at(max(HEADER_BYTES, min(end - len(self._plain), 1 << 20)), self._at)
            if not raw:
                return
            self._at += len(raw)
            self.fetched += len(raw)
            self._plain += self._inflate.decompress(raw)

    def read(self, start: int, size: int) -> bytes:
        if self.deflated:
            self.until(start + size)
            out = self._plain[start : start + size]
        elif start + size <= len(self.first):
            out = self.first[start : start + size]
        else:
            out = self.file.read_at(size, start)
            self.fetched += len(out)
        if len(out) < size:
            raise ValueError("the file ends before its voxels do")
        return out

    def header(self) -> bytes:
        if self.deflated:
            self.until(HEADER_BYTES)
            return self._plain[:HEADER_BYTES]
        return self.first


@dataclass
class Files(InputPartition):
    """Files, and which share of their slices (part, of how many)."""

    items: list[tuple[Held, int, int]]


def ranges(text: str) -> list[tuple[int, int]]:
    """Numbers and ranges, as in 2,5-7."""
    ends = [[int(x) for x in part.split("-")] for part in text.split(",")]
    if any(len(e) > 2 for e in ends):
        raise ValueError(f"{text!r} is no list of slices")
    return [(e[0], e[-1]) for e in ends]


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder = options.get("path") or ""
        if not self.folder:
            raise ValueError("the option path is missing")
        self.patterns = [p.strip() for p in options.get("pattern", "*.nii,*.nii.gz").split(",")]
        self.slices = options.get("layout", "volumes") == "slices"
        self.use_manifest = options.get("manifest", "true").lower() == "true"
        self.target = int(options.get("partitionBytes", PARTITION_BYTES))
        self.columns = schema.names
        unknown = [c for c in self.columns if c not in _TYPES or (c == "k" and not self.slices)]
        if unknown:
            raise ValueError(f"a NIfTI file has no {', '.join(unknown)}")
        self.ks = ranges(options["k"]) if "k" in options else None
        if self.ks is not None and not self.slices:
            raise ValueError("the option k is of the layout slices")
        self.names = {n.strip() for n in options["names"].split(",")} if "names" in options else None

    def wants(self, k: int) -> bool:
        return self.ks is None or any(a <= k <= z for a, z in self.ks)

    def partitions(self):
        store, folder = store_of(self.folder)
        return self.packed(listed(store, folder.rstrip("/"), self.patterns, self.use_manifest))

    def packed(self, files: Sequence[Held]) -> list[Files]:
        out, items, cost = [], [], 0
        opening = min(OPEN_COST, OPEN_PARTITIONS * self.target // max(1, len(files)))
        for held in files:
            if self.names is not None and held.name not in self.names:
                continue
            whole = held.size if "data" in self.columns else HEADER_BYTES
            parts = max(1, -(-whole // self.target)) if self.slices and not held.name.endswith(".gz") else 1
            for part in range(parts):
                each = opening + whole // parts
                if items and cost + each > self.target:
                    out.append(Files(items))
                    items, cost = [], 0
                items.append((held, part, parts))
                cost += each
        return [*out, Files(items)] if items or not out else out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(self.folder)
        prefix = self.folder[: len(self.folder.rstrip("/")) - len(folder.rstrip("/"))] if self.folder.rstrip("/").endswith(folder.rstrip("/")) else ""
        rows, voxels = [], 0
        for held, part, parts in partition.items:
            for row in self._rows(store, held, part, parts):
                row["path"] = f"{prefix}{row['path']}"
                rows.append(row)
                voxels += len(row["data"]) if row.get("data") is not None else 0
                if len(rows) >= BATCH_ROWS or voxels >= BATCH_VOXELS:
                    yield self._batch(rows)
                    rows, voxels = [], 0
        if rows:
            yield self._batch(rows)

    def _rows(self, store, held: Held, part: int, parts: int) -> Iterator[dict]:
        row = {"path": held.places[-1], "name": held.name}
        try:
            source = Bytes(store, held.places)
            head, kind, start = nifti_header(source.header())
            row |= head
            width, shape = np.dtype(kind).itemsize, head["dim"]
            values = lambda at, n: scaled_voxels(source.read(start + at * width, n * width), kind, head["scl_slope"], head["scl_inter"])
            if not self.slices:
                if "data" in self.columns:
                    row["data"] = values(0, int(np.prod(shape)))
                yield row | {"bytes_read": source.fetched}
                return
            size, count = int(np.prod(shape[:2])), int(np.prod(shape[2:]))
            for k in range(1 + count * part // parts, 1 + count * (part + 1) // parts):
                if self.wants(k):
                    own = row | {"k": k}
                    if "data" in self.columns:
                        own["data"] = values((k - 1) * size, size)
                    yield own | {"bytes_read": source.fetched}
        except Exception as e:
            if part == 0:
                yield row | {"error": f"{type(e).__name__}: {e}"}

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = []
        for c in self.columns:
            if c != "data":
                columns.append(pa.array([r.get(c) for r in rows], _TYPES[c]))
                continue
            sizes = [len(r["data"]) if r.get("data") is not None else 0 for r in rows]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=np.array([r.get("data") is None for r in rows] + [False]))
            held = [r["data"] for r in rows if r.get("data") is not None]
            columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(held) if held else pa.array([], pa.float32())))
        return pa.RecordBatch.from_arrays(columns, self.columns)


class NiftiStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.batch = NiftiReader(options, schema)

    def _versions(self):
        store, folder = store_of(self.batch.folder)
        return store, folder.rstrip("/"), *versions(store, folder.rstrip("/"))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": self._versions()[2]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        store, folder, _, since = self._versions()
        files = listed(store, folder, self.batch.patterns) if since else []
        return self.batch.packed([h for h in files if start["version"] < since.get(h.name, 0) and since.get(h.name, 0) <= end["version"]])

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)


@dataclass
class Written(WriterCommitMessage):
    """Of one task attempt: names, sizes and staged places of its files."""

    files: list[tuple[str, int, str]]


class NiftiWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder = options.get("path") or ""
        if not self.folder:
            raise ValueError("the option path is missing")
        self.kind, self.compress = options.get("kind", "float32"), options.get("compress", "false").lower() == "true"
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator) -> Written:
        store, folder = store_of(self.folder)
        folder, attempt, made, folders = folder.rstrip("/"), f"{self._staging()}/{uuid.uuid4().hex}", {}, set()
        for batch in iterator:
            for n in range(len(batch)):
                name, dim, affine = (batch.column(c)[n].as_py() for c in ("name", "dim", "affine"))
                data = batch.column("data")[n]
                if name is None or dim is None or affine is None or not data.is_valid:
                    raise ValueError(f"volume {name!r} lacks its name, dimensions, affine or voxels")
                values = data.values.to_numpy(zero_copy_only=False)
                if len(values) != int(np.prod(dim)) or len(affine) != 16:
                    raise ValueError(f"volume {name!r} does not fit its grid")
                file = f"{name}.nii.gz" if self.compress else f"{name}.nii"
                if file in made or posixpath.normpath(file) != file or file.startswith(("/", "../", "_", ".")):
                    raise ValueError(f"volume {name!r} comes twice or is no name")
                raw = write_nifti(np.asarray(values, float), dim, affine, self.kind, "", self.compress)
                place = f"{attempt}/{file}"
                if posixpath.dirname(place) not in folders:
                    store.create_dir(posixpath.dirname(f"{folder}/{place}"), recursive=True)
                    folders.add(posixpath.dirname(place))
                with store.open_output_stream(f"{folder}/{place}", compression=None) as f:
                    f.write(raw)
                made[file] = (len(raw), place)
        return Written([(name, size, place) for name, (size, place) in made.items()])

    def commit(self, messages) -> None:
        store, folder = store_of(self.folder)
        folder = folder.rstrip("/")
        new: dict[str, tuple[int, str]] = {}
        for m in messages:
            for name, size, place in m.files if m else ():
                if name in new:
                    raise ValueError(f"two volumes are named {name}")
                new[name] = (size, place)
        store.create_dir(folder, recursive=True)
        recover(self.folder)
        old = current_set(store, folder)
        if old is None:
            old = {h.name: h for h in listed(store, folder, ("*.nii", "*.nii.gz"))}
        version, since = versions(store, folder)
        version += 1
        files = ({} if self.overwrite else {n: h.size for n, h in old.items()}) | {n: size for n, (size, _) in new.items()}
        intent = {"version": version, "job": self.job, "files": files, "since": {n: version if n in new else since.get(n, 0) for n in files}, "staged": {n: place for n, (_, place) in new.items()}, "removed": sorted(set(old) - set(files))}
        _put_json(store, f"{folder}/_intent-{self.job}.json", intent)
        recover(self.folder)

    def abort(self, messages) -> None:
        """Nothing of the job is left, unless its set already counts."""
        store, folder = store_of(self.folder)
        folder = folder.rstrip("/")
        if store.get_file_info(f"{folder}/_intent-{self.job}.json").type == fs.FileType.NotFound and store.get_file_info(f"{folder}/{self._staging()}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self._staging()}")


def recover(path: str) -> int:
    """Finish what committed jobs left undone; returns how many there were. Each step may
    have been taken before."""
    store, folder = store_of(path)
    folder = folder.rstrip("/")
    intents = _intents(store, folder)
    for intent in intents:

        def move(item):
            name, place = item
            try:
                store.move(f"{folder}/{place}", f"{folder}/{name}")
            except OSError:  # maybe it has been moved
                if store.get_file_info(f"{folder}/{place}").type == fs.FileType.File:
                    raise

        def remove(name):
            try:
                store.delete_file(f"{folder}/{name}")
            except OSError:  # maybe it has been removed
                if store.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                    raise

        for at in {posixpath.dirname(name) for name in intent["staged"]}:
            store.create_dir(posixpath.join(folder, at), recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(move, intent["staged"].items()))
            list(pool.map(remove, intent["removed"]))
        _put_json(store, f"{folder}/{MANIFEST}", {"version": intent["version"], "files": intent["files"], "since": intent["since"]})
        store.delete_file(intent["path"])
        if store.get_file_info(f"{folder}/_staging-{intent['job']}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_staging-{intent['job']}")
    return len(intents)


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SLICES if self.options.get("layout", "volumes") == "slices" else VOLUMES

    def reader(self, schema: StructType) -> NiftiReader:
        return NiftiReader(self.options, schema)

    def streamReader(self, schema: StructType) -> NiftiStreamReader:
        return NiftiStreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> NiftiWriter:
        lack = [c for c in ("name", "dim", "affine", "data") if c not in schema.names]
        if lack:
            raise ValueError(f"volumes to be written lack {', '.join(lack)}")
        return NiftiWriter(self.options, overwrite)
