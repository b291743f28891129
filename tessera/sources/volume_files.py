"""NIfTI-1 and MetaImage (MHA) files as DataFrames, and written from them.

Files come through Spark's ``binaryFile`` reader, so any store it can list will do; a file
is one row, decoded in its own task. ``headers_only`` leaves the voxels out.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.runtime import ship
from tessera.sources.files import files_below, write_files

#: Fixed values of the NIfTI-1 format: data type code, numpy type.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
#: Fixed values of the MetaImage format: element type, numpy type. Unsigned types are read
#: as they are and not narrowed to signed ones.
MHA_TYPES = {
    "MET_CHAR": "i1",
    "MET_UCHAR": "u1",
    "MET_SHORT": "i2",
    "MET_USHORT": "u2",
    "MET_INT": "i4",
    "MET_UINT": "u4",
    "MET_FLOAT": "f4",
    "MET_DOUBLE": "f8",
}
SCHEMA = "path string, dim array<int>, affine array<double>, dtype string, scl_slope double, scl_inter double, data array<float>, error string"


def _quaternion_affine(b: float, c: float, d: float, offset, pixdim) -> np.ndarray:
    a = np.sqrt(max(0.0, 1.0 - (b * b + c * c + d * d)))
    r = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )
    m = np.eye(4)
    m[:3, :3] = r * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
    m[:3, 3] = offset
    return m


#: Bytes that a NIfTI-1 header takes in a file that voxels follow in.
HEADER_BYTES = 352


def nifti_header(raw: bytes) -> tuple[dict, str, int]:
    """Header fields of a file's first bytes, the numpy type of its voxels with their byte
    order, and where they begin. The affine takes 1-based indices; the file's 0-based ones."""
    if len(raw) < 348:
        raise ValueError(f"a file of {len(raw)} bytes")
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    if struct.unpack_from(order + "i", raw, 0)[0] != 348 or raw[344:348] not in (b"n+1\0", b"ni1\0"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    pixdim = struct.unpack_from(order + "8f", raw, 76)
    start, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    qform, sform = struct.unpack_from(order + "2h", raw, 252)
    if code not in NIFTI_TYPES:
        raise ValueError(f"data type {code}")
    if sform > 0:
        m = np.vstack([np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        m = _quaternion_affine(*struct.unpack_from(order + "3f", raw, 256), struct.unpack_from(order + "3f", raw, 268), pixdim)
    else:
        m = np.diag([*pixdim[1:4], 1.0])
    shift = np.eye(4)
    shift[:3, 3] = -1
    shape = [max(1, n) for n in dim[1 : 1 + dim[0]]]
    slope = slope if np.isfinite(slope) and slope != 0 else 1.0
    inter = inter if np.isfinite(inter) else 0.0
    return {"dim": shape, "affine": (m @ shift).ravel().tolist(), "dtype": np.dtype(NIFTI_TYPES[code]).name, "scl_slope": slope, "scl_inter": inter}, order + NIFTI_TYPES[code], int(start)


def scaled_voxels(raw: bytes, kind: str, slope: float, inter: float) -> pa.Array:
    """Voxels of a file's bytes as they are meant; NaN is missing."""
    return _nan_to_null((np.frombuffer(raw, kind).astype(np.float64) * slope + inter).astype(np.float32))


def read_nifti(raw: bytes, headers_only: bool = False) -> dict:
    """Header and voxels."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, kind, start = nifti_header(raw)
    size = int(np.prod(head["dim"])) * np.dtype(kind).itemsize
    if not headers_only and len(raw) < start + size:
        raise ValueError("the file ends before its voxels do")
    return head | {"data": None if headers_only else scaled_voxels(raw[start : start + size], kind, head["scl_slope"], head["scl_inter"])}


def _nan_to_null(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float32(), mask=np.isnan(values))


def read_mha(raw: bytes, headers_only: bool = False) -> dict:
    """A local MetaImage: ``key = value`` lines up to the data, then voxels (maybe deflated)."""
    head, at = {}, 0
    while True:
        end = raw.index(b"\n", at)
        key, _, value = raw[at:end].decode("latin-1").partition("=")
        head[key.strip().upper()], at = value.strip(), end + 1
        if key.strip().upper() == "ELEMENTDATAFILE":
            break
    if head["ELEMENTDATAFILE"].upper() != "LOCAL":
        raise ValueError("voxels are in another file")
    if head.get("ELEMENTTYPE") not in MHA_TYPES:
        raise ValueError(f"element type {head.get('ELEMENTTYPE')}")
    if int(head.get("HEADERSIZE", "0")) > 0:
        at = int(head["HEADERSIZE"])
    shape = [int(x) for x in head["DIMSIZE"].split()]
    floats = lambda *names, default: next(([float(x) for x in head[n].split()] for n in names if n in head), default)
    size = floats("ELEMENTSPACING", "ELEMENTSIZE", default=[1.0] * 3)
    offset = floats("OFFSET", "POSITION", "ORIGIN", default=[0.0] * 3)
    turn = np.array(floats("TRANSFORMMATRIX", "ROTATION", "ORIENTATION", default=np.eye(3).ravel().tolist())).reshape(3, 3).T
    m = np.eye(4)
    m[:3, :3] = turn * np.array(size)
    m[:3, 3] = offset
    m = np.diag([-1.0, -1.0, 1.0, 1.0]) @ m  # the format's axes point left and back
    shift = np.eye(4)
    shift[:3, 3] = -1
    order = ">" if head.get("BINARYDATABYTEORDERMSB", head.get("ELEMENTBYTEORDERMSB", "False")).lower() == "true" else "<"
    out = {"dim": shape, "affine": (m @ shift).ravel().tolist(), "dtype": np.dtype(MHA_TYPES[head["ELEMENTTYPE"]]).name, "scl_slope": 1.0, "scl_inter": 0.0, "data": None}
    if not headers_only:
        body = raw[at:]
        body = zlib.decompress(body) if head.get("COMPRESSEDDATA", "False").lower() == "true" else body
        out["data"] = _nan_to_null(np.frombuffer(body, order + MHA_TYPES[head["ELEMENTTYPE"]], int(np.prod(shape))).astype(np.float32))
    return out


def write_nifti(values, dim, affine, kind: str = "float32", description: str = "", compress: bool = False) -> bytes:
    """A NIfTI-1 file. Integers are scaled so that the largest value is the type's largest."""
    code = {np.dtype(t).name: c for c, t in NIFTI_TYPES.items()}[kind]
    x = values.astype(np.float64) if isinstance(values, np.ndarray) else np.array([np.nan if v is None else v for v in values], dtype=np.float64)
    slope, finite = 1.0, x[np.isfinite(x)]
    if np.issubdtype(np.dtype(kind), np.integer):
        ends = np.iinfo(kind)
        top, low = (finite.max(), finite.min()) if len(finite) else (0.0, 0.0)
        slope = max(top / ends.max, low / ends.min if ends.min else 0.0, 0.0)
        scaled = np.where(np.isfinite(x), x, 0) / slope if slope > 0 else np.zeros(len(x))
        x = np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), ends.min, ends.max)
    shift = np.eye(4)
    shift[:3, 3] = 1
    m = np.asarray(affine, float).reshape(4, 4) @ shift
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, len(dim), *dim, *[1] * (7 - len(dim)))
    struct.pack_into("<2h", head, 70, code, 8 * np.dtype(kind).itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((m[:3, :3] ** 2).sum(axis=0)), *[1.0] * 4)
    struct.pack_into("<3f", head, 108, 352.0, slope if slope > 0 else 1.0, 0.0)
    head[148 : 148 + len(description.encode()[:79])] = description.encode()[:79]
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *m[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + x.astype(np.dtype(kind).newbyteorder("<")).tobytes()
    return gzip.compress(raw, mtime=0) if compress else raw


def scan(spark: SparkSession, folder: str, pattern: str = "*.{nii,nii.gz,mha}", headers_only: bool = False) -> DataFrame:
    """A row for each file below the folder; a file that can't be read says why in ``error``."""
    ship(spark)
    files = files_below(spark, folder, pattern)

    def run(batches):
        types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.string()]
        names = ["path", "dim", "affine", "dtype", "scl_slope", "scl_inter", "data", "error"]
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                row = dict.fromkeys(names)
                try:
                    row |= (read_mha if path.endswith(".mha") else read_nifti)(raw.as_py(), headers_only)
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                row["path"] = path
                data = row.pop("data")
                lists = pa.array([None], types[6]) if data is None else pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data)
                yield pa.RecordBatch.from_arrays([lists if n == "data" else pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def update_affine(raw: bytes, affine) -> bytes:
    """The NIfTI file with another affine (of 1-based indices); voxels are not touched."""
    packed = raw[:2] == b"\x1f\x8b"
    out = bytearray(gzip.decompress(raw) if packed else raw)
    order = "<" if struct.unpack_from("<i", out, 0)[0] == 348 else ">"
    if struct.unpack_from(order + "i", out, 0)[0] != 348 or out[344:348] not in (b"n+1\0", b"ni1\0"):
        raise ValueError("not a NIfTI-1 file")
    shift = np.eye(4)
    shift[:3, 3] = 1
    m = np.asarray(affine, float).reshape(4, 4) @ shift
    struct.pack_into(order + "3f", out, 80, *np.sqrt((m[:3, :3] ** 2).sum(axis=0)))
    struct.pack_into(order + "2h", out, 252, 0, 2)
    struct.pack_into(order + "12f", out, 280, *m[:3].ravel())
    return gzip.compress(bytes(out), mtime=0) if packed else bytes(out)


def write_mha(values, dim, affine, element: str = "MET_FLOAT", compress: bool = False, big_endian: bool = False) -> bytes:
    """A local MetaImage file. Integers are rounded half up and cut to the type's range."""
    kind = np.dtype(MHA_TYPES[element])
    x = np.asarray(values, np.float64)
    if np.issubdtype(kind, np.integer):
        x = np.clip(np.floor(np.nan_to_num(x) + 0.5), np.iinfo(kind).min, np.iinfo(kind).max)
    shift = np.eye(4)
    shift[:3, 3] = 1
    m = np.diag([-1.0, -1.0, 1.0, 1.0]) @ np.asarray(affine, float).reshape(4, 4) @ shift
    size = np.sqrt((m[:3, :3] ** 2).sum(axis=0))
    body = x.astype(kind.newbyteorder(">" if big_endian else "<")).tobytes()
    body = zlib.compress(body) if compress else body
    show = lambda v: " ".join(repr(float(n)) for n in np.ravel(v))
    head = {
        "ObjectType": "Image",
        "NDims": len(dim),
        "BinaryData": True,
        "BinaryDataByteOrderMSB": big_endian,
        "CompressedData": compress,
        "TransformMatrix": show((m[:3, :3] / size).T),
        "Offset": show(m[:3, 3]),
        "ElementSpacing": show(size),
        "DimSize": " ".join(map(str, dim)),
        "ElementType": element,
        "ElementDataFile": "LOCAL",
    }
    return "".join(f"{k} = {v}\n" for k, v in head.items()).encode() + body


def _volume(column, n: int) -> np.ndarray | None:
    """Row n of a list column as an array; missing voxels are NaN."""
    return column[n].values.to_numpy(zero_copy_only=False) if column[n].is_valid else None


#: Bytes of files that go on to be written at once.
FILE_BYTES = 8 << 20


def encode(tiles: DataFrame, kind: str = "float32", compress: bool = False, data: str = "data") -> DataFrame:
    """Each row's volume as the bytes of a NIfTI file, in column ``content``."""
    ship(tiles.sparkSession)
    kept = [c for c in tiles.columns if c != "content"]
    schema = tiles.select(*kept).schema.add("content", "binary")

    def run(batches):
        for batch in batches:
            first, raws, held = 0, [], 0
            for n in range(len(batch)):
                values = _volume(batch.column(data), n)
                raw = None if values is None else write_nifti(values, batch.column("dim")[n].as_py(), batch.column("affine")[n].as_py(), kind, "", compress)
                raws.append(raw)
                held += len(raw or b"")
                if held >= FILE_BYTES or n + 1 == len(batch):
                    rows = batch.slice(first, len(raws))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(raws, pa.binary())], [*kept, "content"])
                    first, raws, held = n + 1, [], 0

    return tiles.mapInArrow(run, schema)


def save(tiles: DataFrame, folder: str, name: str, kind: str = "float32", compress: bool = False) -> DataFrame:
    """Write each row's volume to ``folder`` under the name in a column; returns the paths.
    The folder is a path or URI that every executor reaches; a file appears whole or not."""
    coded = encode(tiles.select(name, "dim", "affine", "data"), kind, compress)
    return write_files(coded.select(F.concat(name, F.lit(".nii.gz" if compress else ".nii")).alias("name"), "content"), folder)


def rewrite_headers(spark: SparkSession, folder: str, affines: DataFrame, pattern: str = "*.{nii,nii.gz}") -> DataFrame:
    """Give the NIfTI files below a folder new affines, from a table of ``name`` (the file's)
    and ``affine``. Files are replaced whole; returns the paths."""
    ship(spark)
    files = files_below(spark, folder, pattern)
    met = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content").join(affines.select("name", "affine"), "name")

    def run(batches):
        for batch in batches:
            names, raws, held = [], [], 0
            for name, raw, affine in zip(batch.column("name").to_pylist(), batch.column("content"), batch.column("affine").to_pylist(), strict=True):
                names.append(name)
                raws.append(update_affine(raw.as_py(), affine))
                held += len(raws[-1])
                if held >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(raws, pa.binary())], ["name", "content"])
                    names, raws, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(raws, pa.binary())], ["name", "content"])

    return write_files(met.mapInArrow(run, "name string, content binary"), folder)
