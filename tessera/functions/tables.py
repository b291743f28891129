"""Table functions for SQL: each gives rows for a row of arguments, as LATERAL joins take them.

``register`` makes them known to a session by name; then, of any table with dimensions and
affines, ``SELECT ... FROM volumes, LATERAL voxel_grid(dim, affine)``.

* ``voxel_grid(dim, affine)``: i, j, k and millimetres x, y, z of a grid's voxels.
* ``corner_points(dim, affine)``: the eight corners in millimetres.
* ``slice_values(data, dim, k)``: i, j and value of a slice.
* ``histogram_bins(data, low, high, bins)``: how many values each bin has; those beyond are
  in the end bins, missing ones in none.

Cases: a missing or unusable argument (dimensions that are not three positive numbers, a
matrix without 16 values, an array that does not fit) gives no rows; a slice that a volume
lacks has none; a width of 0 puts all values into the first bin.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.runtime import ship


def _dims(dim) -> list[int] | None:
    ok = dim is not None and len(dim) == 3 and all(n is not None and n > 0 for n in dim)
    return [int(n) for n in dim] if ok else None


def _matrix(affine) -> np.ndarray | None:
    ok = affine is not None and len(affine) == 16 and all(x is not None for x in affine)
    return np.array(affine, float).reshape(4, 4) if ok else None


class VoxelGrid:
    def eval(self, dim, affine):
        d, m = _dims(dim), _matrix(affine)
        if d is None or m is None:
            return
        for k in range(1, d[2] + 1):
            for j in range(1, d[1] + 1):
                at = m[:3, 1] * j + m[:3, 2] * k + m[:3, 3]
                for i in range(1, d[0] + 1):
                    x, y, z = (m[:3, 0] * i + at).tolist()
                    yield i, j, k, x, y, z


class CornerPoints:
    def eval(self, dim, affine):
        d, m = _dims(dim), _matrix(affine)
        if d is None or m is None:
            return
        for n, corner in enumerate(product(*((1, x) for x in d))):
            yield (n, *(m[:3] @ [*corner, 1.0]).tolist())


class SliceValues:
    def eval(self, data, dim, k):
        d = _dims(dim)
        if d is None or data is None or k is None or len(data) != d[0] * d[1] * d[2] or not 1 <= k <= d[2]:
            return
        size = d[0] * d[1]
        for p, v in enumerate(data[(k - 1) * size : k * size]):
            yield p % d[0] + 1, p // d[0] + 1, None if v is None else float(v)


class HistogramBins:
    def eval(self, data, low, high, bins):
        if data is None or low is None or high is None or bins is None or bins < 1:
            return
        x = np.array([v for v in data if v is not None], float)
        x = x[~np.isnan(x)]
        width = (high - low) / bins
        at = np.clip(np.floor((x - low) / width), 0, bins - 1).astype(int) if width > 0 else np.zeros(len(x), int)
        for n, count in enumerate(np.bincount(at, minlength=bins).tolist()):
            yield n + 1, count


FUNCTIONS = {
    "voxel_grid": (VoxelGrid, "i int, j int, k int, x double, y double, z double"),
    "corner_points": (CornerPoints, "corner int, x double, y double, z double"),
    "slice_values": (SliceValues, "i int, j int, v double"),
    "histogram_bins": (HistogramBins, "bin int, n long"),
}


def register(spark: SparkSession) -> None:
    """Name the functions in a session's SQL."""
    ship(spark)
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
