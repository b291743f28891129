"""Resampling, warps and stencils of volumes in tile form.

A volume is one row, its voxels an array with the first axis fastest, and numpy works on a
run of volumes at once: no voxel is a row, and nothing is shuffled but what a caller joins.
Dimensions and affines are literals or names of columns (``array<int>`` of three,
``array<double>`` of 16), so that volumes of one table may each have their own grid; rows of
like grids are worked on together. Places are 1-based voxel coordinates, given as an affine
from the output grid's voxels or as three columns of arrays. NULL is a missing voxel or value.

A row that lacks an input gets NULL, as does one with an array that does not fit its grid, a
grid that is none, or a matrix without 16 values; why stands in column ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans.runtime import ship

#: Values of one column that are worked on at once.
VALUES = 1 << 22

#: An affine (literal or the name of a column), or the names of three columns of arrays.
Places = np.ndarray | str | Sequence[str]
Dim = Sequence[int] | str
ERROR = "error"


def _matrix(column: pa.Array) -> np.ndarray:
    """A row a volume, all of one length; missing values are NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def _listed(parts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> pa.Array:
    """Lists of the rows that parts (row numbers, a matrix) have; others are NULL."""
    sizes, have = np.zeros(rows, np.int64), np.zeros(rows, bool)
    for at, x in parts:
        sizes[at], have[at] = x.shape[1], True
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(ends[-1])
    for at, x in parts:
        flat[ends[at][:, None] + np.arange(x.shape[1])] = x
    offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(~have, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def _grids(column: pa.Array) -> list[tuple[int, ...] | None]:
    return [tuple(d) if d is not None and len(d) == 3 and all(n is not None and n > 0 for n in d) else None for d in column.to_pylist()]


def _affines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the rows, and which rows have a usable one."""
    found = [m if m is not None and len(m) == 16 and None not in m else None for m in column.to_pylist()]
    x = np.array([m or [np.nan] * 16 for m in found], float).reshape(-1, 4, 4)
    return x, np.isfinite(x).all(axis=(1, 2))


def over_volumes(df: DataFrame, inputs: Sequence[str], work: Callable[..., Sequence[np.ndarray]], outputs: Sequence[str], dims: Sequence[Dim] = (), affines: Sequence[np.ndarray | str] = (), fits: Sequence[int] | None = None) -> DataFrame:
    """Add array columns that ``work`` makes from matrices (a row a volume) of the input
    columns. Where ``dims`` or ``affines`` are given, ``work`` gets lists of them first: of a
    column, the rows' common dimensions, or their matrices (rows x 4 x 4). ``fits`` has the
    place in ``dims`` of the grid that each input is on; the first one where it is not given."""
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (*outputs, ERROR)]
    names = [f.name for f in kept]
    reports = bool(dims or affines)
    had = ERROR if ERROR in df.columns else None
    extra = [T.StructField(ERROR, T.StringType())] if reports or had else []
    schema = T.StructType([*kept, *(T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs), *extra])
    on = list(fits) if fits is not None else [0] * len(inputs) if dims else []

    def checked(part):
        """Why rows can't be worked on, and what the others have in common."""
        n = len(part)
        errors: list[str | None] = [None] * n
        sizes = [part.column(c).value_lengths().to_pylist() for c in inputs]
        grids = [_grids(part.column(d)) if isinstance(d, str) else [tuple(d)] * n for d in dims]
        mats = [_affines(part.column(m)) if isinstance(m, str) else (np.asarray(m, float).reshape(4, 4), np.ones(n, bool)) for m in affines]
        alike: dict[tuple, list[int]] = {}
        for r in range(n):
            lack = next((c for c, s in zip(inputs, sizes, strict=True) if s[r] is None), None)
            if lack is not None:
                errors[r] = f"{lack} is missing"
            elif any(g[r] is None for g in grids):
                errors[r] = "unusable dimensions"
            elif not all(ok[r] for _, ok in mats):
                errors[r] = "unusable affine"
            else:
                wrong = next((c for c, s, g in zip(inputs, sizes, on, strict=False) if s[r] != np.prod(grids[g][r])), None)
                if wrong is not None:
                    errors[r] = f"{wrong} does not fit its grid"
                else:
                    alike.setdefault((*(s[r] for s in sizes), *(g[r] for g in grids)), []).append(r)
        return errors, alike, mats

    def run(batches):
        for batch in batches:
            errors, alike, mats = checked(batch)
            made: list[list] = [[] for _ in outputs]
            for key, rows in alike.items():
                step = max(1, VALUES // max(1, *key[: len(inputs)], *(int(np.prod(g)) for g in key[len(inputs) :])))
                for a in range(0, len(rows), step):
                    at = np.array(rows[a : a + step])
                    own = batch.take(pa.array(at))
                    head = [list(key[len(inputs) :]), [m if m.ndim == 2 else m[at] for m, _ in mats]] if reports else []
                    for found, x in zip(made, work(*head, *(_matrix(own.column(c)) for c in inputs)), strict=True):
                        found.append((at, x))
            columns = [*(batch.column(n) for n in names), *(_listed(parts, len(batch)) for parts in made)]
            if extra:
                old = batch.column(had).to_pylist() if had else [None] * len(batch)
                columns.append(pa.array([o or (e if reports else None) for o, e in zip(old, errors, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def grid_places(m: np.ndarray, dim: Sequence[int]) -> list[np.ndarray]:
    """Where an affine, or each of many, takes the voxels of a grid, first axis fastest."""
    k, j, i = (x.ravel() + 1.0 for x in np.meshgrid(*(np.arange(n) for n in reversed(dim)), indexing="ij"))
    m = np.asarray(m, float).reshape(*np.shape(m)[:-2], 4, 4) if np.ndim(m) > 2 else np.asarray(m, float).reshape(4, 4)
    row = lambda n, c: m[..., n, c, None] if m.ndim > 2 else m[n, c]
    return [row(n, 0) * i + row(n, 1) * j + row(n, 2) * k + row(n, 3) for n in range(3)]


def _moved(m: np.ndarray, at: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Where an affine takes points, or each row's affine its own."""
    row = lambda n, c: m[..., n, c, None] if m.ndim > 2 else m[n, c]
    return [row(n, 0) * at[0] + row(n, 1) * at[1] + row(n, 2) * at[2] + row(n, 3) for n in range(3)]


def _at(index: Sequence[np.ndarray], dim: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Linear places of voxels, and which of them the grid has (others are at 0)."""
    inside = np.logical_and.reduce([(c >= 1) & (c <= n) for c, n in zip(index, dim, strict=True)])
    i, j, k = (np.where(inside, c, 1).astype(np.int64) - 1 for c in index)
    return i + dim[0] * (j + dim[1] * k), inside


def _corners(places: Sequence[np.ndarray], dim: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight voxels around each place with their weights, 0 beyond the grid."""
    low = [np.floor(c) for c in places]
    rest = [c - f for c, f in zip(places, low, strict=True)]
    for bits in np.ndindex(2, 2, 2):
        weight = np.prod([r if b else 1 - r for r, b in zip(rest, bits, strict=True)], axis=0)
        at, inside = _at([f + b for f, b in zip(low, bits, strict=True)], dim)
        yield at, np.where(inside, weight, 0.0)


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[:, at] if at.ndim == 1 else np.take_along_axis(values, at, axis=1)


def _inverse(m: np.ndarray) -> np.ndarray:
    """Of an affine or of each of many; of a singular one nothing but NaN."""
    if m.ndim == 2:
        return np.linalg.inv(m)
    regular = np.abs(np.linalg.det(m)) > 0
    out = np.full(m.shape, np.nan)
    out[regular] = np.linalg.inv(m[regular])
    return out


def _places(places: Places) -> tuple[list, list[str]]:
    """Affines and columns that places are made of."""
    if isinstance(places, (np.ndarray, str)):
        return [places], []
    return [], list(places)


def pull(images: DataFrame, places: Places, dim: Dim, out_dim: Dim | None = None, order: int = 1, clamp: bool = False, data: str = "data", out: str = "data") -> DataFrame:
    """Each image at the places: the nearest voxel (order 0, halves up) or between eight.
    Beyond the grid, and where it is missing, the image is 0; ``clamp`` keeps results within
    the image's range."""
    affines, columns = _places(places)

    def work(dims, mats, values, *own):
        shape, target = dims
        at = grid_places(mats[0], target) if mats else own
        held = np.nan_to_num(values)
        if order == 0:
            index, inside = _at([np.floor(c + 0.5) for c in at], shape)
            found = np.where(inside, _take(held, index), 0.0)
        else:
            found = sum(w * _take(held, index) for index, w in _corners(at, shape))
        if clamp:
            with np.errstate(all="ignore"):
                low, high = (f(np.where(np.isnan(values), fill, values), axis=1, keepdims=True) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
            found = np.minimum(high, np.maximum(low, found))
        return [found]

    return over_volumes(images, [data, *columns], work, [out], [dim, out_dim or dim], affines, [0, *[1] * len(columns)])


def _scattered(values: Sequence[np.ndarray], places: Sequence[np.ndarray], dim: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of weighted values on the grid, and of the weights; values that miss any count
    for nothing."""
    n, size = len(values[0]), int(np.prod(dim))
    there = ~np.logical_or.reduce([np.isnan(v) for v in values])
    row = np.arange(n)[:, None] * size
    sums, weights = [np.zeros(n * size) for _ in values], np.zeros(n * size)
    for at, w in _corners(places, dim):
        w = np.where(there, np.broadcast_to(w, there.shape), 0.0).ravel()
        flat = (row + np.broadcast_to(at, there.shape)).ravel()
        weights += np.bincount(flat, w, n * size)
        for total, v in zip(sums, values, strict=True):
            total += np.bincount(flat, w * np.nan_to_num(v).ravel(), n * size)
    return [s.reshape(n, size) for s in sums], weights.reshape(n, size)


def push(images: DataFrame, places: Places, dim: Dim, out_dim: Dim | None = None, preserve: bool = False, data: str = "data", out: str = "data") -> DataFrame:
    """Values scattered to the eight voxels around their places: weighted mean, or the sum
    if amounts are to be preserved. Voxels that nothing reaches are NULL."""
    affines, columns = _places(places)

    def work(dims, mats, values, *own):
        (total,), weight = _scattered([values], grid_places(mats[0], dims[0]) if mats else own, dims[1])
        with np.errstate(all="ignore"):
            return [np.where(weight > 0, total if preserve else total / weight, np.nan)]

    return over_volumes(images, [data, *columns], work, [out], [dim, out_dim or dim], affines)


def compose(deformations: DataFrame, dim: Dim, affine: np.ndarray | str, outer: Sequence[str] = ("ox", "oy", "oz"), inner: Sequence[str] = ("wx", "wy", "wz"), out: Sequence[str] = ("wx", "wy", "wz"), outer_dim: Dim | None = None) -> DataFrame:
    """A deformation that goes through ``inner`` and then ``outer``, both in one row: outer's
    coordinates, millimetres of the affine's grid, are looked up in inner between eight
    voxels, of which those beyond the grid don't count. NULL where none does."""

    def work(dims, mats, ox, oy, oz, *fields):
        sums, weight = [np.zeros_like(ox) for _ in fields], np.zeros_like(ox)
        for at, w in _corners(_moved(_inverse(mats[0]), (ox, oy, oz)), dims[0]):
            met = [_take(f, at) for f in fields]
            w = np.where(np.logical_or.reduce([np.isnan(x) for x in met]), 0.0, w)
            weight += w
            for total, x in zip(sums, met, strict=True):
                total += w * np.nan_to_num(x)
        with np.errstate(all="ignore"):
            return [np.where(weight > 0, s / weight, np.nan) for s in sums]

    return over_volumes(deformations, [*outer, *inner], work, list(out), [dim, outer_dim or dim], [affine], [1, 1, 1, 0, 0, 0])


def inverse(deformations: DataFrame, dim: Dim, target_affine: np.ndarray | str, source_affine: np.ndarray | str, target_dim: Dim | None = None, rounds: int = 0, field: Sequence[str] = ("wx", "wy", "wz"), out: Sequence[str] = ("wx", "wy", "wz")) -> DataFrame:
    """Where the target's voxels come from, in millimetres of the source.

    Source coordinates are scattered to the target grid and averaged; voxels that no point
    reaches are NULL. With ``rounds`` these get the average of their neighbours first, and
    then each round moves every voxel by how far the deformation, looked up where the voxel
    is thought to come from, misses it: the fixed-point iteration of an inverse.
    """

    def filled(x, gaps, shape):
        while gaps.any() and not gaps.all():
            cube, open_ = x.reshape(len(x), *shape[::-1]), gaps.reshape(len(x), *shape[::-1])
            total, near = np.zeros(cube.shape), np.zeros(cube.shape)
            for axis in (1, 2, 3):
                for shift in (1, -1):
                    there = np.roll(~open_, shift, axis)
                    edge = [slice(None)] * 4
                    edge[axis] = 0 if shift == 1 else -1
                    there[tuple(edge)] = False
                    total += np.where(there, np.roll(np.where(open_, 0.0, cube), shift, axis), 0.0)
                    near += there
            new = gaps & (near.reshape(gaps.shape) > 0)
            x = np.where(new, (total / np.maximum(near, 1)).reshape(gaps.shape), x)
            gaps = gaps & ~new
        return x

    def work(dims, mats, *w):
        (own, shape), (target, source) = dims, mats
        world, goals = grid_places(source, own), grid_places(target, shape)
        known = np.logical_or.reduce([np.isnan(x) for x in w])
        sums, weight = _scattered([np.where(known, np.nan, s) for s in world], _moved(_inverse(target), w), shape)
        with np.errstate(all="ignore"):
            found = [np.where(weight > 0, s / weight, np.nan) for s in sums]
        if rounds:
            gaps = weight <= 0
            found = [filled(x, gaps, shape) for x in found]
            for _ in range(rounds):
                ends = [np.clip(c, 1, n) for c, n in zip(_moved(_inverse(source), found), own, strict=True)]
                here = [sum(q * _take(np.nan_to_num(x), p) for p, q in _corners(ends, own)) for x in w]
                found = [x + (g - h) for x, g, h in zip(found, goals, here, strict=True)]
        return found

    return over_volumes(deformations, list(field), work, list(out), [dim, target_dim or dim], [target_affine, source_affine])


def convolve(images: DataFrame, dim: Dim, taps: Sequence[float], data: str = "data") -> DataFrame:
    """Separable convolution with symmetric taps (odd in number); missing voxels and those
    beyond the grid are 0."""
    reach = len(taps) // 2

    def work(dims, _, values):
        x = np.nan_to_num(values).reshape(len(values), *dims[0][::-1])
        for axis in (3, 2, 1):
            wide = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in range(4)])
            n = x.shape[axis]
            x = sum(t * wide[tuple(slice(s, s + n) if a == axis else slice(None) for a in range(4))] for s, t in enumerate(taps))
        return [x.reshape(len(values), -1)]

    return over_volumes(images, [data], work, [data], [dim])


def surface(images: DataFrame, dim: Dim, above: float = 0.5, data: str = "data", out: str = "surface") -> DataFrame:
    """1 at voxels of the mask with any of their six neighbours outside it, 0 elsewhere."""

    def work(dims, _, values):
        mask = (np.nan_to_num(values, nan=-np.inf) > above).reshape(len(values), *dims[0][::-1])
        wide = np.pad(mask, [(0, 0), (1, 1), (1, 1), (1, 1)])
        inner = mask.copy()
        for axis in (1, 2, 3):
            for step in (-1, 1):
                inner &= np.roll(wide, step, axis)[:, 1:-1, 1:-1, 1:-1]
        return [(mask & ~inner).reshape(len(values), -1).astype(float)]

    return over_volumes(images, [data], work, [out], [dim])
