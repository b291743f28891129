"""Affine grids, resampling, warps, stencils and distances.

Affines are 4 x 4, from 1-based voxel indices to millimetres. Matrices known when a plan is
built are multiplied on the driver; in the plan they are twelve literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.plans.runtime import Scratch, ship

AXES = ("i", "j", "k")


def matrix(a) -> np.ndarray:
    return np.asarray(a, dtype=float).reshape(4, 4)


def voxel_size(m) -> np.ndarray:
    """Lengths of the first three columns."""
    return np.sqrt((matrix(m)[:3, :3] ** 2).sum(axis=0))


def reset_origin(m, dim: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """An axis-aligned affine with the grid's middle at 0, and what takes the old to it. A
    mirrored affine keeps its handedness through a negative first voxel size."""
    m = matrix(m)
    size = voxel_size(m)
    if np.linalg.det(m[:3, :3]) < 0:
        size[0] = -size[0]
    new = np.diag([*size, 1.0])
    new[:3, 3] = -size * (np.asarray(dim) + 1) / 2
    return new, new @ np.linalg.inv(m)


def resized(m, dim: Sequence[int], new_size: Sequence[float]) -> tuple[np.ndarray, list[int]]:
    """Affine and dimensions for another voxel size (0 counts as 1); dimensions round down."""
    want = np.where(np.asarray(new_size, float) == 0, 1.0, np.asarray(new_size, float))
    ratio = voxel_size(m) / want
    return matrix(m) @ np.diag([*(1 / ratio), 1.0]), [int(np.floor(r * d)) for r, d in zip(ratio, dim, strict=True)]


def translated(m, shift: Sequence[float]) -> np.ndarray:
    t = np.eye(4)
    t[:3, 3] = shift
    return t @ matrix(m)


def corners_box(m, dim: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest coordinates of the eight corners, halves rounded away from 0."""
    ends = np.array([[x, y, z, 1] for x in (1, dim[0]) for y in (1, dim[1]) for z in (1, dim[2])], float)
    at = (matrix(m) @ ends.T)[:3]
    away = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
    return away(at.min(axis=1)), away(at.max(axis=1))


def upright(m, dim: Sequence[int], size: Sequence[float] | None = None) -> tuple[np.ndarray, list[int]]:
    """Affine and dimensions of the axis-aligned grid that covers a volume's corners."""
    low, high = corners_box(m, dim)
    new = np.diag([*(voxel_size(m) if size is None else size), 1.0])
    new[:3, 3] = low - np.diag(new)[:3]  # voxel (1, 1, 1) lies at the lowest corner
    return new, [int(np.ceil(x)) for x in np.linalg.solve(new, [*high, 1.0])[:3]]


def reorient(image: DataFrame, keys: Sequence[str], m, dim: Sequence[int], order: int = 0, v: str = "v") -> DataFrame:
    """A volume on its upright grid; voxels beyond the old grid are missing, not 0."""
    new, shape = upright(m, dim)
    back = np.linalg.solve(matrix(m), new)
    x, y, z = affine_columns(back)
    near = [F.floor(c + 0.5) for c in (x, y, z)]
    inside = [(c >= 1) & (c <= n) for c, n in zip(near, dim, strict=True)]
    points = grid_of_each(image.select(*keys).distinct(), shape).where(inside[0] & inside[1] & inside[2])
    return pull(points.select(*keys, *AXES, x.alias("x"), y.alias("y"), z.alias("z")), image, keys, order, v=v)


def crop(cells: DataFrame, m, box) -> DataFrame:
    """Voxels whose millimetres lie in a box (two rows of x, y, z, ends included); ``None``
    or missing bounds don't limit. With a literal affine the test is a filter at the scan."""
    if box is None:
        return cells
    for c, low, high in zip(affine_columns(m), *np.asarray(box, float), strict=True):
        if np.isfinite(low):
            cells = cells.where(c >= float(low))
        if np.isfinite(high):
            cells = cells.where(c <= float(high))
    return cells


def relative_slice(n: int, share: float) -> int:
    """The slice at a share of n, halves rounded up, within 1 .. n."""
    return min(max(int(np.floor(share * n + 0.5)), 1), n)


def slice_at(m, point: Sequence[float], dim: Sequence[int]) -> list[int]:
    """The voxel nearest to a point in millimetres, cut to the grid."""
    at = np.linalg.solve(matrix(m), [*point, 1.0])[:3]
    return [min(max(int(np.floor(x + 0.5)), 1), n) for x, n in zip(at, dim, strict=True)]


def grid(spark: SparkSession, dim: Sequence[int]) -> DataFrame:
    """All voxels of a grid, 1-based, spread over partitions."""
    nx, ny, nz = dim
    p = F.col("id")
    return spark.range(nx * ny * nz).select((p % nx + 1).cast("int").alias("i"), (F.floor(p / nx) % ny + 1).cast("int").alias("j"), (F.floor(p / (nx * ny)) + 1).cast("int").alias("k"))


def grid_of_each(rows: DataFrame, dim: Sequence[int]) -> DataFrame:
    """All voxels of a grid for each row, made where the row is."""
    for axis, n in reversed(list(zip(AXES, dim, strict=True))):
        rows = rows.withColumn(axis, F.explode(F.sequence(F.lit(1), F.lit(int(n)))))
    return rows


def affine_columns(m, at: Sequence[Column | str] = AXES) -> list[Column]:
    """Where the affine takes three coordinates; an affine may be a column of 16 values."""
    x = [F.col(c) if isinstance(c, str) else c for c in at]
    if isinstance(m, Column):
        return [sum((F.get(m, F.lit(4 * r + n)) * c for n, c in enumerate(x)), F.get(m, F.lit(4 * r + 3))) for r in range(3)]
    return [sum((F.lit(float(v)) * c for v, c in zip(row[:3], x, strict=True)), F.lit(float(row[3]))) for row in matrix(m)[:3]]


def in_view(at: Sequence[Column], dim: Sequence[int]) -> Column:
    """At least 1 and below the dimension, on every axis."""
    tests = [(c >= 1) & (c < n) for c, n in zip(at, dim, strict=True)]
    return tests[0] & tests[1] & tests[2]


def mask_outside_view(cells: DataFrame, old_affine, old_dim: Sequence[int], new_affine, value: float = 0.0, v: str = "v") -> DataFrame:
    """Voxels of the new image that the old one's grid does not cover get the value."""
    m = np.linalg.solve(matrix(old_affine), matrix(new_affine))
    return cells.withColumn(v, F.when(in_view(affine_columns(m), old_dim), F.col(v)).otherwise(F.lit(value)))


def mask_outside_view_through(cells: DataFrame, deformation: DataFrame, keys: Sequence[str], affine, dim: Sequence[int], value: float = 0.0, v: str = "v") -> DataFrame:
    """The same by way of a deformation (``wx, wy, wz`` in the atlas's millimetres); voxels
    that the deformation lacks lie outside."""
    at = affine_columns(np.linalg.inv(matrix(affine)), ("wx", "wy", "wz"))
    joined = cells.join(deformation.select(*keys, *AXES, F.coalesce(in_view(at, dim), F.lit(False)).alias("_in")), [*keys, *AXES], "left")
    return joined.withColumn(v, F.when(F.coalesce("_in", F.lit(False)), F.col(v)).otherwise(F.lit(value))).drop("_in")


def _corner_weights(at: Sequence[str]) -> Column:
    """The eight voxels around a point with their weights; corners of weight 0 are left out."""
    low = [F.floor(F.col(c)) for c in at]
    f = [F.col(c) - l for c, l in zip(at, low, strict=True)]
    out = []
    for bits in range(8):
        on = [(bits >> n) & 1 for n in range(3)]
        w = F.lit(1.0)
        for n in range(3):
            w = w * (f[n] if on[n] else 1 - f[n])
        out.append(F.struct(*((low[n] + on[n]).cast("int").alias(f"c{a}") for n, a in enumerate(AXES)), w.alias("w")))
    return F.filter(F.array(*out), lambda s: s["w"] > 0)


def _corner_values(source: DataFrame, on: Sequence[str]) -> DataFrame:
    """The eight values ``_v0`` to ``_v7`` above each place that has any, so that a point
    meets them in one row. A task adds up what it has of a place before rows are exchanged."""
    corners = [F.struct(*((F.col(f"c{a}") - ((bits >> n) & 1)).cast("int").alias(f"c{a}") for n, a in enumerate(AXES)), F.lit(bits).alias("_bits")) for bits in range(8)]
    keys = [c for c in on if c not in [f"c{a}" for a in AXES]]
    rows = source.where(F.col("_v").isNotNull()).select(*keys, "_v", F.explode(F.array(*corners)).alias("_c")).select(*keys, "_v", "_c.*")
    return rows.groupBy(*on).agg(*(F.sum(F.when(F.col("_bits") == bits, F.col("_v"))).alias(f"_v{bits}") for bits in range(8)))


def pull(points: DataFrame, image: DataFrame, keys: Sequence[str], order: int = 1, at: Sequence[str] = ("x", "y", "z"), v: str = "v", clamp_to_image: bool = False) -> DataFrame:
    """The image's value at each point, in voxel coordinates of the image.

    Order 0 takes the nearest voxel (halves round up), order 1 interpolates between eight.
    Beyond the grid the image is 0. Points carry columns that are kept; NULL points give 0.
    """
    kept = [c for c in points.columns if c not in at]
    source = image.select(*keys, *(F.col(a).alias(f"c{a}") for a in AXES), F.col(v).alias("_v"))
    on = [*keys, *(f"c{a}" for a in AXES)]
    if order == 0:
        placed = points.select(*kept, *(F.floor(F.col(c) + 0.5).cast("int").alias(f"c{a}") for c, a in zip(at, AXES, strict=True)))
        out = placed.join(source, on, "left").select(*kept, F.coalesce("_v", F.lit(0.0)).alias(v))
    else:
        low = [F.floor(F.col(c)) for c in at]
        placed = points.select(*kept, *(l.cast("int").alias(f"c{a}") for l, a in zip(low, AXES, strict=True)), *((F.col(c) - l).alias(f"_f{a}") for c, l, a in zip(at, low, AXES, strict=True)))
        met = placed.join(_corner_values(source, on), on, "left")
        total = F.lit(0.0)
        for bits in range(8):
            w = F.lit(1.0)
            for n, a in enumerate(AXES):
                w = w * (F.col(f"_f{a}") if (bits >> n) & 1 else 1 - F.col(f"_f{a}"))
            total = total + F.when((w > 0) & F.col(f"_v{bits}").isNotNull(), w * F.col(f"_v{bits}")).otherwise(0.0)
        out = met.select(*kept, total.alias(v))
    if clamp_to_image:
        ends = image.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        out = out.join(ends, list(keys)).withColumn(v, F.least("_hi", F.greatest("_lo", v))).drop("_lo", "_hi")
    return out


def _spline_taps(degree: int, at: np.ndarray) -> np.ndarray:
    """The centred cardinal B-spline at each distance, as a sum of truncated powers."""
    from math import comb, factorial

    x = np.abs(at)
    return sum((-1) ** k * comb(degree + 1, k) * np.maximum((degree + 1) / 2 - k - x, 0) ** degree for k in range(degree + 2)) / factorial(degree)


@lru_cache(maxsize=64)
def _spline_system(n: int, degree: int) -> np.ndarray:
    """What takes an axis's coefficients to its values, mirrored at the edges."""
    system, reach = np.zeros((n, n)), degree // 2
    for shift in range(-reach, reach + 1):
        np.add.at(system, (np.arange(n), _folded(np.arange(n) + shift, n)), _spline_taps(degree, np.array([float(shift)]))[0])
    return system


def _folded(i: np.ndarray, n: int) -> np.ndarray:
    return np.where((r := np.mod(i, 2 * n - 2)) < n, r, 2 * n - 2 - r) if n > 1 else np.zeros_like(i)


def spline_values(image: np.ndarray, points: np.ndarray, degree: int) -> np.ndarray:
    """B-spline interpolation of an array at 1-based points (n x 3); mirrored at the edges,
    0 beyond the grid. Coefficients come from a banded system an axis."""
    return spline_values_each(np.asarray(image, float)[None], np.asarray(points)[None], degree)[0]


def spline_values_each(images: np.ndarray, points: np.ndarray, degree: int) -> np.ndarray:
    """The same of each image along the first axis, at its own points (images x n x 3)."""
    coefficients, shape = np.asarray(images, float), images.shape[1:]
    for axis, n in enumerate(shape, 1):
        moved = np.moveaxis(coefficients, axis, 0)
        coefficients = np.moveaxis(np.linalg.solve(_spline_system(n, degree), moved.reshape(n, -1)).reshape(moved.shape), 0, axis)
    flat = np.ascontiguousarray(coefficients).reshape(len(images), -1)
    zero_based = points - 1.0
    first = np.floor(zero_based - (degree - 1) / 2).astype(int)
    taps, places, stride = [], [], 1
    for a in (2, 1, 0):
        at = [first[..., a] + n for n in range(degree + 1)]
        taps.insert(0, [_spline_taps(degree, zero_based[..., a] - x) for x in at])
        places.insert(0, [_folded(x, shape[a]) * stride for x in at])
        stride *= shape[a]
    out = np.zeros(points.shape[:2])
    for x, y in np.ndindex(degree + 1, degree + 1):
        weight, place = taps[0][x] * taps[1][y], places[0][x] + places[1][y]
        for w, at in zip(taps[2], places[2], strict=True):
            out += weight * w * np.take_along_axis(flat, place + at, axis=1)
    outside = ((zero_based < 0) | (zero_based > np.array(shape) - 1)).any(axis=2)
    return np.where(outside, 0.0, out)


#: Points whose spline values are worked on at once.
SPLINE_POINTS = 1 << 18


def pull_spline(points: DataFrame, images: DataFrame, keys: Sequence[str], dim: Sequence[int], degree: int = 4, data: str = "data", out: str = "v") -> DataFrame:
    """As ``pull``, by B-splines of degree 2 to 5. ``images`` has a volume's array a row;
    a volume's points, as arrays ``x, y, z`` in one row, are read off in one pass of numpy."""
    ship(points.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def values(d: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        out: list = [None] * len(d)
        alike: dict[int, list[int]] = {}
        for n, a in enumerate(x):
            alike.setdefault(len(a), []).append(n)
        for size, rows in alike.items():
            step = max(1, SPLINE_POINTS // max(1, size, int(np.prod(dim))))
            for first in range(0, len(rows), step):
                own = rows[first : first + step]
                # first axis fastest: arrays are stacked with their axes turned
                images = np.array([np.asarray(d.iloc[n], float) for n in own]).reshape(-1, *reversed(dim)).transpose(0, 3, 2, 1)
                points = np.stack([np.array([np.asarray(c.iloc[n], float) for n in own]) for c in (x, y, z)], axis=2)
                for n, found in zip(own, spline_values_each(images, points, degree), strict=True):
                    out[n] = found
        return pd.Series(out)

    met = points.join(images.select(*keys, data), list(keys))
    return met.withColumn(out, values(data, "x", "y", "z")).drop(data)


def push(values: DataFrame, keys: Sequence[str], at: Sequence[str] = ("x", "y", "z"), v: str = "v", preserve: bool = False, dim: Sequence[int] | None = None) -> DataFrame:
    """Values scattered to the eight voxels around their points: weighted mean, or the sum
    if amounts are to be preserved. Voxels that nothing reaches are absent."""
    spread = values.where(F.col(v).isNotNull()).select(*keys, v, F.explode(_corner_weights(at)).alias("_c")).select(*keys, v, "_c.*")
    if dim is not None:
        tests = [(F.col(f"c{a}") >= 1) & (F.col(f"c{a}") <= n) for a, n in zip(AXES, dim, strict=True)]
        spread = spread.where(tests[0] & tests[1] & tests[2])
    sums = spread.groupBy(*keys, *(F.col(f"c{a}").alias(a) for a in AXES)).agg(F.sum(F.col("w") * F.col(v)).alias("_s"), F.sum("w").alias("_w"))
    return sums.select(*keys, *AXES, (F.col("_s") if preserve else F.try_divide("_s", "_w")).alias(v))


def compose(outer: DataFrame, inner: DataFrame, keys: Sequence[str], inner_affine) -> DataFrame:
    """Deformation that goes through ``inner`` and then ``outer``: outer's coordinates, in
    inner's millimetres, are looked up in inner by interpolation."""
    x, y, z = affine_columns(np.linalg.inv(matrix(inner_affine)), ("wx", "wy", "wz"))
    points = outer.select(*keys, *AXES, x.alias("x"), y.alias("y"), z.alias("z"))
    spread = points.select(*keys, *AXES, F.explode(_corner_weights(("x", "y", "z"))).alias("_c")).select(*keys, *AXES, "_c.*")
    source = inner.select(*keys, *(F.col(a).alias(f"c{a}") for a in AXES), "wx", "wy", "wz")
    met = spread.join(source, [*keys, *(f"c{a}" for a in AXES)])
    return met.groupBy(*keys, *AXES).agg(*(F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")).alias(c) for c in ("wx", "wy", "wz")))


def approximate_inverse(deformation: DataFrame, keys: Sequence[str], target_affine, source_affine, dim: Sequence[int]) -> DataFrame:
    """Where the target's voxels come from: source coordinates scattered to the target grid
    and averaged. Voxels that no point reaches are absent."""
    x, y, z = affine_columns(np.linalg.inv(matrix(target_affine)), ("wx", "wy", "wz"))
    world = affine_columns(source_affine)
    points = deformation.select(*keys, x.alias("x"), y.alias("y"), z.alias("z"), *(w.alias(n) for w, n in zip(world, ("sx", "sy", "sz"), strict=True)))
    spread = points.select(*keys, "sx", "sy", "sz", F.explode(_corner_weights(("x", "y", "z"))).alias("_c")).select(*keys, "sx", "sy", "sz", "_c.*")
    tests = [(F.col(f"c{a}") >= 1) & (F.col(f"c{a}") <= n) for a, n in zip(AXES, dim, strict=True)]
    return spread.where(tests[0] & tests[1] & tests[2]).groupBy(*keys, *(F.col(f"c{a}").alias(a) for a in AXES)).agg(*(F.try_divide(F.sum(F.col("w") * F.col(f"s{c}")), F.sum("w")).alias(f"w{c}") for c in "xyz"))


def convolve(cells: DataFrame, keys: Sequence[str], taps: Sequence[float], v: str = "v") -> DataFrame:
    """Separable convolution with symmetric taps (odd in number), 0 beyond the grid; one
    window an axis over full lines of voxels."""
    reach = len(taps) // 2
    for axis in AXES:
        line = Window.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)
        total = F.lit(0.0)
        for n, tap in enumerate(taps):
            shift = n - reach
            near = F.col(v) if shift == 0 else (F.lag(v, -shift).over(line) if shift < 0 else F.lead(v, shift).over(line))
            total = total + F.lit(float(tap)) * F.coalesce(near, F.lit(0.0))
        cells = cells.withColumn(v, total)
    return cells


SMOOTHING = (0.3, 0.4, 0.3)  # (0.75, 1, 0.75) over their sum


def gaussian_taps(fwhm_mm: float, voxel_mm: float) -> list[float]:
    """Normalised taps of a Gaussian of a full width at half maximum."""
    sigma = fwhm_mm / voxel_mm / np.sqrt(8 * np.log(2))
    reach = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def perimeter(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voxels of a mask (a row each) with any of their six neighbours outside it."""
    near = F.lit(0)
    for axis in AXES:
        line = Window.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)
        back = F.coalesce(F.col(axis) - F.lag(axis).over(line) == 1, F.lit(False))
        ahead = F.coalesce(F.lead(axis).over(line) - F.col(axis) == 1, F.lit(False))
        near = near + back.cast("int") + ahead.cast("int")
    return mask.withColumn("_near", near).where("_near < 6").drop("_near")


def nearest_distance(points: DataFrame, targets: DataFrame, keys: Sequence[str], size: Sequence[float], cell: int = 4) -> DataFrame:
    """Each point's distance, in millimetres, to the nearest target voxel of its keys.

    Targets are bucketed by cubes of ``cell`` voxels. A point asks the cubes around its own,
    in shells of growing width, and is done once the nearest target found lies no farther
    than the shell reaches; each round is an equi-join of the points still open. Points
    whose keys have no target get NULL.
    """
    def place(c):
        return F.floor(F.col(c) / cell)

    scale = [float(s) for s in size]
    scratch = Scratch(points.sparkSession, "nearest")
    targets = scratch.save(targets.select(*keys, *AXES), "targets")
    have = targets.select(*keys, *(place(a).alias(f"b{a}") for a in AXES), *(F.col(a).alias(f"t{a}") for a in AXES))
    ends = targets.groupBy(*keys).agg(*(f(place(a)).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    points = points.select(*keys, *AXES).distinct().join(ends, list(keys), "left")
    far = F.greatest(*(F.greatest(F.abs(place(a) - F.col(f"lo{a}")), F.abs(place(a) - F.col(f"hi{a}"))) for a in AXES))
    open_points = scratch.save(points.select(*keys, *AXES, far.alias("_far"), F.lit(None).cast("double").alias("_best")), "points")
    limit = open_points.agg(F.max("_far")).first()[0]
    done = open_points.where("_far IS NULL").select(*keys, *AXES, F.lit(None).cast("double").alias("distance"))
    open_points = open_points.where("_far IS NOT NULL").select(*keys, *AXES, "_far", "_best")
    shell, width = 0, 1
    while limit is not None:
        upper = min(shell + width, int(limit) + 1)
        whole = F.sequence(F.lit(-(upper - 1)), F.lit(upper - 1))
        asked = open_points.select("*", F.explode(whole).alias("oi")).select("*", F.explode(whole).alias("oj"))
        # Inside the shell only the two ends of the last axis are asked: no cube is made first.
        ends = F.concat(F.sequence(F.lit(-(upper - 1)), F.lit(-shell)), F.sequence(F.lit(shell), F.lit(upper - 1))) if shell else whole
        asked = asked.select("*", F.explode(F.when(F.greatest(F.abs("oi"), F.abs("oj")) >= shell, whole).otherwise(ends)).alias("ok"))
        asked = asked.select(*keys, *AXES, *((place(a) + F.col(f"o{a}")).alias(f"b{a}") for a in AXES))
        squared = sum(((F.col(a) - F.col(f"t{a}")) * s * (F.col(a) - F.col(f"t{a}")) * s for a, s in zip(AXES, scale, strict=True)), F.lit(0.0))
        found = asked.join(have, [*keys, *(f"b{a}" for a in AXES)]).groupBy(*keys, *AXES).agg(F.sqrt(F.min(squared)).alias("_new"))
        open_points = open_points.join(found, [*keys, *AXES], "left").withColumn("_best", F.least("_best", "_new")).drop("_new")
        open_points = scratch.save(open_points, f"round-{upper}")  # read twice below
        reach = (upper - 1) * cell * min(scale)  # every target within this has been seen
        finished = (F.col("_best") <= reach) | (F.col("_far") < upper)
        done = done.unionByName(open_points.where(finished).select(*keys, *AXES, F.col("_best").alias("distance")))
        if upper > limit:
            break
        open_points = open_points.where(~F.coalesce(finished, F.lit(False)))
        shell, width = upper, width * 2
    return done


def surface_distances(a: DataFrame, b: DataFrame, keys: Sequence[str], size: Sequence[float] = (1.0, 1.0, 1.0), surface_to_surface: bool = False) -> DataFrame:
    """95th percentile and average symmetric surface distance of two masks (a row a voxel).

    Distances go from the surface of one to the filled other, unless surfaces are asked
    for. Keys with an empty mask are absent here and NULL in reports.
    """
    from tessera.operators.statistics import hazen

    sides = []
    for own, other, name in ((a, b, "ab"), (b, a, "ba")):
        target = perimeter(other, keys) if surface_to_surface else other
        sides.append(nearest_distance(perimeter(own, keys), target, keys, size).where("distance IS NOT NULL").withColumn("_side", F.lit(name)))
    both = Scratch(a.sparkSession, "surfaces").save(sides[0].unionByName(sides[1]), "distances")
    means = both.groupBy(*keys, "_side").agg(F.avg("distance").alias("_m")).groupBy(*keys).agg((F.sum("_m") / 2).alias("assd"))
    return hazen(both, keys, "distance", (0.95,), ("hd95",)).join(means, list(keys))


def iso_grid(dim: Sequence[int], size: Sequence[float]) -> list[list[int]]:
    """For each axis the old voxel nearest to each voxel of an isotropic grid of the
    smallest size, as evenly spaced places rounded half up."""
    out = []
    for d, s in zip(dim, size, strict=True):
        n = int(np.floor(d * s / min(size) + 0.5))
        at = np.linspace(1, d, n) if n > 1 else np.array([float(d)])
        out.append(np.floor(at + 0.5).astype(int).tolist())
    return out


def to_isotropic(cells: DataFrame, keys: Sequence[str], dim: Sequence[int], size: Sequence[float], v: str = "v") -> DataFrame:
    """Nearest-neighbour copy on the isotropic grid; each voxel goes where it is nearest."""
    out = cells
    for axis, near in zip(AXES, iso_grid(dim, size), strict=True):
        goes = [[n + 1 for n, old in enumerate(near) if old == x] for x in range(1, max(near) + 1)]
        lists = F.array(*(F.array(*map(F.lit, g)) if g else F.array().cast("array<int>") for g in goes))
        out = out.withColumn(axis, F.explode(F.element_at(lists, F.col(axis))))
    return out.select(*keys, *AXES, v)
