"""Overlap, volume and variation of segmentations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tiles import VALUES
from tessera.plans.runtime import ship


def dice_of_counts(both, a, b):
    """2 |A and B| / (|A| + |B|); 1 if both are empty."""
    return F.when(a + b == 0, 1.0).otherwise(F.try_divide(2.0 * both, (a + b).cast("double")))


def mask_of(data: Column, above: float = 0.5) -> Column:
    """The mask of a volume's array: an eighth of its bytes, to be made before rows move. A
    missing value is outside."""
    return F.transform(data, lambda x: F.coalesce(x > above, F.lit(False)))


def dice_masks(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """As ``dice_tiles``, of masks. Masks of unequal lengths are on no common grid: NULL."""
    size = lambda m: F.size(F.filter(m, lambda t: t))
    return pairs.select(*keys, F.when(F.size(a) == F.size(b), dice_of_counts(size(F.zip_with(a, b, lambda x, y: x & y)), size(F.col(a)), size(F.col(b)))).alias("dice"))


def dice_tiles(pairs: DataFrame, keys: Sequence[str], a: str, b: str, above: float = 0.5) -> DataFrame:
    """Of two arrays in one row: no shuffle. A missing value is outside the mask."""
    masks = pairs.select(*keys, mask_of(F.col(a), above).alias("_a"), mask_of(F.col(b), above).alias("_b"))
    return dice_masks(masks, keys, "_a", "_b")


def dice_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], above: float = 0.5, value: str = "v") -> DataFrame:
    """Of voxel tables: only mask voxels are joined, so background never moves."""
    at = [*keys, "i", "j", "k"]
    x = a.where(F.col(value) > above).select(*at, F.lit(1).alias("_a"))
    y = b.where(F.col(value) > above).select(*at, F.lit(1).alias("_b"))
    all_keys = a.select(*keys).unionByName(b.select(*keys)).distinct()
    met = x.join(y, at, "full").groupBy(*keys).agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("_both"))
    zero = {"_na": 0, "_nb": 0, "_both": 0}
    return all_keys.join(met, list(keys), "left").na.fill(zero).select(*keys, dice_of_counts(F.col("_both"), F.col("_na"), F.col("_nb")).alias("dice"))


def _envelope(f: np.ndarray, step: float) -> np.ndarray:
    """Of each row, the least over p of f[p] + ((q - p) step)^2 at every q, in a time that
    grows with the row: the parabolas of the lower envelope are kept on a stack, a new one
    takes away those it undercuts, and one walk along the stack reads the values off. All
    rows go together; infinite values have no parabola."""
    rows, n = f.shape
    x = np.arange(n) * step
    place, since = np.zeros((rows, n), np.int32), np.full((rows, n), -np.inf)
    top = np.full(rows, -1)
    for q in range(n):
        own = np.flatnonzero(np.isfinite(f[:, q]))
        begins, open_ = np.full(len(own), -np.inf), np.arange(len(own))
        while True:
            open_ = open_[top[own[open_]] >= 0]
            if not len(open_):
                break
            r = own[open_]
            p = place[r, top[r]]
            crossing = (f[r, q] - f[r, p] + x[q] * x[q] - x[p] * x[p]) / (2 * (x[q] - x[p]))
            under = crossing <= since[r, top[r]]
            begins[open_[~under]] = crossing[~under]
            top[r[under]] -= 1
            open_ = open_[under]
        begins[top[own] < 0] = -np.inf
        top[own] += 1
        place[own, top[own]], since[own, top[own]] = q, begins
    out, at = np.full(f.shape, np.inf), np.zeros(rows, np.int64)
    some = np.flatnonzero(top >= 0)
    for q in range(n):
        open_ = some
        while True:
            open_ = open_[at[open_] < top[open_]]
            open_ = open_[since[open_, at[open_] + 1] < x[q]]
            if not len(open_):
                break
            at[open_] += 1
        p = place[some, at[some]]
        out[some, q] = (x[q] - x[p]) ** 2 + f[some, p]
    return out


def squared_distance(mask: np.ndarray, size: Sequence[float]) -> np.ndarray:
    """Squared distance of every voxel to the nearest of the mask (or of each of several
    masks along a first axis), exactly and in a time that grows with the voxels: one lower
    envelope of parabolas a line of voxels and axis. Infinite without any."""
    d = np.where(mask, 0.0, np.inf)
    for axis, s in enumerate(size, mask.ndim - 3):
        lines = np.moveaxis(d, axis, -1)
        d = np.moveaxis(_envelope(lines.reshape(-1, lines.shape[-1]), float(s)).reshape(lines.shape), -1, axis)
    return d


def surface_of(mask: np.ndarray) -> np.ndarray:
    """Voxels with any of their six neighbours outside the mask or the volume, also of several
    masks along a first axis."""
    wide = np.pad(mask, [(0, 0)] * (mask.ndim - 3) + [(1, 1)] * 3)
    inner = mask.copy()
    for axis in range(mask.ndim - 3, mask.ndim):
        for step in (-1, 1):
            inner &= np.roll(wide, step, axis)[..., 1:-1, 1:-1, 1:-1]
    return mask & ~inner


def distances_of(a: np.ndarray, b: np.ndarray, size: Sequence[float], surface_to_surface: bool = False) -> tuple[float, float] | None:
    """95th percentile and average symmetric surface distance of two masks; None if either
    is empty."""
    found = distances_of_each(a[None], b[None], size, surface_to_surface)[0]
    return None if found[0] is None else found


def distances_of_each(a: np.ndarray, b: np.ndarray, size: Sequence[float], surface_to_surface: bool = False) -> list[tuple[float, float] | tuple[None, None]]:
    """The same of each two masks along the first axis."""
    surfaces = surface_of(a), surface_of(b)
    far = [np.sqrt(squared_distance(x, size)) for x in (surfaces[::-1] if surface_to_surface else (b, a))]
    out = []
    for n in range(len(a)):
        sides = [d[n][s[n]] for d, s in zip(far, surfaces, strict=True)]
        if not len(sides[0]) or not len(sides[1]):
            out.append((None, None))
            continue
        both = np.sort(np.concatenate(sides))
        h = min(max(0.95 * len(both) + 0.5, 1.0), float(len(both)))
        low = int(np.floor(h))
        high = both[min(low, len(both) - 1)]
        out.append((float(both[low - 1] + (h - low) * (high - both[low - 1])), float((sides[0].mean() + sides[1].mean()) / 2)))
    return out


def distances_tiles(pairs: DataFrame, keys: Sequence[str], a: str, b: str, dim: Sequence[int], size: Sequence[float], above: float = 0.5, surface_to_surface: bool = False, isotropic: bool = False) -> DataFrame:
    """Surface distances of two arrays (or masks) in one row: the dense form. A pair is one
    row's work in numpy, whatever its masks; ``geometry.surface_distances`` is the form for voxel rows.

    ``isotropic`` first brings both masks to voxels of the smallest size on every axis, by the
    nearest old voxel, so that each part of a surface counts by its extent: surfaces and
    percentiles of anisotropic volumes differ from those on the given grid."""
    from tessera.operators.geometry import iso_grid

    ship(pairs.sparkSession)
    near = [np.array(n) - 1 for n in iso_grid(dim, size)] if isotropic else None
    step_of = (float(min(size)),) * 3 if isotropic else tuple(size)

    @F.pandas_udf("hd95 double, assd double")
    def both(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows, step = [], max(1, VALUES // int(np.prod(dim)))
        shape = (-1, *reversed(dim))  # axes z, y, x
        for n in range(0, len(x), step):
            masks = [np.nan_to_num(np.array([np.asarray(v, dtype=float) for v in c[n : n + step]]), nan=-np.inf).reshape(shape) > above for c in (x, y)]
            if near is not None:
                masks = [m[:, near[2]][:, :, near[1]][:, :, :, near[0]] for m in masks]
            rows += distances_of_each(*masks, tuple(reversed(step_of)), surface_to_surface)
        return pd.DataFrame(rows, columns=["hd95", "assd"], dtype="float64")

    return pairs.select(*keys, both(a, b).alias("d")).select(*keys, "d.hd95", "d.assd")


def volumes_ml(tiles: DataFrame, keys: Sequence[str], tissue: str, data: str, voxel_mm3: Column | float, brain: Sequence[str], skull: Sequence[str], mask: str | None = None) -> DataFrame:
    """Brain and intracranial volume in millilitres: sums of tissue over voxels (inside the
    mask, if there is one). A tile is summed in its row before rows meet."""
    values = F.col(data) if mask is None else F.zip_with(data, mask, lambda v, m: F.when(F.coalesce(m, F.lit(False)), v).otherwise(0.0))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    part = tiles.select(*keys, tissue, (total * voxel_mm3 / 1000.0).alias("_ml"))
    return part.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(tissue).isin(*brain), F.col("_ml"))), F.lit(0.0)).alias("tbv_ml"),
        F.coalesce(F.sum(F.when(F.col(tissue).isin(*skull), F.col("_ml"))), F.lit(0.0)).alias("tiv_ml"),
    )


#: Voxels of a moment row, doubles that a task holds before it hands rows on, and tasks that
#: a group's rows meet in first.
MOMENT_VOXELS, MOMENT_HELD = 1 << 16, 1 << 24
LANES = 32


def _merge(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
    """Counts, means and squared deviations of two groups, element by element; the shorter
    one has nothing beyond its end."""
    if a is None:
        return b
    if len(a[0]) != len(b[0]):
        most = max(len(a[0]), len(b[0]))
        a, b = ([np.pad(x, (0, most - len(x))) for x in g] for g in (a, b))
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[1] - a[1]
    return [n, a[1] + apart * share, a[2] + b[2] + apart * apart * a[0] * share]


def array_moments(tiles: DataFrame, by: Sequence[str], data: str = "data", floor: float | None = None) -> DataFrame:
    """Count, mean and sum of squared deviations of each voxel over the volumes of a group,
    as arrays: a row a group and ``block`` of ``MOMENT_VOXELS`` voxels.

    Each task adds its volumes up in arrays; a group's rows then meet in ``LANES`` tasks and
    these tasks' rows in one, a row at a time, and no voxel is a row. Missing values count for nothing; volumes of a group may differ in
    length. ``floor`` raises smaller values to it.
    """
    spark = tiles.sparkSession
    ship(spark)
    keys = list(by)
    given = tiles.select(*keys, F.col(data).cast("array<double>").alias("_x")).where("_x IS NOT NULL")
    names = [*keys, "block", "lane", "n", "mean", "m2"]
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("block", T.IntegerType()), T.StructField("lane", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("n", "mean", "m2"))])

    def rows(held, types, lane):
        for key, moments in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key[:-1], types, strict=True)), pa.array([key[-1]], pa.int32()), pa.array([lane], pa.int32()), *(pa.array([m], pa.list_(pa.float64())) for m in moments)], names)

    def own(batches):
        lane = TaskContext.get().partitionId() % LANES
        held, size, types = {}, 0, None
        for batch in batches:
            types = types or [batch.column(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in keys]
            for r, x in enumerate(batch.column("_x")):
                x = np.array(x.values.to_numpy(zero_copy_only=False), float)
                there = ~np.isnan(x)
                x = np.where(there, x if floor is None else np.maximum(x, floor), 0.0)
                for block, a in enumerate(range(0, len(x), MOMENT_VOXELS)):
                    key = (*(c[r] for c in columns), block)
                    part = slice(a, a + MOMENT_VOXELS)
                    new = [there[part].astype(float), x[part], np.zeros(len(x[part]))]
                    size += 0 if key in held else 3 * len(new[0])
                    held[key] = _merge(held.get(key), new)
                if size > MOMENT_HELD:
                    yield from rows(held, types, lane)
                    held, size = {}, 0
        yield from rows(held, types, lane)

    def met(batches):
        held, types, lane = {}, None, 0
        for batch in batches:
            types = types or [batch.column(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in [*keys, "block", "lane"]]
            moments = [batch.column(c) for c in ("n", "mean", "m2")]
            for r in range(len(batch)):
                key = tuple(c[r] for c in columns)
                held[key] = _merge(held.get(key), [m[r].values.to_numpy(zero_copy_only=False) for m in moments])
        for key, found in held.items():
            yield from rows({key[:-1]: found}, types, key[-1])

    parts = given.mapInArrow(own, schema).repartition(*keys, "block", "lane").mapInArrow(met, schema)
    return parts.withColumn("lane", F.lit(0)).repartition(*keys, "block").mapInArrow(met, schema).drop("lane")


def variation_arrays(tiles: DataFrame, by: Sequence[str], data: str = "data", floor: float | None = 0.0) -> DataFrame:
    """Of each voxel over a group's volumes: ``n``, ``mean``, ``var`` (never below 0) and
    coefficient of variation ``cov``, as arrays a block of voxels."""
    m = array_moments(tiles, by, data, floor)
    var = F.zip_with("m2", "n", lambda s, n: F.when(n > 1, F.greatest(s / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0))))
    mean = F.zip_with("mean", "n", lambda x, n: F.when(n > 0, x))
    m = m.select(*by, "block", F.transform("n", lambda n: n.cast("long")).alias("n"), mean.alias("mean"), var.alias("var"))
    return m.withColumn("cov", F.zip_with("var", "mean", lambda v, x: F.try_divide(F.sqrt(v), F.abs(x))))


def variation_map(cells: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """Mean, variance (never below 0) and coefficient of variation of each voxel, of voxel
    rows: for sparse volumes. ``variation_arrays`` is the form that moves no voxel."""
    v = F.greatest(F.col(value), F.lit(0.0))
    sums = cells.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.greatest(F.var_samp(v), F.lit(0.0)).alias("var"))
    return sums.withColumn("cov", F.try_divide(F.sqrt("var"), F.abs("mean")))


def brain_variation(cov_map: DataFrame, by: Sequence[str], low: float = 20.0, high: float = 100.0) -> DataFrame:
    """Mean coefficient over voxels whose mean lies between the bounds, both open."""
    return cov_map.where((F.col("mean") > low) & (F.col("mean") < high)).groupBy(*by).agg(F.count("cov").alias("n_voxels"), F.avg("cov").alias("mean_cov"))
