"""Volumes in two layouts, and what works on one voxel at a time.

*Tile form* has a row a volume (or slab) with its values in an array, first axis fastest;
*cell form* has a row a voxel with 1-based ``i, j, k``. Element-wise work stays in tile form:
one row in, one row out, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import array_sum, clamp, not_nan


def to_cells(tiles: DataFrame, dim: Sequence[int] | str, keys: Sequence[str], data: str = "data", value: str = "v") -> DataFrame:
    """A row a voxel; NaN becomes NULL, values are double. Dimensions are literals or in a
    column; a volume without any has no voxels."""
    nx, ny = (F.get(dim, F.lit(n)) if isinstance(dim, str) else F.lit(int(dim[n])) for n in range(2))
    held = tiles.select(*keys, nx.alias("_nx"), ny.alias("_ny"), data) if isinstance(dim, str) else tiles
    cells = held.select(*keys, *(("_nx", "_ny") if isinstance(dim, str) else ()), F.posexplode(data).alias("_p", "_v"))
    if isinstance(dim, str):
        nx, ny, cells = F.col("_nx"), F.col("_ny"), cells.where("_nx IS NOT NULL AND _ny IS NOT NULL")
    return cells.select(
        *keys,
        (F.col("_p") % nx + 1).cast("int").alias("i"),
        (F.floor(F.col("_p") / nx) % ny + 1).cast("int").alias("j"),
        (F.floor(F.col("_p") / (nx * ny)) + 1).cast("int").alias("k"),
        not_nan(F.col("_v").cast("double")).alias(value),
    )


def to_tiles(cells: DataFrame, dim: Sequence[int] | str, keys: Sequence[str], value: str = "v", data: str = "data") -> DataFrame:
    """A row a volume; voxels that are absent are NULL. Dimensions are literals or in a
    column, which then stays."""
    nx, ny, nz = (F.get(dim, F.lit(n)) if isinstance(dim, str) else F.lit(int(dim[n])) for n in range(3))
    own = [dim] if isinstance(dim, str) else []
    at = (F.col("i") - 1 + nx * (F.col("j") - 1 + ny * (F.col("k") - 1))).cast("int")
    held = cells.groupBy(*keys, *own).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("p"), F.col(value)))).alias("_m"))
    return held.select(*keys, *own, F.transform(F.sequence(F.lit(0), nx * ny * nz - 1), lambda p: F.try_element_at("_m", p)).alias(data))


def linear_index(i: Column, j: Column, k: Column, dim: Sequence[int]) -> Column:
    """0-based place of a voxel, first axis fastest."""
    return ((i - 1) + dim[0] * ((j - 1) + dim[1] * (k - 1))).cast("int")


def doubles(data: Column) -> Column:
    return F.transform(data, lambda x: not_nan(x.cast("double")))


def map_voxels(tiles: DataFrame, f: Callable[[Column], Column], data: str = "data") -> DataFrame:
    return tiles.withColumn(data, F.transform(data, f))


def mask_assign(data: Column, mask: Column, other: float = 0.0) -> Column:
    """Values outside the mask replaced; a missing mask value is outside."""
    return F.zip_with(data, mask, lambda v, m: F.when(F.coalesce(m, F.lit(False)), v).otherwise(F.lit(other)))


def count_where(data: Column, test: Callable[[Column], Column]) -> Column:
    """How many values pass; NULL passes nothing."""
    return F.size(F.filter(data, lambda x: F.coalesce(test(x), F.lit(False)))).cast("long")


def value_range(tiles: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    return tiles.select(*keys, F.array_min(data).alias("v_min"), F.array_max(data).alias("v_max"))


def quantise(data: Column, kind: str) -> tuple[Column, Column]:
    """Integers and the slope that turns them back, for 'uint8' or 'int16'.

    The slope makes the largest finite value the type's largest (for int16 the smallest is
    looked at too). Values are rounded half away from 0 and cut to the type's range; values
    that are not finite become 0, and slope 0 (no value above 0) makes all 0.
    """
    finite = F.filter(data, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    top, bottom = F.coalesce(F.array_max(finite), F.lit(0.0)), F.coalesce(F.array_min(finite), F.lit(0.0))
    if kind == "uint8":
        slope, low, high = top / 255.0, 0, 255
    elif kind == "int16":
        slope, low, high = F.greatest(top / 32767.0, -bottom / 32768.0), -32768, 32767
    else:
        raise ValueError(f"no such type: {kind}")
    slope = F.greatest(slope, F.lit(0.0))

    def whole(x: Column) -> Column:
        finite_x = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
        q = F.round(F.try_divide(finite_x, slope))
        return F.when(q.isNotNull(), clamp(q, float(low), float(high))).otherwise(0.0).cast("int")

    return F.transform(data, whole), slope


def dequantise(data: Column, slope: Column) -> Column:
    return F.transform(data, lambda x: x * slope)


def skull_strip(p: Column, value: Column, classes: Sequence[int] = (1, 2, 3), least: float = 0.5) -> Column:
    """The value where the classes together reach ``least``, else 0."""
    return F.when(sum((F.element_at(p, c) for c in classes), F.lit(0.0)) >= least, value).otherwise(0.0)


def inside_mask(p: Column, classes: Sequence[int] = (1, 2, 3), above: float = 0.5) -> Column:
    """Whether the classes together lie above the threshold."""
    return sum((F.element_at(p, c) for c in classes), F.lit(0.0)) > above


def class_sum(p: Column, classes: Sequence[int]) -> Column:
    return sum((F.element_at(p, c) for c in classes), F.lit(0.0))


def final_gate(b: Column, c: Column, p: Column, above: float = 0.05, eps: float = 2.220446049250313e-16) -> Column:
    """The clean-up's last step on one voxel: grey and white matter go where the grown mask
    does not support them, then fluid by what is left, then all classes are renormalised."""
    gm, wm, csf = (F.element_at(p, i) for i in (1, 2, 3))
    keep = F.when((b > above) & (gm + wm > above), 1.0).otherwise(0.0)
    gm2, wm2 = gm * keep, wm * keep
    csf2 = csf * F.when((c > above) & (gm2 + wm2 + csf > above), 1.0).otherwise(0.0)
    rest = F.slice(p, 4, F.size(p) - 3)
    gated = F.concat(F.array(gm2, wm2, csf2), rest)
    total = array_sum(gated) + eps
    return F.transform(gated, lambda x: x / total)


def slice_cells(tiles: DataFrame, k: int | Column, dim: Sequence[int] | str, keys: Sequence[str], data: str = "data", value: str = "v") -> DataFrame:
    """A row a voxel of slice ``k`` (a literal or each row's own) and of no other: the slice
    is cut out of the array before it becomes rows. A slice that a volume lacks has none."""
    nx, ny = (F.get(dim, F.lit(n)) if isinstance(dim, str) else F.lit(int(dim[n])) for n in range(2))
    at = F.lit(int(k)) if isinstance(k, int) else k
    shape = [dim] if isinstance(dim, str) else []
    cut = F.when((at >= 1) & ((at - 1) * nx * ny < F.size(data)), F.slice(data, F.greatest((at - 1) * nx * ny, F.lit(0)) + 1, nx * ny))
    rows = tiles.select(*keys, *shape, at.cast("int").alias("_k"), cut.alias(data))
    own = dim if isinstance(dim, str) else [*dim[:2], 1]
    return to_cells(rows, own, [*keys, "_k"], data, value).select(*keys, "i", "j", F.col("_k").alias("k"), value)


def rotate_slice(cells: DataFrame, k: int, nx: int) -> DataFrame:
    """One slice, turned by 90 degrees: (i, j) comes to (j, nx - i + 1)."""
    return cells.where(F.col("k") == k).select("*", F.col("j").alias("row"), (F.lit(nx) - F.col("i") + 1).cast("int").alias("col"))


def overlay(grey: Column, layers: Sequence[tuple[Column, tuple[float, float, float]]], alpha: float = 0.5) -> Column:
    """Grey values with coloured masks laid over them one after the other, as r, g, b."""
    channels = []
    for c in range(3):
        shown = grey
        for mask, colour in layers:
            shown = F.when(mask, (1 - alpha) * shown + alpha * colour[c]).otherwise(shown)
        channels.append(shown)
    return F.array(*channels)
