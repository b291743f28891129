"""Volumes stored by slice, so that reading one slice reads little of the table.

A stored row is a slice of a volume: its number ``k`` (1-based), the volume's keys, the plane
``nx, ny`` and the values. Files are ranges of ``k`` and, within it, of the volumes' keys, rows
in that order in row groups of bounded size, so that the statistics of ``k`` (and of the
first key) leave row groups out: one slice of all volumes, or a few volumes' own, is read
from a share of the bytes. Volumes of the same number of slices in one range each are not
needed: a volume's slices may lie in several files.

Cases: a volume without its array or whose array does not fit its dimensions has no slices;
missing voxels stay missing; writing replaces the table whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, about: what is read for one slice at least.
GROUP_BYTES = 4 << 20


def to_slices(tiles: DataFrame, keys: Sequence[str], dim: Sequence[int] | str, data: str = "data") -> DataFrame:
    """A row a slice; no voxel is a row."""
    nx, ny, nz = (F.get(dim, F.lit(n)) if isinstance(dim, str) else F.lit(int(dim[n])) for n in range(3))
    fits = tiles.select(*keys, nx.alias("nx"), ny.alias("ny"), nz.alias("_nz"), F.col(data).alias("_x")).where("size(_x) = nx * ny * _nz AND nx > 0 AND ny > 0 AND _nz > 0")
    rows = fits.select(*keys, "nx", "ny", "_x", F.explode(F.sequence(F.lit(1), F.col("_nz"))).alias("k"))
    plane = F.col("nx") * F.col("ny")
    return rows.select("k", *keys, "nx", "ny", F.slice("_x", (F.col("k") - 1) * plane + 1, plane).alias("data"))


def save_slices(tiles: DataFrame, path: str, keys: Sequence[str], dim: Sequence[int] | str, data: str = "data", files: int = 8, group_bytes: int = GROUP_BYTES) -> None:
    """Write volumes by slice, in about so many files."""
    placed = to_slices(tiles, keys, dim, data).repartitionByRange(files, "k", *keys).sortWithinPartitions("k", *keys)
    placed.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def read_slices(spark: SparkSession, path: str, k: int | Sequence[int] | None = None) -> DataFrame:
    """The slices of these numbers, of all volumes; filters on keys prune, too."""
    rows = spark.read.parquet(path)
    if k is None:
        return rows
    return rows.where(F.col("k") == int(k)) if isinstance(k, int) else rows.where(F.col("k").isin([int(n) for n in k]))


def slice_voxels(rows: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """A row a voxel of the slices."""
    def place(p: Column) -> list[Column]:
        return [(p % F.col("nx") + 1).cast("int").alias("i"), (F.floor(p / F.col("nx")) + 1).cast("int").alias("j")]

    cells = rows.select(*keys, "k", "nx", F.posexplode("data").alias("_p", "_v"))
    return cells.select(*keys, *place(F.col("_p")), "k", F.col("_v").cast("double").alias(value))
