"""Tables laid out by slice, and table functions in SQL."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.sources import slices

DIM = [16, 12, 10]
AFFINE = [2.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0, -1.0, 0.0, 0.0, 4.0, 0.5, 0.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("slices") / "t")
    r = np.random.default_rng(1)
    rows = [(n, DIM, r.normal(size=1920).tolist()) for n in range(60)] + [(100, DIM, [1.0]), (101, None, [1.0]), (102, DIM, None), (103, [1, 1, 2], [5.0, None])]
    df = spark.createDataFrame(rows, "id int, dim array<int>, data array<double>")
    slices.save_slices(df, path, ["id"], "dim", group_bytes=64 << 10)
    return path, rows


def test_slices_hold_the_planes(spark, stored):
    path, rows = stored
    got = {(r.id, r.k): r.data for r in slices.read_slices(spark, path).collect()}
    assert len(got) == 60 * 10 + 2
    for n, _, data in rows[:60]:
        assert all(got[n, k] == data[192 * (k - 1) : 192 * k] for k in range(1, 11))
    assert got[103, 1] == [5.0] and got[103, 2] == [None]
    cells = {(r.i, r.j): r.v for r in slices.slice_voxels(slices.read_slices(spark, path, 4).where("id = 7"), ["id"]).collect()}
    assert cells == {(p % 16 + 1, p // 16 + 1): v for p, v in enumerate(rows[7][2][576:768])}
    assert {r.k for r in slices.read_slices(spark, path, [2, 9]).select("k").distinct().collect()} == {2, 9}


def test_one_slice_is_a_share_of_the_bytes(spark, stored):
    """Row groups whose statistics leave the slice in, against all; and Spark reads those."""
    path, _ = stored
    groups = []
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(f"{path}/{f}").metadata
            for g in range(meta.num_row_groups):
                column = next(c for c in (meta.row_group(g).column(n) for n in range(meta.num_columns)) if c.path_in_schema == "k")
                groups.append((column.statistics.min, column.statistics.max, meta.row_group(g).total_byte_size, meta.row_group(g).num_rows))
    total = sum(g[2] for g in groups)
    held = [g for g in groups if g[0] <= 6 <= g[1]]
    assert len(groups) >= 8 and sum(g[2] for g in held) < total / 3
    plan = slices.read_slices(spark, path, 6)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,6)]" in plan


def test_table_functions_in_sql(spark):
    tables.register(spark)
    rows = [(1, [2, 1, 2], AFFINE, [1.0, 2.0, None, 4.0]), (2, None, AFFINE, [1.0]), (3, [2, 2], AFFINE, [1.0]), (4, [1, 1, 1], AFFINE[:3], [9.0]), (5, [1, 1, 1], AFFINE, [float("nan")])]
    spark.createDataFrame(rows, "id int, dim array<int>, m array<double>, data array<double>").createOrReplaceTempView("volumes_of_test")
    grid = [tuple(r) for r in spark.sql("SELECT id, g.* FROM volumes_of_test, LATERAL voxel_grid(dim, m) g WHERE id <> 5 ORDER BY k, j, i").collect()]
    assert grid == [(1, i, 1, k, 2.0 * i + 1, 2.0, 4.0 * k + 0.5) for k in (1, 2) for i in (1, 2)]
    corners = spark.sql("SELECT id, min(x) lo, max(z) hi, count(*) n FROM volumes_of_test, LATERAL corner_points(dim, m) GROUP BY id ORDER BY id").collect()
    assert [tuple(r) for r in corners] == [(1, 3.0, 8.5, 8), (5, 3.0, 4.5, 8)]
    cut = spark.sql("SELECT id, s.* FROM volumes_of_test, LATERAL slice_values(data, dim, 2) s").collect()
    assert [tuple(r) for r in cut] == [(1, 1, 1, None), (1, 2, 1, 4.0)]
    bins = spark.sql("SELECT id, b.* FROM volumes_of_test, LATERAL histogram_bins(data, 1.0D, 3.0D, 2) b WHERE id IN (1, 5)").collect()
    assert sorted(map(tuple, bins)) == [(1, 1, 1), (1, 2, 2), (5, 1, 0), (5, 2, 0)]
    one = spark.sql("SELECT * FROM histogram_bins(array(1.0D, 1.0D), 1.0D, 1.0D, 2)").orderBy(F.col("bin")).collect()
    assert [r.n for r in one] == [2, 0]
