"""Moments of arrays merged in any order, and distances by lower envelopes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics


def brute_distance(mask, size):
    at = np.argwhere(mask) * np.array(size)
    out = np.full(mask.shape, np.inf)
    if len(at):
        for n in np.ndindex(mask.shape):
            out[n] = ((at - np.array(n) * np.array(size)) ** 2).sum(axis=1).min()
    return out


@pytest.mark.parametrize("seed", range(6))
def test_squared_distances_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    shape = tuple(int(n) for n in r.integers(1, 9, 3))
    size = tuple(r.choice([0.5, 1.0, 1.7, 3.0], 3))
    mask = r.random(shape) < [0.02, 0.1, 0.3, 0.6, 0.95, 0.0][seed]
    np.testing.assert_allclose(metrics.squared_distance(mask, size), brute_distance(mask, size))
    many = r.random((4, *shape)) < 0.1
    many[2] = False
    np.testing.assert_allclose(metrics.squared_distance(many, size), [brute_distance(m, size) for m in many])


def test_distance_time_grows_with_the_voxels():
    """Lines of 20,000 voxels: all pairs of a line's places would be 4 x 10^8 a line."""
    mask = np.zeros((1, 4, 20_000), bool)
    mask[0, 1, [0, 7000, 19_999]] = True
    d = np.sqrt(metrics.squared_distance(mask, (1.0, 1.0, 1.0)))
    assert d[0, 1, 3500] == 3500 and d[0, 0, 7000] == 1 and d[0, 1, 13_499] == 6499 and d[0, 3, 19_999] == 2
    full = np.ones((1, 3, 20_000), bool)
    assert not metrics.squared_distance(full, (1.0, 1.0, 1.0)).any()


def plain_moments(rows, floor=None):
    longest = max(len(x) for x in rows)
    x = np.full((len(rows), longest), np.nan)
    for n, row in enumerate(rows):
        x[n, : len(row)] = [np.nan if v is None else v for v in row]
    x = x if floor is None else np.where(np.isnan(x), x, np.maximum(x, floor))
    n = (~np.isnan(x)).sum(axis=0)
    with np.errstate(all="ignore"):
        mean = np.where(n > 0, np.nansum(x, axis=0) / n, 0)
    return n, mean, np.nansum((x - mean) ** 2, axis=0)


@pytest.mark.parametrize("block,held,floor", [(1 << 16, 1 << 24, None), (3, 10, 0.0), (7, 1, -0.5)])
def test_moments_of_arrays(spark, monkeypatch, block, held, floor):
    """Few voxels a block, tasks that hand on at once, uneven lengths, missing values."""
    monkeypatch.setattr(metrics, "MOMENT_VOXELS", block)
    monkeypatch.setattr(metrics, "MOMENT_HELD", held)
    monkeypatch.setattr(metrics, "LANES", 3)
    r = np.random.default_rng(block)
    data = {g: [[None if r.random() < 0.2 else float(v) for v in r.normal(1e6 if g == "far" else 0, 1, r.integers(1, 12))] for _ in range(17)] for g in ("near", "far")}
    rows = [(g, x) for g, xs in data.items() for x in xs] + [("near", None), ("none", None), (None, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "g string, data array<double>").repartition(8)
    out = metrics.array_moments(df, ["g"], "data", floor).orderBy("g", "block").collect()
    assert {x.g for x in out} == {"near", "far", None}
    for g, xs in (*data.items(), (None, [[1.0, None]])):
        own = [x for x in out if x.g == g]
        assert [x.block for x in own] == list(range(len(own)))
        n, mean, m2 = plain_moments(xs, floor)
        np.testing.assert_array_equal(np.concatenate([x.n for x in own]), n)
        np.testing.assert_allclose(np.concatenate([x.mean for x in own]), mean, rtol=1e-9)
        np.testing.assert_allclose(np.concatenate([x.m2 for x in own]), m2, rtol=1e-6, atol=1e-8)


def test_variation_of_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, -4.0, None]), (1, [3.0, -2.0, None]), (2, [5.0])], "g int, data array<double>")
    got = {r.g: r for r in metrics.variation_arrays(df, ["g"]).collect()}
    assert got[1].n == [2, 2, 0] and got[1].mean == [2.0, 0.0, None] and got[1].var == [2.0, 0.0, None]
    assert got[1].cov == [pytest.approx(2**0.5 / 2), None, None]
    assert got[2].n == [1] and got[2].var == [None] and got[2].cov == [None]
    assert metrics.variation_arrays(df.where("g > 5"), ["g"]).count() == 0


def test_no_voxel_rows_are_exchanged(spark, sf_dir):
    """Rows in the exchanges are of groups, blocks and tasks."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("embedding").cast("array<double>").alias("data"))
    moments = metrics.array_moments(df, ["label"])
    assert "Generate" not in moments._jdf.queryExecution().toString()
    assert moments.count() == df.select("label").distinct().count()


def test_dice_of_unequal_lengths_is_null(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0], [1.0, 0.0])], "g int, a array<double>, b array<double>")
    assert {r.g: r.dice for r in metrics.dice_tiles(df, ["g"], "a", "b").collect()} == {1: 1.0, 2: None}
