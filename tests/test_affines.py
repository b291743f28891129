"""Affines and dimensions in columns, against numpy; unusable ones are NULL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import affines as af
from tessera.operators import geometry as geo


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(0)
    rows = []
    for n in range(24):
        a, b = np.eye(4), np.eye(4)
        a[:3], b[:3] = r.normal(size=(3, 4)), r.normal(size=(3, 4))
        rows.append((n, a.ravel().tolist(), b.ravel().tolist(), [int(x) for x in r.integers(2, 9, 3)]))
    df = spark.createDataFrame(rows, "n int, a array<double>, b array<double>, dim array<int>")
    (grown, dims), (low, high), (up, shape) = af.resized("a", "dim", (1.5, 0, 2)), af.corners_box("a", "dim"), af.upright("a", "dim")
    columns = {"p": af.product("a", "b"), "l": af.left_divide("a", "b"), "r": af.right_divide("a", "b"), "d": af.determinant("a"), "o": af.upright_origin("a", "dim"), "g": grown, "gd": dims, "lo": low, "hi": high, "ua": up, "ud": shape, "t": af.translated("a", (1, 2, 3)), "s": af.slice_at("a", (0.1, 0.2, 0.3), "dim"), "v": af.voxel_size("a")}
    return df, rows, columns


def test_equal_numpy(made):
    df, rows, columns = made
    out = df.select("n", *(c.alias(n) for n, c in columns.items())).orderBy("n").collect()
    for x, (_, a, b, dim) in zip(out, rows, strict=True):
        a, b = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
        (grown, dims), (low, high), (up, shape) = geo.resized(a, dim, (1.5, 0, 2)), geo.corners_box(a, dim), geo.upright(a, dim)
        want = {"p": a @ b, "l": np.linalg.solve(a, b), "r": a @ np.linalg.inv(b), "d": [np.linalg.det(a[:3, :3])], "o": geo.reset_origin(a, dim)[0], "g": grown, "gd": dims, "lo": low, "hi": high, "ua": up, "ud": shape, "t": geo.translated(a, (1, 2, 3)), "s": geo.slice_at(a, (0.1, 0.2, 0.3), dim), "v": geo.voxel_size(a)}
        for name, value in want.items():
            np.testing.assert_allclose(np.ravel(np.array(x[name], float)), np.ravel(value), atol=1e-8, err_msg=name)


def test_unusable_matrices_are_null(spark, made):
    _, rows, columns = made
    zeros = [0.0] * 15 + [1.0]
    odd = [(0, None, rows[0][2], [3, 3, 3]), (1, [1.0] * 5, rows[0][2], [3, 3, 3]), (2, [float("nan"), *rows[0][1][1:]], rows[0][2], [3, 3, 3]), (3, [None, *rows[0][1][1:]], rows[0][2], [3, 3, 3])]
    df = spark.createDataFrame(odd, "n int, a array<double>, b array<double>, dim array<int>")
    for r in df.select(*(c.alias(n) for n, c in columns.items())).collect():
        assert all(v is None for v in r), r
    singular = spark.createDataFrame([(0, zeros, zeros, [3, 3, 3])], "n int, a array<double>, b array<double>, dim array<int>")
    r = singular.select(*(c.alias(n) for n, c in columns.items())).first()
    assert r.l is None and r.r is None and r.g is None and r.s is None and r.p is not None and r.d == 0.0
    none = spark.createDataFrame([(0, rows[0][1], rows[0][2], None)], "n int, a array<double>, b array<double>, dim array<int>")
    r = none.select(*(c.alias(n) for n, c in columns.items())).first()
    assert r.o is None and r.gd is None and r.lo is None and r.ud is None and r.s is None and r.p is not None


def test_literal_matrices(spark):
    m = np.array([[1.0, 2, 3, 4], [0, 1, 5, 6], [0, 0, 2, 7], [0, 0, 0, 1]])
    r = spark.range(1).select(af.product(m, m).alias("p"), af.inverse(m.ravel()).alias("i"), F.array(*map(F.lit, (1.0, 2.0))).alias("x")).first()
    np.testing.assert_allclose(r.p, (m @ m).ravel())
    np.testing.assert_allclose(r.i, np.linalg.inv(m).ravel(), atol=1e-12)
    with pytest.raises(ValueError):
        af.as_matrix([1.0, 2.0])


def test_voxels_of_places_and_view(spark):
    df = spark.createDataFrame([(p, [3, 2, 4]) for p in range(24)], "p int, dim array<int>")
    got = [tuple(r) for r in df.orderBy("p").select(*af.voxel_of(F.col("p"), "dim")).collect()]
    assert got == [(i, j, k) for k in range(1, 5) for j in range(1, 3) for i in range(1, 4)]
    at = spark.createDataFrame([([1.0, 1.0, 1.0],), ([2.99, 1.5, 3.9],), ([3.0, 1.0, 1.0],), ([0.99, 1.0, 1.0],), (None,)], "p array<double>")
    assert [r[0] for r in at.select(af.in_view(F.col("p"), (3, 2, 4))).collect()] == [True, True, False, False, False]
