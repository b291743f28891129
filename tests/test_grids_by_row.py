"""Volumes of one table with their own dimensions and affines, and rows that don't fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as geo
from tessera.operators import tiles as tl
from tessera.operators import volumes as vol

SCHEMA = "id int, data array<double>, dim array<int>, m array<double>"
EYE = np.eye(4).ravel().tolist()


def volume(dim, start=0.0):
    return [start + x for x in range(int(np.prod(dim)))]


def test_unequal_lengths_are_not_mixed(spark):
    """64 and 128 values in one batch: each volume comes back as it is."""
    rows = [(1, volume((4, 4, 4)), [4, 4, 4], EYE), (2, volume((4, 4, 8), 1000.0), [4, 4, 8], EYE), (3, volume((4, 4, 4), 5000.0), [4, 4, 4], EYE)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r.id: r for r in tl.pull(df, "m", "dim").collect()}
    assert all(got[r[0]].data == r[1] and got[r[0]].error is None for r in rows)
    literal = {r.id: r for r in tl.pull(df, np.eye(4), (4, 4, 4)).collect()}
    assert literal[1].data == rows[0][1] and literal[3].data == rows[2][1]
    assert literal[2].data is None and literal[2].error == "data does not fit its grid"


def test_rows_that_cannot_be_worked_on_say_why(spark):
    good = volume((2, 2, 2))
    rows = [(1, good, [2, 2, 2], EYE), (2, None, [2, 2, 2], EYE), (3, good, None, EYE), (4, good, [2, 2], EYE), (5, good, [2, 0, 2], EYE), (6, good, [2, 2, None], EYE), (7, good, [2, 2, 2], None), (8, good, [2, 2, 2], EYE[:15]), (9, good[:7], [2, 2, 2], EYE), (10, [], [2, 2, 2], EYE), (11, [None, *good[1:]], [2, 2, 2], EYE)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for out in (tl.pull(df, "m", "dim"), tl.push(df, "m", "dim")):
        got = {r.id: (r.data, r.error) for r in out.collect()}
        assert got[1] == (good, None)
        assert got[2] == (None, "data is missing")
        assert all(got[n] == (None, "unusable dimensions") for n in (3, 4, 5, 6))
        assert all(got[n] == (None, "unusable affine") for n in (7, 8))
        assert all(got[n] == (None, "data does not fit its grid") for n in (9, 10))
        assert got[11][0] is not None and got[11][0][1:] == good[1:]
    assert tl.convolve(df.limit(0), "dim", (0.3, 0.4, 0.3)).collect() == []


def test_first_error_stays(spark):
    df = spark.createDataFrame([(1, volume((2, 2, 2)), [2, 2, 2], EYE, "earlier"), (2, [1.0], [2, 2, 2], EYE, None)], SCHEMA + ", error string")
    got = {r.id: r.error for r in tl.surface(tl.convolve(df, "dim", (0.3, 0.4, 0.3)), "dim").collect()}
    assert got == {1: "earlier", 2: "data does not fit its grid"}


@pytest.mark.parametrize("order", [0, 1])
def test_pull_equals_one_volume_at_a_time(spark, order):
    r = np.random.default_rng(order)
    rows = []
    for n in range(30):
        dim = [int(x) for x in r.integers(1, 6, 3)]
        m = np.eye(4)
        m[:3] += r.normal(0, 0.4, (3, 4))
        rows.append((n, r.normal(size=int(np.prod(dim))).tolist(), dim, m.ravel().tolist(), [int(x) for x in r.integers(1, 6, 3)]))
    df = spark.createDataFrame(rows, SCHEMA + ", new array<int>")
    got = {x.id: x.data for x in tl.pull(df, "m", "dim", "new", order=order).collect()}
    for n, data, dim, m, new in rows:
        image = np.array(data).reshape(dim, order="F")
        want = []
        for k in range(1, new[2] + 1):
            for j in range(1, new[1] + 1):
                for i in range(1, new[0] + 1):
                    p = (np.reshape(m, (4, 4)) @ [i, j, k, 1])[:3]
                    if order == 0:
                        q = np.floor(p + 0.5).astype(int)
                        want.append(image[tuple(q - 1)] if (q >= 1).all() and (q <= dim).all() else 0.0)
                    else:
                        total, low = 0.0, np.floor(p).astype(int)
                        for bits in np.ndindex(2, 2, 2):
                            q = low + bits
                            if (q >= 1).all() and (q <= dim).all():
                                total += image[tuple(q - 1)] * np.prod([f if b else 1 - f for b, f in zip(bits, p - low, strict=True)])
                        want.append(total)
        np.testing.assert_allclose(got[n], want, atol=1e-9)


def test_deformations_of_mixed_grids(spark):
    """Composing with the identity changes nothing, and an inverse undoes a shift, in each
    volume's own grid; a singular affine has no inverse."""
    rows = []
    for n, dim in enumerate([(4, 5, 6), (6, 4, 4), (5, 5, 5)]):
        m = np.diag([1.0 + n, 2.0, 0.5 + n, 1.0])
        m[:3, 3] = (n, -n, 2.0)
        w = np.stack(tl.grid_places(m, dim))
        moved = w + np.array([[1.0 + n], [0.0], [0.0]])  # one voxel along x
        rows.append((n, list(dim), m.ravel().tolist(), *w.tolist(), *moved.tolist()))
    rows.append((9, [2, 2, 2], [0.0] * 15 + [1.0], *[[0.0] * 8] * 6))
    df = spark.createDataFrame(rows, "id int, dim array<int>, m array<double>, wx array<double>, wy array<double>, wz array<double>, ox array<double>, oy array<double>, oz array<double>").coalesce(1)
    for r in tl.compose(df, "dim", "m").where("id < 9").collect():
        inside = np.arange(len(r.ox)) % r.dim[0] < r.dim[0] - 1
        np.testing.assert_allclose(np.array(r.wx, float)[inside], np.array(r.ox)[inside])
        np.testing.assert_allclose(np.array(r.wz, float)[inside], np.array(r.oz)[inside])
    back = {r.id: r for r in tl.inverse(df, "dim", "m", "m", field=("ox", "oy", "oz")).collect()}
    for n, dim, _, wx, *_ in rows[:3]:
        first = np.arange(len(wx)) % dim[0] > 0  # the target's first voxels are reached by none
        np.testing.assert_allclose(np.array(back[n].wx, float)[first], np.array(wx)[first] - (1.0 + n))
    assert all(x is None for x in back[9].wx)


def test_cells_of_mixed_volumes_and_back(spark):
    rows = [(1, volume((2, 3, 2)), [2, 3, 2], EYE), (2, volume((3, 1, 2)), [3, 1, 2], EYE), (3, volume((2, 2, 2)), None, EYE)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = vol.to_cells(df, "dim", ["id", "dim"])
    assert {(r.i, r.j, r.k): r.v for r in cells.where("id = 2").collect()} == {(i, 1, k): float(i - 1 + 3 * (k - 1)) for i in (1, 2, 3) for k in (1, 2)}
    back = {r.id: r.data for r in vol.to_tiles(cells.where("v <> 4"), "dim", ["id"]).collect()}
    assert back == {1: [None if x == 4 else x for x in rows[0][1]], 2: [None if x == 4 else x for x in rows[1][1]]}


def test_affine_as_a_column_in_cell_form(spark):
    m = np.diag([2.0, 1.0, 1.0, 1.0])
    df = spark.createDataFrame([(1, 2, 3, 4, m.ravel().tolist())], "id int, i int, j int, k int, m array<double>")
    assert tuple(df.select(*(c.alias(n) for c, n in zip(geo.affine_columns(F.col("m")), "xyz", strict=True))).first()) == (4.0, 3.0, 4.0)


def test_a_point_meets_its_eight_voxels_in_one_row(spark):
    image = spark.createDataFrame([(1, 1, 1, 1, 2.0), (1, 2, 1, 1, 4.0), (1, 1, 2, 1, float("inf")), (1, 2, 2, 2, None)], "n int, i int, j int, k int, v double")
    points = spark.createDataFrame([(1, 0, 1.25, 1.0, 1.0), (1, 1, 0.5, 1.0, 0.5), (1, 2, None, 1.0, 1.0), (1, 3, 7.0, 7.0, 7.0), (2, 4, 1.0, 1.0, 1.0), (1, 5, 2.0, 1.0, 1.0)], "n int, p int, x double, y double, z double")
    out = geo.pull(points, image, ["n"])
    assert {r.p: r.v for r in out.collect()} == pytest.approx({0: 2.5, 1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 4.0})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
