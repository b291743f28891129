"""Bricks with halos against whole volumes."""

import numpy as np
import pytest

from tessera.operators import bricks, cleanup
from tessera.operators import tiles as tl

DIMS = [(7, 9, 5), (4, 4, 4), (1, 6, 3), (8, 2, 2)]


def table(spark, seed=0, low=-1.0):
    r = np.random.default_rng(seed)
    rows = [(n, list(d), r.uniform(low, 1, int(np.prod(d))).tolist()) for n, d in enumerate(DIMS)]
    return spark.createDataFrame(rows, "id int, dim array<int>, data array<double>").repartition(3)


def values(df, column="data"):
    return {r.id: np.array(r[column]) for r in df.collect()}


@pytest.mark.parametrize("size", [(3, 2, 4), (1, 1, 1), (64, 64, 64)])
def test_cut_and_whole(spark, size):
    t = table(spark)
    cut = bricks.cut(t, ["id"], ["data"], "dim", size)
    assert cut.count() == sum(int(np.prod([-(-n // s) for n, s in zip(d, size, strict=True)])) for d in DIMS)
    got, want = values(bricks.whole(cut, ["id"], ["data"])), values(t)
    assert all((got[n] == want[n]).all() for n in want)


@pytest.mark.parametrize("size", [(3, 2, 4), (2, 2, 2)])
def test_stencils_equal_those_of_whole_volumes(spark, size):
    t = table(spark, 1)
    cut = bricks.cut(t, ["id"], ["data"], "dim", size)
    for taps in ((0.3, 0.4, 0.3), (0.05, 0.1, 0.2, 0.3, 0.2, 0.1, 0.05)):  # the second one's reach is beyond the bricks
        got, want = values(bricks.whole(bricks.convolve(cut, ["id"], taps), ["id"], ["data"])), values(tl.convolve(t, "dim", taps))
        assert all(np.allclose(got[n], want[n]) for n in want)
    got, want = values(bricks.whole(bricks.surface(cut, ["id"], 0.0), ["id"], ["surface"]), "surface"), values(tl.surface(t, "dim", 0.0), "surface")
    assert all((got[n] == want[n]).all() for n in want)


@pytest.mark.parametrize("halo,rounds", [(2, 5), (8, 32)])
def test_clean_up_equals_that_of_whole_volumes(spark, monkeypatch, halo, rounds):
    monkeypatch.setattr(cleanup, "ROUNDS", rounds)
    r = np.random.default_rng(3)
    dim = (9, 7, 6)
    p = r.dirichlet((0.5, 1.0, 0.4, 0.2), int(np.prod(dim)))
    rows = [(1, list(dim), *p.T.tolist()), (2, list(dim), *p[::-1].T.tolist())]
    df = spark.createDataFrame(rows, "id int, dim array<int>, gm array<double>, wm array<double>, csf array<double>, bone array<double>")
    names = ["gm", "wm", "csf", "bone"]
    out = bricks.clean(bricks.cut(df, ["id"], names, "dim", (4, 4, 4)), ["id"], others=["bone"], halo=halo, rounds=rounds)
    got = {x.id: x for x in bricks.whole(out, ["id"], names).collect()}
    for n, _, *classes in rows:
        stack = np.stack([np.array(c).reshape(dim, order="F") for c in classes], axis=-1)
        want = cleanup.clean_tissue(stack)
        for k, c in enumerate(names):
            np.testing.assert_allclose(got[n][c], want[..., k].ravel(order="F"), atol=1e-12)


def test_rows_without_a_volume_have_no_bricks(spark):
    rows = [(1, [2, 2, 2], None), (2, None, [1.0]), (3, [2, 2, 2], [1.0] * 7), (4, [1, 2, 1], [None, 2.0]), (None, [1, 1, 1], [5.0])]
    cut = bricks.cut(spark.createDataFrame(rows, "id int, dim array<int>, data array<double>"), ["id"], ["data"], "dim", (1, 1, 1))
    assert sorted((r.id or 0, tuple(r.at), r.data[0]) for r in cut.collect()) == [(0, (0, 0, 0), 5.0), (4, (0, 0, 0), 0.0), (4, (0, 1, 0), 2.0)]
    assert bricks.convolve(cut.where("id > 9"), ["id"], (0.3, 0.4, 0.3)).collect() == []
    assert values(bricks.whole(bricks.convolve(cut.where("id = 4"), ["id"], (0.25, 0.5, 0.25)), ["id"], ["data"]))[4].tolist() == [0.125, 0.25]


def test_bricks_of_a_shape_are_worked_on_at_once(spark, tmp_path):
    """All bricks of a task by their shapes, without voxels beyond the volume."""
    r = np.random.default_rng(8)
    rows = [(n, [4, 4, 4], r.uniform(-1, 1, 64).tolist()) for n in range(50)]
    cut = bricks.cut(spark.createDataFrame(rows, "id int, dim array<int>, data array<double>").coalesce(1), ["id"], ["data"], "dim", (2, 4, 2))
    log = str(tmp_path / "shapes")

    def work(arrays, inside):
        with open(log, "a") as f:
            f.write(f"{arrays['data'].shape}\n")
        return {"data": arrays["data"] * inside}

    conf = "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "1")
    try:
        got = values(bricks.whole(bricks.exchange(cut, ["id"], ["data"], 4, work, ["data"]), ["id"], ["data"]))
    finally:
        spark.conf.set(conf, before)
    assert all(got[n].tolist() == x for n, _, x in rows)
    shapes = [eval(x) for x in open(log)]
    assert sum(x[0] for x in shapes) == 200 and len(shapes) <= 4 and {x[1:] for x in shapes} == {(4, 4, 4)}
