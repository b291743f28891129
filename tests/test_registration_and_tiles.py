"""Tile-form operators and reduced fits against plain code and made-up truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import registration as reg
from tessera.operators import tiles as tl

DIM = (18, 16, 14)


def blobs(shift=(0, 0, 0), size=1.0):
    """A volume of a few smooth blobs, first axis fastest."""
    i, j, k = tl.grid_places(np.eye(4), DIM)
    out = np.zeros(i.shape)
    for x, y, z, r, h in ((7, 8, 6, 3, 1.0), (12, 6, 9, 2.2, 0.6), (9, 11, 8, 2.0, -0.5)):
        out += h * np.exp(-((i - x - shift[0]) ** 2 + (j - y - shift[1]) ** 2 + (k - z - shift[2]) ** 2) / (2 * (r * size) ** 2))
    return out


def frame(spark, *columns):
    names = "abcdef"[: len(columns)]
    return spark.createDataFrame([tuple(c.tolist() for c in columns)], ", ".join(f"{n} array<double>" for n in names))


def test_rigid_alignment_finds_a_shift_of_another_contrast(spark):
    fixed, moving = blobs(), 1 - 0.7 * blobs((1.5, -1.0, 0.75)) ** 2
    fixed = fixed**2
    row = reg.register(frame(spark, fixed, moving), "a", "b", DIM, np.eye(4), strides=(2, 1)).first()
    m = np.array(row.matrix).reshape(4, 4)
    centre = np.array([9, 8, 7, 1.0])
    assert (m @ centre)[:3] - centre[:3] == pytest.approx([1.5, -1.0, 0.75], abs=0.35) and row.score[0] > 1.1
    before = reg.mutual_information(fixed, moving)
    assert reg.mutual_information(fixed, np.array(row.resliced)) > before


def test_transforms_have_the_right_turns_and_sizes():
    m = reg.transform([1, 2, 3, 0, 0, np.pi / 2], (5, 5, 5))
    assert m @ [5, 5, 5, 1] == pytest.approx([6, 7, 8, 1]) and np.linalg.det(m[:3, :3]) == pytest.approx(1)
    assert np.linalg.det(reg.transform([0, 0, 0, 0.1, 0.2, 0.3, np.log(2), 0, 0], (0, 0, 0))[:3, :3]) == pytest.approx(2)


def test_demons_bring_shapes_together(spark):
    fixed, moving = blobs(), blobs((1.2, -0.8, 0.5), 1.15)
    pairs = frame(spark, fixed, moving)
    row = tl.pull(reg.deform(pairs, "a", "b", DIM, rounds=40), ("x", "y", "z"), DIM, data="b", out="c").first()
    assert ((np.array(row.c) - fixed) ** 2).sum() < 0.15 * ((moving - fixed) ** 2).sum()


def test_demons_of_classes_fit_all_channels(spark):
    soft = lambda v: np.concatenate([1 / (1 + np.exp(-6 * v)), 1 / (1 + np.exp(6 * v))])
    a, b = soft(blobs()), soft(blobs((1.0, 0.5, -0.5)))
    row = reg.deform(frame(spark, a, b), "a", "b", DIM, channels=2, rounds=40).first()
    places = [np.array(row[c]) for c in "xyz"]
    warped = np.concatenate([reg.sample(x, places, DIM) for x in b.reshape(2, -1)])
    assert ((warped - a) ** 2).sum() < 0.25 * ((b - a) ** 2).sum()


def test_segmentation_sees_through_a_smooth_bias(spark):
    r = np.random.default_rng(4)
    i, j, k = tl.grid_places(np.eye(4), DIM)
    truth = (np.hypot(i - 9, j - 8) < 5).astype(int) + (np.hypot(i - 9, j - 8) < 2.5)
    bias = 0.5 * np.cos(np.pi * (i - 0.5) / DIM[0]) + 0.3 * np.cos(np.pi * (k - 0.5) / DIM[2])
    x = np.array([0.0, 1.0, 2.0])[truth] + bias + r.normal(0, 0.15, len(i))
    prior = np.stack([np.where(truth == c, 0.6, 0.2) for c in range(3)])
    prior[:, r.random(len(i)) < 0.3] = 1 / 3
    row = reg.segment(frame(spark, x, prior.ravel()), "a", "b", DIM, gaussians=(1, 2, 1), degree=2).first()
    found = np.array(row.classes).reshape(3, -1)
    assert (found.argmax(axis=0) == truth).mean() > 0.96 and found.sum(axis=0) == pytest.approx(1)
    assert np.corrcoef(row.bias, bias)[0, 1] > 0.97
    flat, _, _ = reg.mixture(x, prior, (1, 2, 1), np.zeros((0, len(x))))
    assert (flat.argmax(axis=0) == truth).mean() < (found.argmax(axis=0) == truth).mean()


def test_inverse_of_a_smooth_deformation(spark):
    i, j, k = tl.grid_places(np.eye(4), DIM)
    bump = 1.5 * np.exp(-((i - 9) ** 2 + (j - 8) ** 2 + (k - 7) ** 2) / 30)
    f = frame(spark, i + bump, j - 0.5 * bump, k + 0.3 * bump).toDF("wx", "wy", "wz")
    row = tl.inverse(f, DIM, np.eye(4), np.eye(4), rounds=25).first()
    at = [np.array(row[c]) for c in ("wx", "wy", "wz")]
    through = [reg.sample(w, [np.clip(c, 1, n) for c, n in zip(at, DIM, strict=True)], DIM) for w in (i + bump, j - 0.5 * bump, k + 0.3 * bump)]
    inner = (i > 3) & (i < 16) & (j > 3) & (j < 14) & (k > 3) & (k < 12)
    assert max(np.abs(t - g)[inner].max() for t, g in zip(through, (i, j, k), strict=True)) < 0.02
    plain = tl.inverse(f, DIM, np.eye(4), np.eye(4)).first()
    assert any(v is None for v in plain.wx) or np.abs(np.array(plain.wx) - at[0]).max() > 0.02


def test_missing_volumes_and_voxels(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0, 4.0]), (2, None), (3, [0.0, 0.0, 0.0, 8.0])], "id int, data array<double>")
    got = {r.id: r.data for r in tl.convolve(df, (2, 2, 1), (0.25, 0.5, 0.25)).collect()}
    assert got[2] is None and got[3] == pytest.approx([0.25, 0.5, 0.5, 1.0]) and got[1][0] == pytest.approx(0.5 * (0.5 * 0.5 * 1 + 0.25 * (0.5 * 3 + 0.25 * 4)))
    pushed = {r.id: r.data for r in tl.push(df, np.diag([2.0, 1, 1, 1]), (2, 2, 1)).collect()}
    assert pushed[1] == [None, 1.0, None, 3.0] and pushed[2] is None
    assert tl.pull(df.limit(0), np.eye(4), (2, 2, 1)).count() == 0
    near = {r.id: r.data for r in tl.pull(df.withColumn("data", F.col("data")), np.eye(4), (2, 2, 1), order=0).collect()}
    assert near[1] == [1.0, 0.0, 3.0, 4.0]


def test_searches_side_by_side_are_those_of_single_volumes(monkeypatch):
    rng = np.random.default_rng(5)
    fixed = rng.normal(size=(40, 5 * 4 * 6))
    moving = 0.8 * fixed + 0.2 * rng.normal(size=fixed.shape)
    fixed[3], moving[4, 2] = 1.0, np.nan
    monkeypatch.setattr(reg, "SIDE_BY_SIDE", 7 * fixed.shape[1])
    start = np.eye(4)
    start[0, 3] = 0.4
    found, score = reg.align_each(fixed, moving, (5, 4, 6), (5, 4, 6), start, strides=(2, 1))
    for n in range(len(fixed)):
        m, s = reg.align(fixed[n], moving[n], (5, 4, 6), (5, 4, 6), start, strides=(2, 1))
        assert found[n] == pytest.approx(m, abs=1e-9) and score[n] == pytest.approx(s, abs=1e-9)
        held = np.isfinite(moving[n])
        if held.all() and n % 8 == 0:
            places = (found[n] @ np.stack([*reg.grid_places(np.eye(4), (5, 4, 6)), np.ones(120)]))[:3]
            inside = reg._at(places, (5, 4, 6))[1]
            value = reg.sample(moving[n], [c[inside] for c in places], (5, 4, 6))
            assert score[n] == pytest.approx(reg.mutual_information(fixed[n][inside], value), abs=1e-9)


def test_a_search_ends_where_nothing_is_to_gain(monkeypatch):
    calls, plain = [], reg.sample
    monkeypatch.setattr(reg, "sample", lambda *a: calls.append(1) or plain(*a))
    x = np.random.default_rng(6).normal(size=(500, 64))
    found, score = reg.align_each(x, x, (4, 4, 4), (4, 4, 4), np.eye(4), strides=(1,))
    assert np.array_equal(found, np.repeat(np.eye(4)[None], 500, axis=0)) and score == pytest.approx(2.0)
    assert len(calls) < 500
