"""Queries without SQL against plain numpy."""

import hashlib
import math

import numpy as np
import pytest

from tessera.operators import cleanup, models
from tessera.queries import models as q
from tessera.queries import statistics as qs
from tessera.queries.common import pairs


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return {r.vec_id: (r.label, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}


def test_clean_up(spark, sf_dir, embeddings):
    got = {}
    for r in q.clean_gwc(spark, sf_dir).collect():
        got.setdefault(r.stack, {})[r.at] = r.p
    stacks = {s for v in embeddings for s in [v // 4] if all(4 * s + c in embeddings for c in range(4))}
    assert set(got) == stacks
    for s in stacks:
        p = np.stack([np.abs(embeddings[4 * s + c][1]).reshape((4, 4, 4), order="F") * 3 for c in range(4)], axis=-1)
        want = cleanup.clean_tissue(p).ravel(order="F")
        assert np.array([got[s][n] for n in range(256)]) == pytest.approx(want, abs=1e-6)


def test_mixture(spark, sf_dir, embeddings):
    x = np.concatenate([v for _, v in embeddings.values()])
    w, m, s = np.array([0.5, 0.5]), np.array([-0.1, 0.1]), np.array([0.02, 0.02])
    for _ in range(5):
        p = w * np.exp(-((x[:, None] - m) ** 2) / 2 / s) / np.sqrt(2 * math.pi * s)
        p /= p.sum(axis=1, keepdims=True)
        w, m = p.mean(axis=0), (p * x[:, None]).sum(axis=0) / p.sum(axis=0)
        s = (p * x[:, None] ** 2).sum(axis=0) / p.sum(axis=0) - m**2
    got = sorted(tuple(r) for r in q.gmm_em(spark, sf_dir).collect())
    for g, row in enumerate(got):
        assert row[1:] == pytest.approx((w[g], m[g], s[g]), abs=1e-5)


@pytest.mark.parametrize("machine", ["krr", "gp", "gpc", "rvr"])
def test_cross_validation(spark, sf_dir, embeddings, machine):
    got = {(r.label, r.vec_id): (r.fold, r.y_pred) for r in q.QUERIES[f"{machine}_cv"][0](spark, sf_dir).collect()}
    for label in range(3):
        ids = sorted(v for v, (k, _) in embeddings.items() if k == label)
        order = sorted(ids, key=lambda v: (hashlib.md5(str(v).encode()).hexdigest(), v))
        fold = np.array([order.index(v) % 5 + 1 for v in ids])
        x = np.stack([embeddings[v][1] for v in ids])
        y = np.array([embeddings[v][1][0] + label if machine != "gpc" else float(embeddings[v][1][0] > 0) for v in ids])
        for f in set(fold):
            train = fold != f
            if not train.any():
                continue
            c = x - x[train].mean(axis=0)
            want = models.MACHINES[machine](c @ c.T, y, train)
            for n in np.flatnonzero(~train):
                assert got[label, ids[n]][0] == f and got[label, ids[n]][1] == pytest.approx(want[n], abs=2e-3)


@pytest.mark.parametrize("machine", ["krr", "gp", "gpc", "rvr"])
def test_cross_validation_covers_every_group(spark, sf_dir, embeddings, machine):
    got = [(r.label, r.vec_id) for r in q.QUERIES[f"{machine}_cv"][0](spark, sf_dir).collect()]
    assert sorted(got) == sorted((k, v) for v, (k, _) in embeddings.items()) and max(got)[0] > 2


def test_signed_rank_p(spark, sf_dir):
    rows = pairs(spark, sf_dir).collect()
    for r in qs.wilcoxon_p(spark, sf_dir).collect():
        d = np.array([p.x - p.y for p in rows if p.tissue == r.tissue and p.x is not None and p.y is not None])
        d = d[d != 0]
        size = np.abs(d)
        rank = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
        assert r.n == len(d) and r.w_plus == pytest.approx(rank[d > 0].sum())
        if len(d) <= 15 and len(set(size)) == len(d):
            sums = np.array([sum(k + 1 for k in range(len(d)) if m >> k & 1) for m in range(1 << len(d))])
            w = min(r.w_plus, rank.sum() - r.w_plus)
            assert r.p == pytest.approx(min(1, 2 * (sums <= w).mean()), abs=1e-6)


@pytest.mark.parametrize("machine", ["krr", "gp", "gpc", "rvr"])
def test_fits_by_features_are_those_of_the_kernel(machine, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 12))
    x[:, 5], x[:, 7] = 2.0, x[:, 6]
    y = x[:, 0] + 0.5 * rng.normal(size=150)
    y = (y > 0).astype(float) if machine == "gpc" else y + 3
    train = np.arange(150) % 5 != 2
    c = x - x[train].mean(axis=0)
    want = models.MACHINES[machine](c @ c.T, y, train)
    monkeypatch.setitem(models.MACHINES, machine, None)  # no kernel of 150 x 150 is made
    assert models.fitted(c, y, train, machine) == pytest.approx(want, abs=1e-6)
