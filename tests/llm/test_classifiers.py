"""Held-out accuracy, interactions, and odd inputs of the two classifiers."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import labelled, quality, toxicity
from tessera.llm.queries import op4_toxicity_fm, op5_quality_nbsvm


@pytest.mark.parametrize("query,label,least,share", [(op4_toxicity_fm, "toxic", 0.5, 0.9), (op5_quality_nbsvm, "quality", 0.3, 0.9)])
def test_held_out_accuracy(spark, query, label, least, share):
    d = "/root/testdata/sf0.1"
    rows = query(spark, d).collect()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > share


def scores(model, texts):
    return np.concatenate([model.scores(d, o) for d, o in labelled.pieces(pa.array(texts))])


def test_machine_learns_a_pair_that_single_terms_miss():
    """Either term alone is clean; both together are toxic, as are neither (no linear rule)."""
    r = np.random.default_rng(3)
    texts, y = [], []
    for _ in range(4000):
        a, b = r.integers(0, 2, 2)
        filler = " ".join(f"w{n}" for n in r.integers(0, 30, 8))
        texts.append(f"{filler} {'insultword' if a else ''} {'groupname' if b else ''}")
        y.append(float(a and b))
    model = toxicity.fit(pa.chunked_array([texts[:3000]]), np.array(y[:3000]))
    assert (np.round(scores(model, texts[3000:])) == y[3000:]).mean() > 0.99
    assert np.abs(model.factors).max() > 0.05


def pair_data(rule, n=4000, seed=5):
    r = np.random.default_rng(seed)
    texts, y = [], []
    for _ in range(n):
        a, b = r.integers(0, 2, 2)
        filler = " ".join(f"w{k}" for k in r.integers(0, 30, 8))
        texts.append(f"{filler} {'firstword' if a else ''} {'secondword' if b else ''}")
        y.append(float(rule(a, b)))
    return texts, np.array(y)


def test_machine_learns_terms_that_are_neutral_alone():
    """Toxic is one of two words without the other: neither word tells anything by itself."""
    texts, y = pair_data(lambda a, b: a != b)
    model = toxicity.fit(pa.chunked_array([texts[:3000]]), y[:3000])
    assert (np.round(scores(model, texts[3000:])) == y[3000:]).mean() > 0.99


def test_pairs_that_tell_nothing_are_left_out():
    texts, y = pair_data(lambda a, b: a != b)
    shuffled = np.random.default_rng(1).permutation(y)
    found = labelled.features_of(pa.chunked_array([texts]), toxicity.terms)
    assert len(toxicity.pair_terms(*found, shuffled)) == 0
    words, _ = toxicity.terms(*next(labelled.pieces(pa.array(["firstword secondword"]))))
    assert set(toxicity.pair_terms(*found, y)) == set(words.tolist())


def test_pair_counts_equal_brute_force(monkeypatch):
    """Tiles smaller than the terms, and copies that count once."""
    monkeypatch.setattr(toxicity, "TILE", 7)
    monkeypatch.setattr(toxicity, "PAIR_BEARING", 25.0)
    r = np.random.default_rng(8)
    rows = [np.unique(r.integers(0, 40, r.integers(3, 20))).astype(np.uint32) for _ in range(400)]
    y = np.array([float((3 in x) != (7 in x)) if r.random() < 0.9 else float(r.random() < 0.5) for x in rows])
    rows, y = rows + rows[:100], np.concatenate([y, y[:100]])
    own = toxicity.distinct_rows(np.concatenate(rows), np.array([len(x) for x in rows]))
    sets, t = [set(rows[k].tolist()) for k in own], y[own]
    want = set()
    for a in range(40):
        for b in range(a):
            both = np.array([a in s and b in s for s in sets])
            sides = [np.array([k in s for s in sets]) for k in (a, b)]
            if min(toxicity.bearing(float(both.sum()), float(t[both].sum()), float(t[s].sum()), float(s.sum())) for s in sides) >= 25:
                want |= {a, b}
    assert set(toxicity.pair_terms(np.concatenate(rows), np.array([len(x) for x in rows]), y).tolist()) == want >= {3, 7}


def test_machine_equals_the_formula():
    r = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.arange(1 << toxicity.BITS, dtype=np.int32) % 50, r.normal(size=50), r.normal(size=(50, toxicity.FACTORS)))
    buckets, first = np.array([3, 9, 70, 4], np.uint32), np.array([0, 3, 3, 4])
    want = []
    for a, z in zip(first, first[1:], strict=False):
        at = [int(b) % 50 for b in buckets[a:z]]
        want.append(0.3 + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for n, i in enumerate(at) for j in at[n + 1 :]))
    assert m.margins(buckets, first) == pytest.approx(want)


def test_dual_descent_meets_the_optimality_conditions():
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 5))
    y = np.sign(x[:, 0] + 0.3 * r.normal(size=80))
    first = np.arange(0, 401, 5)
    w, b = quality.dual_descent(x.ravel(), np.tile(np.arange(5), 80), first, y, np.full(80, 0.5), 5, 2000, 1)
    objective = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = objective(w, b)
    for _ in range(300):
        assert objective(w + r.normal(0, 0.02, 5), b + r.normal(0, 0.02)) >= best - 1e-3


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_inputs(spark, module, label):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a", None), (3, "a", None), (4, "b " * 60_000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = module.score(docs, none).collect()
    assert [r.score for r in rows] == pytest.approx([0.5] * 5)
    one_class = spark.createDataFrame([(n, 1) for n in range(1, 5)] + [(2, None)], f"doc_id long, {label} int")
    rows = module.score(docs, one_class).collect()
    assert len({r.score for r in rows}) == 1 and rows[0].score > 0.5
    both = spark.createDataFrame([(n, n % 2) for n in range(1, 5)], f"doc_id long, {label} int")
    rows = module.score(docs, both).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(docs.limit(0), both).collect() == []


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as toxic")
    texts, y = labelled.training_sample(docs, labels, "toxic", 1000)
    want = {f"text {n}" for n in range(200) if zlib.crc32(str(n).encode()) % 5}
    assert set(texts.to_pylist()) == want and len(y) == len(want)
    assert len(labelled.training_sample(docs, labels, "toxic", 20)[1]) == 20
