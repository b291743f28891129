"""Base scores by plain counting, class scores by plain counting, and the clustering."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import brown
from tessera.llm.queries import op6_brown_lm
from tessera.llm.textkernel import utf8


def tokens(text):
    return (text or "").encode().lower().split()


def plain_base(docs):
    train = [tokens(t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        ws = [*tokens(t), None]
        out[i] = (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    return out


def test_query_equals_plain_counting(spark, sf_dir):
    got = op6_brown_lm(spark, sf_dir).collect()
    docs = [tuple(r)[:2] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_base(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_scores_equal_plain_counting(spark, monkeypatch):
    """Without frequent words all words are of one class, so plain counts give the score."""
    monkeypatch.setattr(brown, "HEAD", 0)
    texts = ["the cat sat on the mat", "a dog sat", "", None, "The the end of it"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in brown.score(df, brown.F.col("doc_id") != 1).collect()}
    train = [t for i, t in enumerate(texts) if i != 1]
    pair, cls, left, words = Counter(), Counter(), Counter(), Counter()
    for t in train:
        seq = ["<s>", *("word" for _ in tokens(t)), "</s>"]
        pair.update(zip(seq, seq[1:], strict=False))
        left.update(seq[:-1])
        cls.update(seq[1:])
        words.update(tokens(t))
    outcomes = brown.CLASSES + 2
    for i, t in enumerate(texts):
        seq, s = ["<s>", *("word" for _ in tokens(t)), "</s>"], 0.0
        for a, b in zip(seq, seq[1:], strict=False):
            prior = (cls[b] + 1) / (sum(cls.values()) + outcomes)
            s += math.log10((pair[a, b] + brown.PRIOR * prior) / (left[a] + brown.PRIOR))
        for w in tokens(t):
            s += math.log10((words[w] + 1) / (sum(words.values()) + len(words) + 1))
        assert got[i].score == pytest.approx(s, rel=1e-9)
        assert got[i].perplexity == pytest.approx(10 ** (-s / (len(tokens(t)) + 1)))


def test_scores_equal_a_plain_model_of_the_same_classes(spark, sf_dir, monkeypatch):
    """Transitions, emissions and scores by plain counting, given each word's class; words
    below the threshold are looked up in buckets by small packets."""
    monkeypatch.setattr(brown, "HEAD", 50)
    monkeypatch.setattr(brown, "PACKET", 700)
    built, build = [], brown.build
    monkeypatch.setattr(brown, "build", lambda *a: built.append(a[0]) or build(*a))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in brown.score(df, brown.F.col("doc_id") % 3 != 0).collect()}
    counts = Counter(w for i, t in rows if i % 3 for w in tokens(t))
    vocabulary = sorted(counts)
    data, offsets = utf8(pa.array([b" ".join(vocabulary)]).cast(pa.string()))
    label = dict(zip(vocabulary, built[0].classes_of(brown.read_words(data, offsets)[0]).tolist(), strict=True))
    frequent = {w for w, _ in sorted(counts.items(), key=lambda x: -x[1])[:50]}
    assert all((label[w] != brown.REST) == (n >= brown.OFTEN) for w, n in counts.items() if w not in frequent)
    assert sum(n >= brown.OFTEN for n in counts.values()) > 200
    pair, left, n, v = Counter(), Counter(), Counter(), Counter({brown.REST: 1})
    for i, t in rows:
        if i % 3:
            seq = [brown.START, *(label[w] for w in tokens(t)), brown.END]
            pair.update(zip(seq, seq[1:], strict=False))
            left.update(seq[:-1])
    for w, c in counts.items():
        n[label[w]] += c
        v[label[w]] += 1
    seen = Counter()
    for (_, b), c in pair.items():
        seen[b] += c
    total = sum(seen.values())
    for i, t in rows:
        seq, s = [brown.START, *(label.get(w, brown.REST) for w in tokens(t)), brown.END], 0.0
        for a, b in zip(seq, seq[1:], strict=False):
            s += math.log10((pair[a, b] + brown.PRIOR * (seen[b] + 1) / (total + brown.START)) / (left[a] + brown.PRIOR))
        s += sum(math.log10((counts[w] + 1) / (n[label.get(w, brown.REST)] + v[label.get(w, brown.REST)])) for w in tokens(t))
        assert got[i].score == pytest.approx(s, rel=1e-9)


def test_exchange_finds_alternating_classes():
    r = np.random.default_rng(5)
    pairs = np.zeros((42, 42))
    seq = [int(r.integers(0, 20)) + 20 * (i % 2) for i in range(20_000)]
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    label = brown.exchange(pairs, 40, 2)
    assert len(set(label[:20])) == 1 and len(set(label[20:40])) == 1 and label[0] != label[20]


def test_exchange_ends_where_no_move_gains():
    r = np.random.default_rng(11)
    pairs = r.poisson(r.gamma(0.3, 3, (160, 160))).astype(float)
    label = brown.exchange(pairs, 158, 8)

    def likelihood(own):
        table = np.zeros((10, 10))
        np.add.at(table, (own[:, None], own[None, :]), pairs)
        return brown._xlogx(table).sum() - brown._xlogx(table.sum(axis=0)).sum() - brown._xlogx(table.sum(axis=1)).sum()

    best = likelihood(label)
    for w in range(158):
        for k in range(8):
            other = label.copy()
            other[w] = k
            assert likelihood(other) <= best + 1e-6


def test_words_beyond_the_head_get_their_neighbours_class(spark, monkeypatch):
    """Two kinds of words by turns; most are beyond the head."""
    monkeypatch.setattr(brown, "HEAD", 20)
    built, build = [], brown.build
    monkeypatch.setattr(brown, "build", lambda *a: built.append((build(*a), a)) or built[-1][0])
    r = np.random.default_rng(6)
    share = np.array([20.0] * 10 + [1.0] * 50)
    kinds = [[f"{k}{n}zz" for n in range(60)] for k in "ab"]
    texts = [" ".join(r.choice(kinds[(i + j) % 2], p=share / share.sum()) for j in range(40)) for i in range(1200)] + ["rarezz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = brown.score(df, brown.F.lit(True)).collect()
    (model, (_, _, rest_n, rest_v)) = built[0]
    counts = Counter(" ".join(texts).split())
    assert len(model.lexicon.label) == sum(n >= brown.OFTEN for n in counts.values()) == 120
    assert rest_n == 1 and rest_v == 1

    def class_of(word):
        data, offsets = utf8(pa.array([word]))
        return int(model.lexicon.classes_of(brown.read_words(data, offsets)[0])[0])

    classes = [{class_of(w) for w in kind} for kind in kinds]
    assert not classes[0] & classes[1] and max(classes[0] | classes[1]) < brown.CLASSES and class_of("rarezz") == class_of("unseen") == brown.REST
    for own, other in (classes, classes[::-1]):
        for k in own:
            mine = [w for kind in kinds for w in kind if class_of(w) == k]
            assert model.room[k] == pytest.approx(math.log10(sum(counts[w] for w in mine) + len(mine)))
            assert sum(10 ** model.transition[k, x] for x in other) > 0.8  # the rest: ends of texts
    assert all(math.isfinite(x.score) for x in got)


def test_the_threshold_doubles_until_the_lexicon_is_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 10)
    monkeypatch.setattr(brown, "LEXICON", 60)
    built, build = [], brown.build
    monkeypatch.setattr(brown, "build", lambda *a: built.append(a) or build(*a))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = brown.score(docs, brown.F.lit(True)).collect()
    counts = Counter(w for r in docs.collect() for w in tokens(r.text))
    least = next(brown.OFTEN << k for k in range(40) if sum(n >= brown.OFTEN << k for n in counts.values()) <= 60)
    lexicon, _, rest_n, rest_v = built[0]
    assert len(lexicon.label) == sum(n >= least for n in counts.values()) or len(lexicon.label) == 10
    assert rest_v + len(lexicon.label) == len(counts) and rest_n + lexicon.words.counts.sum() == sum(counts.values())
    want = plain_base([tuple(r) for r in docs.collect()])
    assert {r.doc_id: r.n_tokens for r in rows} == {i: w[0] for i, w in want.items()}


def test_scores_are_the_same_whatever_is_sent_out(spark, sf_dir, monkeypatch):
    """Words beyond the bound have the classes that they have without one, from buckets."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([*rows, (-1, None), (-2, "neverseenzz")], "doc_id long, text string").repartition(3)
    built, build = [], brown.build
    monkeypatch.setattr(brown, "build", lambda *a: built.append(build(*a)) or built[-1])
    monkeypatch.setattr(brown, "HEAD", 30)
    monkeypatch.setattr(brown, "PACKET", 700)
    runs = []
    for bound in (brown.LEXICON, 60, 0):
        monkeypatch.setattr(brown, "LEXICON", bound)
        runs.append({r.doc_id: r for r in brown.score(df, brown.F.col("doc_id") % 3 != 0).collect()})
    assert len(built[0].lexicon.label) > 200 and len(built[1].lexicon.label) <= 60 and len(built[2].lexicon.label) == 30
    for model, got in zip(built[1:], runs[1:], strict=True):
        np.testing.assert_allclose(model.room, built[0].room, rtol=1e-12)
        np.testing.assert_allclose(model.transition, built[0].transition, rtol=1e-12)
        assert got.keys() == runs[0].keys()
        for i, r in got.items():
            assert (r.n_tokens, r.n_known, r.train_tokens) == (runs[0][i].n_tokens, runs[0][i].n_known, runs[0][i].train_tokens)
            assert r.base_score == pytest.approx(runs[0][i].base_score, rel=1e-9) and r.score == pytest.approx(runs[0][i].score, rel=1e-9)


def test_small_packets_and_edge_cases(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = brown.F.col("doc_id") % 3 != 0
    whole = {r.doc_id: (r.n_known, round(r.score, 6)) for r in brown.score(docs, train).collect()}
    monkeypatch.setattr(brown, "PACKET", 2000)
    monkeypatch.setattr(brown, "PACKET_DOCS", 7)
    assert {r.doc_id: (r.n_known, round(r.score, 6)) for r in brown.score(docs, train).collect()} == whole
    assert brown.score(docs.limit(0), train).collect() == []
    untaught = brown.score(docs.limit(3), brown.F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untaught)


def test_one_very_long_text(spark):
    text = " ".join(f"w{n % 5000} the" for n in range(300_000))
    df = spark.createDataFrame([(1, text), (2, "the w1"), (3, "x " * 10)], "doc_id long, text string")
    got = {r.doc_id: r for r in brown.score(df, brown.F.col("doc_id") == 1).collect()}
    assert got[1].n_tokens == got[1].n_known == 600_001 and got[3].n_known == 1
    assert math.isfinite(got[1].score) and got[1].score > got[1].base_score
