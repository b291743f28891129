"""Languages: codes, the plain formula, held-out accuracy and odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import labelled, language
from tessera.llm.queries import op12_language_ecoc


@pytest.mark.parametrize("n,least", [(2, 1), (3, 2), (4, 4), (5, 8), (6, 8), (12, 6), (40, 4)])
def test_codewords_are_far_apart(n, least):
    code = language.code(n)
    assert set(np.unique(code)) <= {-1.0, 1.0} and (code == language.code(n)).all()
    assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= least
    assert (np.abs(code.sum(axis=0)) < n).all()


def features_of(texts):
    found = [x for d, o in labelled.pieces(pa.array([t.lower() for t in texts])) for x in language._counted(d, o)]
    return np.concatenate([b for b, _ in found]), np.concatenate([c for _, c in found]), np.array([len(b) for b, _ in found])


def fitted(texts, labels):
    return language.fit(*features_of(texts), labels)


def made_up(n, languages, seed=0, size=(3, 60)):
    r = np.random.default_rng(seed)
    syllables = {k: ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyzéüñ"), 2)) for _ in range(12)] for k in languages}
    labels = [languages[k % len(languages)] for k in range(n)]
    return [" ".join("".join(r.choice(syllables[k], r.integers(1, 4))) for _ in range(r.integers(*size))) for k in labels], labels


@pytest.mark.parametrize("n", [2, 4, 9])
def test_made_up_languages(n):
    names = [f"l{k}" for k in range(n)]
    texts, labels = made_up(150 * n, names, seed=n)
    model = fitted(texts[: 100 * n], labels[: 100 * n])
    (data, offsets), = labelled.pieces(pa.array(texts[100 * n :]))
    p = model.predict(data, offsets)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert np.mean([names[k] == y for k, y in zip(p.argmax(axis=1), labels[100 * n :], strict=True)]) > 0.97


def plain_grams(text):
    """Byte n-grams of a text whose separators are single spaces, counted one by one."""
    b = text.lower().encode()
    b = bytes(32 if x < 128 and not chr(x).isalpha() else x for x in b)
    b = b" " + b" ".join(b.split(b" ")) .strip(b" ") + b" "
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    return Counter(b[i : i + n] for n in language.SIZES for i in range(len(b) - n + 1)) if b != b" " else Counter()


def test_prediction_is_the_plain_formula():
    texts, labels = made_up(300, ["x", "y", "z", "w"])
    model = fitted(texts, labels)
    for text in [texts[0], "Ab, cd 77 é!", "  lead and trail ", "q", texts[3] + "\n\n" + texts[2]]:
        grams = plain_grams(text)
        total = sum(grams.values())
        margins = []
        for bit in range(model.code.shape[1]):
            s = 0.0
            for g, k in grams.items():
                (bucket,), _ = bucket_of(g)
                s += k * float(model.weights[bucket, bit])
            margins.append(s / total + model.bias[bit])
        losses = [sum(model.right[i, b] * math.log1p(math.exp(-model.code[i, b] * margins[b])) for b in range(len(margins))) for i in range(4)]
        e = [math.exp(-model.slope * x) for x in losses]
        (data, offsets), = labelled.pieces(pa.array([text.lower()]))
        assert np.allclose(model.predict(data, offsets)[0], np.array(e) / sum(e), atol=1e-4)


def bucket_of(gram):
    from tessera.llm.textkernel import byte_grams

    return byte_grams(np.frombuffer(gram, np.uint8), np.array([0, len(gram)]), (len(gram),), language.BITS)


def test_separators_and_row_ends():
    rows = ["ab  cd", "", " ", "...x", "x", "9"]
    data, offsets = (x for x in next(labelled.pieces(pa.array(rows))))
    buckets, first = language.grams(data, offsets)
    own = [Counter(buckets[a:z].tolist()) for a, z in zip(first, first[1:], strict=False)]
    assert own[3] == own[4] and own[1] == own[2] == own[5]
    (d, o), = labelled.pieces(pa.array(["ab cd"]))
    assert own[0] == Counter(language.grams(d, o)[0].tolist())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = op12_language_ecoc(spark, d).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.99
    assert {r.lang_pred for r in rows} <= {x.lang for x in docs.values()} | {"und"}


def test_odd_texts_and_columns(spark):
    texts, labels = made_up(400, ["aa", "bb"])
    rows = [(k, t, y, "s", 1.0) for k, (t, y) in enumerate(zip(texts, labels, strict=True))]
    rows += [(1000, None, "aa", "s", 1.0), (1001, "", "aa", "s", 1.0), (1002, "12 34 ... !", None, "s", 1.0), (1003, "ж", None, "s", 1.0), (None, texts[0], None, "s", 1.0), (1004, texts[0] * 3000, None, "s", 1.0), (1004, texts[0] * 3000, None, "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, lang_pred string, score double")
    got = language.identify(docs, F.lit(True))
    assert got.columns == ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(rows)
    by = dict((r[0], r) for r in out)
    assert all(by[k][1:] == ("und", 0.0, None, False) for k in (1000, 1001, 1002))
    assert by[1003][1] in ("aa", "bb") and by[None][1:] == by[0][1:] and by[1004][1] == by[0][1]
    assert sum(r[0] == 1004 for r in out) == 2
    assert np.mean([by[k][1] == y for k, y in enumerate(labels)]) > 0.97
    half = language.identify(docs.where("doc_id < 2"), F.lit(True), ambiguous=1.1)
    assert all(r.ambiguous and r.runner_up not in (None, r.lang_pred) for r in half.collect())


def test_one_language_none_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words", "xx"), (2, "9", "xx"), (3, "other", None)], "doc_id int, text string, lang string")
    assert [tuple(r)[1:3] for r in language.identify(docs, F.lit(True)).orderBy("doc_id").collect()] == [("xx", 1.0), ("und", 0.0), ("xx", 1.0)]
    assert {tuple(r)[1:3] for r in language.identify(docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), F.lit(True)).collect() == []


def test_sample_is_bounded_and_even(spark):
    texts, labels = made_up(3000, ["aa", "bb"], size=(3, 6))
    rows = [(k, t, "aa" if k < 2900 else "bb") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    _, _, sizes, found = language.training_rows(docs, F.lit(True), "text", "lang", 300)
    counts = Counter(found)
    assert len(sizes) == len(found) <= 300 and counts["bb"] >= 80 and 100 <= counts["aa"] <= 200
