"""Tiling against a plain greedy search, and reordered passages."""

import random
import re

from tessera.llm import tiling
from tessera.llm.queries import op9_string_tiling


def words(text):
    return re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", (text or "").encode().lower())


def greedy(text, item, least):
    """Longest common unmarked runs by trying all pairs of places."""
    marked_t, marked_i, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in marked_t and j + n not in marked_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        marked_t.update(range(i, i + n))
        marked_i.update(range(j, j + n))
        tiles.append(n)


def brute(docs, items, least=tiling.LEAST, coverage=tiling.COVERAGE):
    out = set()
    seen = {}
    for item_id, body in items:
        item = words(body)
        need = min(least, len(item))
        if not item:
            continue
        for doc_id, text in docs:
            w = seen.setdefault(doc_id, words(text))
            grams = {tuple(w[k : k + need]) for k in range(len(w) - need + 1)}
            if any(tuple(item[k : k + need]) in grams for k in range(len(item) - need + 1)):
                share = sum(greedy(w, item, need)) / len(item)
                if share >= coverage:
                    out.add((doc_id, item_id, round(share, 9)))
    return out


def test_tiles_equal_the_plain_search():
    r = random.Random(3)
    for _ in range(200):
        item = [r.randint(1, 4) for _ in range(r.randint(1, 14))]
        text = [r.randint(1, 4) for _ in range(r.randint(1, 25))]
        got = tiling.tile(text, item, 2)
        assert sorted(t[2] for t in got) == sorted(greedy(text, item, 2))
        assert all(text[i : i + n] == item[j : j + n] for i, j, n in got)


def test_query_equals_brute_force(spark, sf_dir):
    got = {(r.doc_id, r.item_id, round(r.coverage, 9)) for r in op9_string_tiling(spark, sf_dir).collect()}
    rows = lambda name: [tuple(r)[:2] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    want = brute(rows("documents"), rows("benchmark"))
    assert got == want and got


def test_reordered_short_null_and_repeated(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, "x theta " + "epsilon zeta eta theta, Alpha beta gamma DELTA y", "k"), (2, None, None), (3, "", "k"), (4, "alpha beta x gamma", "k"), (1, "epsilon zeta eta theta alpha beta gamma delta", "k"), (5, "q one two r", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "one two"), (10, "one two")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in tiling.matches(df, bench).collect())
    assert [g[:3] for g in got] == [(1, 7, 1.0), (1, 7, 1.0), (5, 10, 1.0), (5, 10, 1.0)]
    kept = tiling.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert tiling.matches(df.limit(0), bench).count() == 0
    assert tiling.matches(df, bench.limit(0)).count() == 0 and tiling.clean(df, bench.limit(0)).count() == 6


def test_large_benchmark_goes_in_parts(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in tiling.matches(docs, bench).collect()}
    monkeypatch.setattr(tiling, "PART_BYTES", 2000)
    assert len(tiling._parts(bench)) > 1
    assert {(r.doc_id, r.item_id) for r in tiling.matches(docs, bench).collect()} == whole


def test_repeated_words_take_little_time_and_memory():
    """One word, a period of two, and many: texts of 20,000 words against items of 2,000."""
    import resource
    import time

    import numpy as np
    import pyarrow as pa

    from tessera.llm.textkernel import utf8

    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    for unit in ("spam", "spam ham", "a b c a b d"):
        item, text = (" ".join((unit.split() * 20_000)[:n]) for n in (2_000, 20_000))
        index = tiling.Index.of([7], pa.array([item]), 4, 0.5)
        (found,) = list(index.matches(*utf8(pa.array([text]))))
        assert found == (0, 7, 1.0, 1, 2_000)
    r = np.random.default_rng(1)
    words_ = [f"w{n}" for n in r.integers(0, 3, 20_000)]
    index = tiling.Index.of([7], pa.array([" ".join(words_[:2_000][::-1])]), 4, 0.5)
    ((_, _, share, _, _),) = list(index.matches(*utf8(pa.array([" ".join(words_)]))))
    assert share > 0.9
    assert time.time() - began < 120
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_runs_of_few_words_equal_the_plain_search():
    """Texts of one to three words, where nearly every window repeats."""
    import pyarrow as pa

    from tessera.llm.textkernel import utf8

    r = random.Random(11)
    for n in range(150):
        letters = "abc"[: 1 + n % 3]
        items = [(k, " ".join(r.choices(letters, k=r.randint(1, 16)))) for k in range(3)]
        docs = [(k, " ".join(r.choices(letters, k=r.randint(1, 40)))) for k in range(3)]
        index = tiling.Index.of([k for k, _ in items], pa.array([t for _, t in items]), tiling.LEAST, tiling.COVERAGE)
        got = {(m[0], m[1], round(m[2], 9)) for m in index.matches(*utf8(pa.array([t for _, t in docs])))}
        assert got == brute(docs, items)
