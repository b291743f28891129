"""Periodic runs against plain definitions."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import labelled, periodic
from tessera.llm.queries import op11_periodic_runs


def brute_runs(words, least=6, exponent=4):
    """Every run by the definition: each period, each maximal stretch, smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                own = words[i : j + q]
                if all(any(own[x] != own[x + p] for x in range(len(own) - p)) for p in range(1, q)):
                    found[i, q] = j + q - i
            i = j
    return sorted((s, n, q) for (s, q), n in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found_runs(texts, least=6, exponent=4):
    out = [[] for _ in texts]
    done = 0
    for data, offsets in labelled.pieces(pa.array(texts)):
        row, runs, _ = periodic.find_runs(data, offsets, (), least, exponent)
        for r, x in zip(row.tolist(), runs.tolist(), strict=True):
            out[done + r].append(tuple(x))
        done += len(offsets) - 1
    return out


def test_gram_size():
    assert periodic.gram_size(6, 4) == 5
    assert periodic.gram_size(2, 2) == 1
    assert periodic.gram_size(12, 3) == 5


@given(st.lists(st.text("ab ", max_size=60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_random_words(texts):
    assert found_runs(texts) == [brute_runs(t.split()) for t in texts]


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 12)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_repeated_blocks(blocks):
    words = [c for b, times in blocks for c in b * times]
    texts = [" ".join(words), "", " ".join(words[::-1])]
    assert found_runs(texts) == [brute_runs(t.split()) for t in texts]


@pytest.mark.parametrize("least,exponent", [(2, 2), (4, 2), (6, 3), (9, 5), (20, 2)])
def test_other_limits(least, exponent):
    r = np.random.default_rng(least)
    texts = [" ".join(r.choice(list("ab"), 80)) for _ in range(60)] + [" ".join(list("abcab" * 9 + "aab" * 7))]
    assert found_runs(texts, least, exponent) == [brute_runs(t.split(), least, exponent) for t in texts]


def test_long_texts_and_structured_words():
    """Thue-Morse and Fibonacci words (hashes of powers confuse the former), one word many
    times over, and periods longer than any piece."""
    morse, fib = "a", ("a", "ab")
    for _ in range(11):
        morse += "".join("b" if c == "a" else "a" for c in morse)
    while len(fib[1]) < 3000:
        fib = (fib[1], fib[1] + fib[0])
    texts = [" ".join(x) for x in (morse, fib[1], "z" * 3000, "abcdefghij" * 300)]
    assert found_runs(texts) == [brute_runs(t.split()) for t in texts]
    r = np.random.default_rng(4)
    block = [f"w{x}" for x in r.integers(0, 10**6, 20_000)]
    (runs,) = found_runs([" ".join(block * 5)])
    assert runs == [(0, 100_000, 20_000)]


def test_case_matters_and_word_boundaries():
    assert found_runs(["A a A a A a A a", "x x x x x x x x x x x x", "\tq\nq\x0bq\x0cq\rq q"]) == [[(0, 8, 2)], [(0, 6, 1)], [(0, 6, 1)]]


def test_query_equals_brute_force(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in source if r.text is None or len(r.text) < 6000]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "a b " * 50), (10**6 + 3, "a b " * 50), (10**6 + 4, "word"), (None, "x " * 9)]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, n_runs string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: (x[0] or 0, x[7])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((brute_row(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in map(tuple, got.collect())) > 5


def test_collapsed_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: (r.runs, r.collapsed) for r in periodic.collapse(docs).collect()}
    assert [tuple(x) for x in got[1][0]] == [(1, 8, 2)] and got[1][1] == "x a b y"
    assert got[2] == ([], "")
    assert periodic.digests(docs.limit(0)).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    from tessera.llm.queries import OP11_SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = op11_periodic_runs(spark, d)
    cursor = con.execute(OP11_SQL)
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
