"""Spelling variants against plain code: words, slips, neighbourhoods, forms and roots."""

import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling
from tessera.llm.queries import op13_spelling_variants
from tessera.llm.textkernel import utf8

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_words(rows):
    for doc_id, text in rows:
        for run in WORD.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                yield w


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by comparing ends."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def brute_variants(rows):
    n = {w: k for w, k in Counter(brute_words(rows)).items() if k >= 2}
    # Near words share all but one code point, so they share the word without that one.
    shared, near = defaultdict(set), defaultdict(set)
    for w in n:
        shared[w].add(w)
        for i in range(len(w)):
            shared[w[:i] + w[i + 1 :]].add(w)
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def as_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n if r.form_n is not None else -1) for r in df.collect())


@given(st.lists(st.tuples(st.integers(0, 99), st.text("aZéÀ÷ÿ x1ж漢\n", max_size=40)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_words_equal_brute_force(rows):
    data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
    got = [w.decode("latin-1") for part in spelling.spelled(data, offsets, [i for i, _ in rows], letters=3) for w in part.to_pylist()]
    want = []
    for doc_id, text in rows:
        for run in WORD.findall(text):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 and len(w) >= 3 else w
            if len(w) >= 3:
                want.append(w)
    assert got == want


@pytest.mark.parametrize("limit", [1, 2, 5, 64])
def test_windows_end_between_words(limit):
    texts = ["abc déf", "", "éàü", "漢字漢字 ab" * 3, "x" * 40, "ж", " "]
    data, offsets = utf8(pa.array(texts))
    cut = list(spelling.windows(data, offsets, limit))
    assert [a for a, _ in cut] == [0, *(z for _, z in cut)][:-1] and cut[-1][1] == len(data)
    ends = sorted({0, *(z for _, z in cut), *offsets.tolist()})
    words = [w for a, z in zip(ends, ends[1:], strict=False) for w in re.findall("(?:[A-Za-z]|Ã.)+", data[a:z].tobytes().decode("latin-1"))]
    assert words == ["abc", "dÃ©f", "Ã©Ã Ã¼", "ab", "ab", "ab", "x" * 40]


def test_checksums_of_short_and_long_spans():
    r = np.random.default_rng(2)
    data = r.integers(0, 256, 3000).astype(np.uint8)
    start = r.integers(0, 1500, 200)
    end = start + np.concatenate([r.integers(0, 30, 150), r.integers(60, 1400, 50)])
    state = np.array([zlib.crc32(bytes([k])) for k in range(200)], np.uint32)
    want = [zlib.crc32(data[a:z].tobytes(), int(s)) for a, z, s in zip(start, end, state, strict=True)]
    assert spelling.crc_on(state, data, start, end).tolist() == want


class Everything(spelling.Table):
    def __init__(self):
        super().__init__(1 << 16, 1, 0)

    def holds(self, h):
        self.seen = getattr(self, "seen", []) + [h.copy()]
        return np.arange(len(h))


@given(st.lists(st.text("abé", min_size=4, max_size=4), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_neighbourhood_is_full_and_distinct(words):
    chars = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
    letters = np.array([ord(c) for c in "abcé"], np.uint8)
    made = [(r, bytes(m).decode("latin-1")) for rows, out in spelling.neighbours(chars, letters, Everything()) for r, m in zip(rows.tolist(), out, strict=True)]
    want = set()
    for r, w in enumerate(words):
        for i in range(5):
            want |= {(r, w[:i] + c + w[i:]) for c in "abcé"}
            if i < 4:
                want.add((r, w[:i] + w[i + 1 :]))
                want |= {(r, w[:i] + c + w[i + 1 :]) for c in "abcé" if c != w[i]}
    assert len(made) == len(set(made)) and set(made) == want


def test_hashes_of_candidates_are_those_of_words():
    w = np.array([list(b"abcabba")], np.uint8)
    table = Everything()
    made = [bytes(m) for _, out in spelling.neighbours(w, np.array(list(b"abc"), np.uint8), table) for m in out]
    seen = set(np.concatenate(table.seen).tolist())
    assert all(int(spelling.hashes(np.array([list(m)], np.uint8))[0]) in seen for m in made)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "Straßenbahn Straßenbahn"), (-5, None), (-5, ""), (-6, "word " * 9), (-7, "longword longwords longwöord " * 3), (-8, ("frequent " * 20 + "fréquent ") * 3), (-8, "fréquents fréquents"), (-9, "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000 + " " + "x" * 5001)]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_spelling_variants(spark, str(tmp_path))
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    want = brute_variants(rows)
    assert as_rows(got) == want
    assert len(want) > 1000 and any(w[1] for w in want)


def test_slices_give_the_same(spark, monkeypatch):
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect())]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    monkeypatch.setattr(spelling, "LEAST_SECTION", 1 << 10)
    assert spelling.slices_of(1000, 1 << 11)[1] == 8
    assert as_rows(spelling.variants(docs, most=1 << 13)) == brute_variants(rows)


def test_forms_are_followed_to_the_last(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 4, "zzzzzzy": 38}
    rows = [(k, " ".join(w for w, n in words.items() for _ in range(n // 2))) for k in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(docs, slip=1 << 31).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 1, 20) and got["aaaaabb"] == ("aaaabbb", "aaaabbb", 2, 2000)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 1, None)
    with pytest.raises(ValueError):
        spelling.variants(docs, ratio=1)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "short words"), (2, None)], "doc_id int, text string")
    assert spelling.variants(docs).collect() == []
    assert spelling.variants(docs.limit(0)).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    from tessera.llm.queries import OP13_SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = op13_spelling_variants(spark, d)
    cursor = con.execute(OP13_SQL)
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cursor.fetchall()))
