"""The vectorised text kernels against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import textkernel as tk

PIECES = ["a", "B", "Z", "é", "中", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\xa0", "!", "x1", "-", "🙂"]


def texts(n, seed):
    r = random.Random(seed)
    return [None if r.random() < 0.05 else "".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(n)]


def hashes(words):
    """Hashes of single words, each on its own."""
    out = []
    for w in words:
        data = np.frombuffer(w, np.uint8)
        out.append(int(tk.span_hashes(data, np.array([0]), np.array([len(data)]))[0]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_words_and_shingles(seed):
    rows = texts(60, seed)
    data, offsets = tk.utf8(pa.array(rows, pa.string()).slice(3, 50))
    words, first = tk.word_hashes(data, offsets)
    plain = [(t or "").encode().lower().split() for t in rows[3:53]]
    assert [words[a:z].tolist() for a, z in zip(first, first[1:], strict=False)] == [hashes(w) for w in plain]
    for k in (1, 2, 4):
        found, f = tk.shingles(words, first, k)
        for r, w in enumerate(plain):
            want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
            assert f[r + 1] - f[r] == len(want)
        groups = {}
        for r, w in enumerate(plain):
            want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
            for g, h in zip(want, found[f[r] : f[r + 1]].tolist(), strict=True):
                assert groups.setdefault(g, h) == h
        assert len(set(groups.values())) == len(groups)


def test_rows_in_spans_are_whole_and_complete():
    offsets = np.array([0, 5, 5, 100, 101, 130])
    got = list(tk.spans(offsets, 20))
    assert [x for a, z in got for x in range(a, z)] == [0, 1, 2, 3, 4]
    assert list(tk.spans(np.array([0]))) == []


def test_byte_grams_and_distinct_values():
    rows = ["abcab", "", "a", "xyzxyz"]
    data, offsets = tk.utf8(pa.array(rows))
    found, first = tk.byte_grams(data, offsets, (2, 3), 18)
    assert np.diff(first).tolist() == [4 + 3, 0, 0, 5 + 4]
    distinct, f = tk.distinct_by_row(found, first)
    assert np.diff(f).tolist() == [3 + 3, 0, 0, 3 + 3]
    assert tk.row_sums(np.ones(len(found)), first).tolist() == [7, 0, 0, 9]


def test_long_text_and_no_text():
    long = "word " * 600_000
    data, offsets = tk.utf8(pa.array([long, None]))
    words, first = tk.word_hashes(data, offsets)
    assert first.tolist() == [0, 600_000, 600_000] and len(set(words.tolist())) == 1
    data, offsets = tk.utf8(pa.array([], pa.string()))
    assert tk.word_hashes(data, offsets)[1].tolist() == [0]


def test_packed_rows_stay_long_at_any_size():
    from tessera.llm.packing import ROW_ENTRIES, packing

    assert packing(500_000_000, 1_000_000, 8 << 20, 6) == (1_000_000, 60)
    assert packing(10, 1_000_000, 8 << 20, 6) == (1_000_000, 6)
    for size in (10**12, 10**14):
        packet, buckets = packing(size, 1_000_000, 8 << 20, 6)
        assert packet > 1_000_000 and packet / buckets >= 0.9 * ROW_ENTRIES
        assert packet / 1_000_000 == pytest.approx(size / buckets / (8 << 20), rel=0.01)


def test_bucket_runs_cover_all_hashes_in_order():
    from tessera.llm.packing import bucket_runs

    h = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for buckets in (1, 7, 100_000):
        runs = list(bucket_runs(h, buckets))
        assert [a for _, a, _ in runs] == [0, *(z for _, _, z in runs[:-1])] and runs[-1][2] == len(h)
        assert [b for b, _, _ in runs] == sorted({(x >> 32) * buckets >> 32 for x in h.tolist()})
    assert list(bucket_runs(h[:0], 5)) == []
