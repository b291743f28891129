"""Vectorised text kernels shared by the training-data operators.

All of them work on the UTF-8 bytes of an Arrow string column, many documents at a
time, with numpy only: no Python object is made for a word.  A *word* is a maximal run
of bytes other than space and ``\\t \\n \\v \\f \\r``; ``A``-``Z`` count as ``a``-``z``.
Words and shingles are carried as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at once; one longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20_240_131))
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_BYTE_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, control characters and ASCII punctuation: what is left are terms.
TERM_BREAKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_ROTATE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's offsets into them (rows + 1); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's first word (rows + 1). ``breaks``
    tells for each byte value whether it parts words."""
    inside = ~breaks[data]
    opens = np.empty(len(data) + 1, dtype=bool)
    opens[0] = opens[-1] = True
    np.logical_not(inside[:-1], out=opens[1:-1]) if len(data) else None
    opens[offsets] = True  # a word never runs on into the next row
    start = np.flatnonzero(inside & opens[:-1])
    closes = opens
    np.logical_not(inside[1:], out=closes[1:-1]) if len(data) > 1 else None
    closes[offsets] = True
    end = np.flatnonzero(inside & closes[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    powers = _power_table("up", _BASE, n + 1)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    value = (_BYTE_VALUE if lower else _BYTE_EXACT)[data]
    np.multiply(value, powers[:n], out=value)
    np.cumsum(value, out=prefix[1:], dtype=np.uint64)
    down = _power_table("down", _BASE_INVERSE, n + 1)
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and each row's first word (rows + 1)."""
    start, end, first = word_bounds(data, offsets)
    return span_hashes(data, start, end, lower), first


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, and each row's first one (rows + 1)."""
    start, end, first = word_bounds(data, offsets, TERM_BREAKS)
    return span_hashes(data, start, end), first


def stem_hashes(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As ``term_hashes``, and for each term its first ``sizes`` bytes where it is longer."""
    start, end, first = word_bounds(data, offsets, TERM_BREAKS)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, rows = [span_hashes(data, start, end)], [row]
    for n in sizes:
        longer = end - start > n
        hashes.append(span_hashes(data, start[longer], start[longer] + n) + U64(n))
        rows.append(row[longer])
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    counts = np.bincount(rows, minlength=len(first) - 1)
    return np.concatenate(hashes)[order], np.concatenate([[0], np.cumsum(counts)])


def byte_grams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (``bits`` bits) of all runs of ``sizes`` bytes within a row, and each row's
    first one (rows + 1)."""
    counts = np.diff(offsets)
    made = [np.maximum(counts - n + 1, 0) for n in sizes]
    first = np.concatenate([[0], np.cumsum(sum(made))])
    out = np.empty(first[-1], dtype=np.uint32)
    done = np.zeros(len(counts), dtype=np.int64)
    for n, own in zip(sizes, made, strict=True):
        if len(data) < n:
            continue
        gram = np.full(len(data) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            gram = gram * np.uint32(257) + data[i : len(data) - n + 1 + i]
        gram = (gram * np.uint32(0x9E3779B1)) ^ (gram >> np.uint32(15))
        gram = (gram * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
        total = int(own.sum())
        within = np.arange(total) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(first[:-1] + done, own) + within] = gram[np.repeat(offsets[:-1], own) + within]
        done += own
    return out, first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words and each row's first window (rows + 1).

    A row of 1 to k-1 words has one window, its whole sequence; a row without words none.
    """
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_first[-1], dtype=np.uint64)
    n = len(words) - k + 1
    if n > 0:
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            rolled += words[i : i + n] * _ROTATE[i % 64]
        rolled = mix(rolled + U64(k))
        row = np.repeat(np.arange(len(counts)), made)
        at = np.arange(len(out)) - out_first[row] + first[row]
        whole = counts[row] >= k
        out[whole] = rolled[at[whole]]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[first[r] : first[r + 1]]
        out[out_first[r]] = mix((own * _ROTATE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + U64(len(own)))[0]
    return out, out_first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for a row without any."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def distinct_by_row(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and each row's first one (rows + 1)."""
    parts, sizes = [], np.zeros(len(first), dtype=np.int64)
    for r in range(len(first) - 1):
        own = values[first[r] : first[r + 1]]
        if len(own):
            own = np.sort(own)
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
            parts.append(own)
            sizes[r + 1] = len(own)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(sizes)
