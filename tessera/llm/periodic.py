"""Runs of periodic words within a text, and texts with such runs collapsed.

A *run* is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart
are identical), of at least ``least`` words and ``exponent`` periods, that no neighbouring
word extends keeping the period. Words are what white space parts, compared byte by byte.

Repeated k-gram masking: in a run of ``m`` words and period ``q`` the words overlap with
those a period later, and of ``k``-grams with ``k <= m - 2q + 1`` each one in the run stands
in it twice. ``gram_size`` takes the largest ``k`` for which that holds of every run that
counts. So a run lies wholly inside a stretch of k-grams that the text has twice, and only
those stretches are looked at (hashes may mask too little, never too much).

Main-Lorentz then halves each stretch again and again. A run of the halved part that crosses
its middle has a period's worth of words on one side of it; for each period up to the part's
size over ``exponent``, the common extensions of two places a period apart, to the right and
to the left, give the run's ends. Extensions come from names of the stretch's words in runs
of 1, 2, 4, ... places (equal names, equal words: exact), so that all parts of all texts of a
chunk are worked on together, in time n log^2 n and about 4 bytes log2(n) a masked-in word.

Cases: a null or empty text, or one without words, has no run, and its collapsed text is
empty; a text shorter than ``least`` has none; ties for the longest run go to the smallest
start, then period; repeated rows give equal rows; an empty table an empty one; other columns
are left out, whatever their names; a null id counts as the empty string for its checksum.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.labelled import pieces
from tessera.llm.textkernel import mix, word_bounds, word_hashes
from tessera.plans.runtime import ship

LEAST = 6
EXPONENT = 4
U64 = np.uint64
_ROLL = U64(0x9E3779B97F4A7C15)

#: Number of the first word from which words repeat, and the period; None: as they are.
Plan = Callable[[object, int], tuple[int, int] | None]


def gram_size(least: int = LEAST, exponent: int = EXPONENT) -> int:
    """The largest k such that every k-gram of a run stands in the run twice."""
    return max(1, min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2)))


def repeated_stretches(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end word of each longest stretch whose k-grams all stand in their
    row twice or more. ``first``: each row's first word (rows + 1)."""
    n = len(hashes) - k + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(n, U64)
    for i in range(k):
        gram = gram * _ROLL + hashes[i : i + n]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    whole = np.arange(n) + k <= first[row + 1]
    gram = mix(gram + row.astype(U64) * U64(0xD6E8FEB86659FD93))
    at = np.flatnonzero(whole)
    order = at[np.argsort(gram[at])]
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(n + 2, bool)  # moved by one, with ends that are False
    twice[order[1:][same] + 1] = True
    twice[order[:-1][same] + 1] = True
    # A stretch ends with its row, too, although the next row's may begin at once.
    inside, begins = twice[1:-1], np.zeros(n, bool)
    begins[first[:-1][first[:-1] < n]] = True
    start = np.flatnonzero(inside & (~twice[:-2] | begins))
    ends = np.append(begins[1:], True)
    end = np.flatnonzero(inside & (~twice[2:] | ends)) + k
    return start, end


class Extensions:
    """Common extensions of two places of a sequence, to the right and to the left."""

    def __init__(self, values: np.ndarray):
        self.names = [values.astype(np.int32)]
        width, n = 1, len(values)
        while 2 * width <= n:
            low = self.names[-1].astype(np.int64)
            pair = low[: n - 2 * width + 1] * (low.max() + 1) + low[width : n - width + 1]
            seen, names = np.unique(pair, return_inverse=True)
            self.names.append(names.astype(np.int32))
            if len(seen) == len(pair):  # nothing of this width stands there twice
                break
            width *= 2
        self.size = n

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places from ``a`` and ``b`` (a < b) on are equal."""
        done = np.zeros(len(a), np.int64)
        # The widest names may be equal several times in a row.
        for level in range(len(self.names) - 1, -1, -1):
            width, names = 1 << level, self.names[level]
            live = np.arange(len(a))
            while len(live):
                y = b[live] + done[live]
                fits = y < len(names)
                live, y = live[fits], y[fits]
                equal = names[y] == names[a[live] + done[live]]
                live = live[equal]
                done[live] += width
                if level < len(self.names) - 1:
                    break
        return done

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places before ``a`` and ``b`` (a < b, themselves not counted) are equal."""
        done = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, names = 1 << level, self.names[level]
            live = np.arange(len(a))
            while len(live):
                x = a[live] - done[live] - width
                fits = x >= 0
                live, x = live[fits], x[fits]
                equal = names[x] == names[b[live] - done[live] - width]
                live = live[equal]
                done[live] += width
                if level < len(self.names) - 1:
                    break
        return done


def main_lorentz(values: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Start, past-the-end place and smallest period of every run within the stretches of
    ``values``, which are parted by values that stand nowhere else."""
    lows, highs, found = start, end, []
    longer = Extensions(values) if len(start) else None
    while True:
        big = highs - lows >= least
        lows, highs = lows[big], highs[big]
        if not len(lows):
            break
        middle = (lows + highs) // 2
        most = np.maximum((highs - lows) // exponent, 1)
        part = np.repeat(np.arange(len(lows)), most)
        q = np.arange(len(part)) - np.repeat(np.cumsum(most) - most, most) + 1
        m = middle[part]
        for a in (m, m - q):  # a period to the right of the middle, and one to its left
            b = a + q
            ok = (a >= 0) & (b < len(values))
            x, y, p = a[ok], b[ok], q[ok]
            # One of the extensions has half of the overlap, so the next word or the last one is equal.
            near = (values[x] == values[y]) | ((x > 0) & (values[np.maximum(x - 1, 0)] == values[y - 1]))
            x, y, p = x[near], y[near], p[near]
            s, e = x - longer.left(x, y), y + longer.right(x, y)
            runs = e - s >= np.maximum(least, exponent * p)
            found.append(np.stack([s[runs], e[runs], p[runs]], axis=1))
        lows, highs = np.concatenate([lows, middle]), np.concatenate([middle, highs])
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end and period
    # A stretch of four periods that also has a smaller one has that as a divisor, and both
    # reach equally far: the smallest comes first.
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs


def find_runs(data: np.ndarray, offsets: np.ndarray, plans: list[tuple[int, int, int]] = (), least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and (start, length, period) by start and period, of every run of whole texts,
    and each row's number of words. ``plans``: rows whose words repeat from a word on with a
    period, as (row, word, period)."""
    hashes, first = word_hashes(data, offsets, lower=False)
    source = None
    if plans:
        source = np.arange(len(hashes))
        for r, a, p in plans:
            n = first[r + 1] - first[r]
            source[first[r] + a : first[r + 1]] = first[r] + a + np.arange(n - a) % p
        hashes = hashes[source]
    start, end = repeated_stretches(hashes, first, gram_size(least, exponent))
    size = end - start
    long = size >= least
    start, end, size = start[long], end[long], size[long]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.diff(first)
    # Exact names of the words of the stretches, with a separator of its own after each.
    moved = np.cumsum(size + 1) - size - 1
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    place = at + np.repeat(start - moved, size)
    names = word_names(data, offsets, place if source is None else source[place])
    values = np.empty(int(size.sum()) + len(size), np.int64)
    values[at] = names
    values[moved + size] = (names.max() + 1) + np.arange(len(size))
    runs = main_lorentz(values, moved, moved + size, least, exponent)
    stretch = np.searchsorted(moved, runs[:, 0], side="right") - 1
    word = start[stretch] + runs[:, 0] - moved[stretch]
    row = np.searchsorted(first, word, side="right") - 1
    order = np.lexsort([runs[:, 2], word])
    out = np.stack([word - first[row], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return row[order], out[order], np.diff(first)


def word_names(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """A number for each of the words ``which``: equal for equal bytes, and only for those."""
    start, end, _ = word_bounds(data, offsets)
    start, end = start[which], end[which]
    length = end - start
    ends = np.cumsum(length)
    chars = data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start, length)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(chars)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def planted(doc_id: object, n: int) -> tuple[int, int] | None:
    """Of every tenth id (by its checksum) the words repeat from some word on."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run has after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def described(data: np.ndarray, offsets: np.ndarray, ids: list, plan: Plan | None, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs and collapsed text of each row."""
    rows: list[list[bytes]] = []
    raw, plans = data.tobytes(), []
    for r, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        words = raw[a:z].split()  # at the six ASCII white-space bytes
        if plan and (made := plan(ids[r], len(words))):
            a, p = made
            n = len(words) - a
            words[a:] = (words[a : a + p] * (n // p + 1))[:n]
            plans.append((r, a, p))
        rows.append(words)
    row, runs, _ = find_runs(data, offsets, plans, least, exponent)
    cut = np.searchsorted(row, np.arange(len(rows) + 1))
    for r, words in enumerate(rows):
        own = runs[cut[r] : cut[r + 1]]
        yield own, b" ".join(kept_words(words, own))


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse(docs: DataFrame, text: str = "text", plan: Plan | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Ids, all runs (start, length, period) and the text without the words that repeat."""
    def rows(found, ids):
        runs = [x.tolist() for x, _ in found]
        flat = [{"start": s, "length": n, "period": q} for own in runs for s, n, q in own]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.array(flat, pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        return [lists, pa.array([t.decode(errors="replace") for _, t in found], pa.string())]

    return _by_row(docs, text, plan, least, exponent, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", rows)


def digests(docs: DataFrame, text: str = "text", plan: Plan | None = planted, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Ids, number of runs, the longest run, and digests of all runs and of the collapsed text."""

    def rows(found, ids):
        columns: list[list] = [[] for _ in range(7)]
        for runs, kept in found:
            best = min(runs.tolist(), key=lambda x: (-x[1], x[0], x[2]), default=None)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
            values = [len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]

    return _by_row(docs, text, plan, least, exponent, SCHEMA, rows)


def _by_row(docs: DataFrame, text: str, plan: Plan | None, least: int, exponent: int, schema: str, make: Callable) -> DataFrame:
    ship(docs.sparkSession)
    given = docs.select("doc_id", F.col(text).alias("text"))
    out = T.StructType([given.schema["doc_id"], *T.StructType.fromDDL(schema).fields])

    def run(batches):
        for batch in batches:
            done = 0
            for data, offsets in pieces(batch.column("text")):
                n = len(offsets) - 1
                ids = batch.column("doc_id").slice(done, n)
                done += n
                found = list(described(data, offsets, ids.to_pylist(), plan, least, exponent))
                yield pa.RecordBatch.from_arrays([ids, *make(found, ids)], out.names)

    return given.mapInArrow(run, out)
