"""Benchmark decontamination by greedy string tiling.

Texts are sequences of terms (runs of letters and digits, ``A``-``Z`` as ``a``-``z``).
Windows of ``least`` terms that a text and a benchmark item share are the seeds; a text
whose seeds could cover enough of an item is tiled against it: the longest common run of
unmarked terms is found by running Karp-Rabin over both, marked in both, and so on until no
run of ``least`` terms is left. The share of the item's terms in tiles is its coverage;
since tiles may stand in any order, passages that were cut up and reordered count in full.

The benchmark's seeds go to the executors in parts whose size is measured before; a larger
benchmark takes more parts, each held against all texts.

Cases: null or empty texts and items match nothing; an item of fewer than ``least`` terms
must occur whole; an item that repeats matches under each of its rows; rows of texts that
repeat give repeated matches; a text of any length is searched whole; without texts or
without items there are no matches; extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import pieces
from tessera.llm.textkernel import shingles, term_hashes
from tessera.plans.runtime import Scratch, ship

LEAST = 4
COVERAGE = 0.5
#: Bytes of benchmark text whose seeds are held at once.
PART_BYTES = 8 << 20
_FILTER_BITS = 20
_MASK, _MULTIPLIER = (1 << 61) - 1, 0x1F35_91D7_6C2B_0E55


def _windows(tokens: list[int], taken: list[bool], size: int):
    """Start and running hash of each window of unmarked terms."""
    top, h, run = pow(_MULTIPLIER, size - 1, _MASK), 0, 0
    for i, x in enumerate(tokens):
        if taken[i]:
            h, run = 0, 0
            continue
        if run == size:
            h = (h - tokens[i - size] * top) % _MASK
            run -= 1
        h, run = (h * _MULTIPLIER + x) % _MASK, run + 1
        if run == size:
            yield i - size + 1, h


def _starts(tokens: list[int], taken: list[bool], size: int) -> dict[int, list[int]]:
    """Where the windows of each running hash start, in order."""
    at: dict[int, list[int]] = {}
    for i, h in _windows(tokens, taken, size):
        at.setdefault(h, []).append(i)
    return at


def _shared(text: list[int], item: list[int], text_taken: list[bool], item_taken: list[bool], size: int) -> bool:
    """Whether a window of this size stands in both (verified)."""
    first: dict[int, int] = {}
    for j, h in _windows(item, item_taken, size):
        first.setdefault(h, j)
    for i, h in _windows(text, text_taken, size):
        j = first.get(h)
        if j is not None and text[i : i + size] == item[j : j + size]:
            return True
    return False


def tile(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length), the longest first; of equal
    ones the earlier in the item, then in the text. 0 in ``text`` parts pieces of it.

    A length's tiles are dealt out in one walk: a window of the text that a tile has reached
    stays closed, so each window of either side is looked at once, however often it repeats.
    """
    text_taken, item_taken = [x == 0 for x in text], [False] * len(item)
    tiles, size = [], min(len(item), len(text))
    while size >= least:
        low, high = least, size  # the longest length at which a window still matches
        if not _shared(text, item, text_taken, item_taken, least):
            break
        while low < high:
            middle = (low + high + 1) // 2
            if _shared(text, item, text_taken, item_taken, middle):
                low = middle
            else:
                high = middle - 1
        size = low
        open_ = {h: iter(i) for h, i in _starts(text, text_taken, size).items()}
        for j, h in list(_windows(item, item_taken, size)):
            if h not in open_ or item_taken[j] or item_taken[j + size - 1]:
                continue
            for i in open_[h]:
                # All tiles of this walk are of one length: one that overlaps covers an end.
                if not text_taken[i] and not text_taken[i + size - 1] and text[i : i + size] == item[j : j + size]:
                    text_taken[i : i + size] = item_taken[j : j + size] = [True] * size
                    tiles.append((i, j, size))
                    break
        size -= 1
    return tiles


@dataclass
class Index:
    """Seeds of one part of a benchmark."""

    least: int
    coverage: float
    ids: list[int]
    tokens: np.ndarray
    first: np.ndarray
    seeds: np.ndarray  # distinct, ascending
    places: np.ndarray  # item and position of each seed's occurrences
    place_first: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: pa.Array, least: int, coverage: float) -> Index:
        parts = [term_hashes(d, o) for d, o in pieces(texts)]
        tokens = np.concatenate([t for t, _ in parts]) if parts else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))]) if parts else np.zeros(1, np.int64)
        sizes, windows = np.diff(first), []
        for k in range(1, least + 1):  # items shorter than ``least`` have windows of their own size
            h, f = shingles(tokens, first, k)
            row = np.repeat(np.arange(len(sizes)), np.diff(f))
            place = np.arange(len(h)) - f[row]
            use = (sizes[row] >= least) if k == least else (sizes[row] == k)
            windows.append(np.stack([h[use], row[use].astype(np.uint64), place[use].astype(np.uint64)]))
        all_windows = np.concatenate(windows, axis=1)
        order = np.argsort(all_windows[0], kind="stable")
        h, places = all_windows[0][order], all_windows[1:, order].astype(np.int64).T
        seeds, start = np.unique(h, return_index=True)
        quick = np.zeros(1 << _FILTER_BITS, dtype=bool)
        quick[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(least, coverage, ids, tokens, first, seeds, places, np.append(start, len(h)), quick)

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item id, coverage, tiles, longest) of the texts' matches."""
        if not len(self.seeds):
            return
        tokens, first = term_hashes(data, offsets)
        sizes = np.diff(self.first)
        for k in [*sorted({int(n) for n in sizes if 0 < n < self.least}), self.least]:
            h, f = shingles(tokens, first, k)
            near = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            seed = np.searchsorted(self.seeds, h[near])
            hit = self.seeds[np.minimum(seed, len(self.seeds) - 1)] == h[near]
            near, seed = near[hit], seed[hit]
            row = np.searchsorted(f, near, side="right") - 1
            whole = first[row + 1] - first[row] >= k
            near, seed, row = near[whole], seed[whole], row[whole]
            yield from self._of_size(k, tokens, near - f[row] + first[row], row, seed, np.minimum(sizes, self.least) == k)

    def _of_size(self, k: int, tokens: np.ndarray, at: np.ndarray, row: np.ndarray, seed: np.ndarray, fits: np.ndarray):
        """Matches by windows of ``k`` terms, which stand in the text ``at`` the places. A
        text's seed is held against the items once, however often the text repeats it."""
        row_seed = np.unique(row * len(self.seeds) + seed)
        own_row, own_seed = np.divmod(row_seed, len(self.seeds))
        count = self.place_first[own_seed + 1] - self.place_first[own_seed]
        which = np.arange(count.sum()) + np.repeat(self.place_first[own_seed] - np.cumsum(count) + count, count)
        own_row, own_seed = np.repeat(own_row, count), np.repeat(own_seed, count)
        item, place = self.places[which, 0], self.places[which, 1]
        use = fits[item]
        own_row, own_seed, item, place = own_row[use], own_seed[use], item[use], place[use]
        if not len(item):
            return
        order = np.lexsort((item, own_row))
        own_row, own_seed, item, place = own_row[order], own_seed[order], item[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], (own_row[1:] != own_row[:-1]) | (item[1:] != item[:-1])]))
        rows_from = np.searchsorted(row, np.arange(int(row[-1]) + 2))
        for a, z in zip(cuts, np.append(cuts[1:], len(item)), strict=True):
            r, n = int(own_row[a]), int(item[a])
            size = int(self.first[n + 1] - self.first[n])
            covered = np.zeros(size + 1, np.int64)
            np.add.at(covered, place[a:z], 1)
            np.add.at(covered, place[a:z] + k, -1)
            if (np.cumsum(covered[:-1]) > 0).sum() < self.coverage * size:
                continue
            mine = slice(rows_from[r], rows_from[r + 1])
            starts = at[mine][np.isin(seed[mine], own_seed[a:z])]
            places = np.unique((starts[:, None] + np.arange(k)).ravel())
            # Terms that no seed covers cannot be in a tile: 0 stands for each gap.
            parted = np.insert(tokens[places], np.flatnonzero(np.diff(places) > 1) + 1, np.uint64(0))
            tiles = tile((parted >> np.uint64(4)).tolist(), (self.tokens[self.first[n] : self.first[n + 1]] >> np.uint64(4)).tolist(), k)
            share = sum(t[2] for t in tiles) / size
            if share >= self.coverage:
                yield r, self.ids[n], share, len(tiles), max(t[2] for t in tiles)


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's rows in parts of at most PART_BYTES, or single items. A part comes to
    the driver when it is its turn."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    parts = 1
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        most = dealt.groupBy("part").agg(F.sum(F.octet_length("text")).alias("b"), F.countDistinct("item_id").alias("n")).where(f"b > {PART_BYTES} AND n > 1")
        if most.isEmpty():
            break
        parts *= 4
    return [dealt.where(F.col("part") == p).orderBy("item_id", "text") for p in range(parts)]


def _by_parts(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float, against, chained: bool) -> list[DataFrame]:
    """``against`` each part of the benchmark: the texts, or what is left of them. Where
    there are several parts, each one's result is written and its index given up before the
    next is made, so one part is held at a time."""
    spark, parts, found = docs.sparkSession, _parts(benchmark), []
    ship(spark)
    scratch = Scratch(spark, "tiling")
    for n, part in enumerate(parts):
        t = part.toArrow()
        shared = spark.sparkContext.broadcast(Index.of(t["item_id"].to_pylist(), t["text"].combine_chunks(), least, coverage))
        out = against(docs, shared)
        if len(parts) > 1:
            out = scratch.save(out, f"part-{n}")
            shared.destroy()
            if chained and n:
                scratch.drop(f"part-{n - 1}")
        if chained:
            docs, found = out, [out]
        else:
            found.append(out)
    return found


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text and item whose coverage reaches the threshold: the key,
    ``item_id``, ``coverage``, ``n_tiles``, ``longest_tile``."""
    schema = docs.select(key).schema.add("item_id", "long").add("coverage", "double").add("n_tiles", "integer").add("longest_tile", "integer")

    def against(source, shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                done, rows = 0, []
                for data, offsets in pieces(batch.column(text)):
                    rows += [(done + r, *m) for r, *m in index.matches(data, offsets)]
                    done += len(offsets) - 1
                at, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                types = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], schema.names)

        return source.mapInArrow(run, schema)

    found = _by_parts(docs.select(key, text), benchmark, least, coverage, against, chained=False)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The rows of texts that match no item, with all their columns."""

    def against(source, shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                keep, done = np.ones(len(batch), dtype=bool), 0
                for data, offsets in pieces(batch.column(text)):
                    keep[[done + m[0] for m in index.matches(data, offsets)]] = False
                    done += len(offsets) - 1
                yield batch.filter(pa.array(keep))

        return source.mapInArrow(run, source.schema)

    return _by_parts(docs, benchmark, least, coverage, against, chained=True)[-1]
