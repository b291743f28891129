"""Spelling variants: words one edit apart, and the frequent form that each stands for.

Words are runs of Latin letters (``A``-``Z``, ``a``-``z``, U+00C0 to U+00FF) of at least
``LETTERS`` code points that occur ``TWICE`` times or more; only ``A``-``Z`` are lower-cased.

Full neighbourhood generation: of every word all distinct deletions, replacements and
insertions over the observed alphabet are emitted (some 2 x length x alphabet, each once) and
joined to the vocabulary by equality, so a match is a near word and no distance is verified.
Before the join the emitting tasks look each candidate up in a bit table of the vocabulary's
hashes, which leaves out nothing that is a word and about one in a thousand of what is none.
Only what passes is written out as a word and shuffled. The table has 16 bits or more a word
and at most ``TABLE_BITS``; a vocabulary that needs more is worked through in slices of its
hashes, one table after another, the words emitting each slice's candidates.

A word's form is its near word of the largest count, where that is ``ratio`` times its own or
more. Counts grow ``ratio``-fold along forms, so the last form is reached in a number of
doubled steps that the largest count bounds.

Inside, words are Latin-1 bytes: one byte a code point, in code-point order.

Cases: a null or empty text has no words; a null id is written as nothing before the colon;
texts of any length are read in pieces that end between words; repeated rows count each
time; ties for a form go to the word that is smaller in code-point order; without words the
result is empty; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkernel import CHUNK_BYTES, utf8
from tessera.plans.runtime import Scratch, ship

LETTERS = 7
TWICE = 2
RATIO = 10
#: Of ids and words together, one in so many loses a code point.
SLIP = 31
TABLE_BITS = 1 << 29
#: Parts of a table that are made apart, at most, and bits of a part, at least.
SECTIONS, LEAST_SECTION = 256, 1 << 16
#: Candidates worked on at once, about.
BLOCK = 1 << 18
#: Words of a task, about.
TASK_WORDS = 8_000
U64 = np.uint64

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF, and of nothing else
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(13))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_SPREAD = [U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)]


def crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span's bytes after those that led to its ``state``."""
    order = np.argsort(start - end, kind="stable")  # the longest first
    at, shorter = start[order], (start - end)[order]
    plain = int(np.searchsorted(shorter, -64, side="left"))  # spans of over 64 bytes, one by one
    crc = ~state[order]
    for i in range(-int(shorter[plain]) if plain < len(at) else 0):
        live = slice(plain, int(np.searchsorted(shorter, -i, side="left")))
        crc[live] = _CRC[(crc[live] ^ data[at[live] + i]) & 0xFF] ^ (crc[live] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for j in order[:plain].tolist():
        out[j] = zlib.crc32(data[start[j] : end[j]].tobytes(), int(state[j]))
    return out


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each span one after another, and where each begins (spans + 1)."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)], ends


def windows(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounded pieces of all bytes, ended where no word goes on; a longer word stands whole."""
    a, n = 0, len(data)
    while a < n:
        z = a + limit
        while z < n:
            part = data[z : z + limit]
            parted = np.flatnonzero(~(_LETTER[part] | (part == _LEAD) | (data[z - 1 : z - 1 + len(part)] == _LEAD)))
            ahead = z + (int(parted[0]) if len(parted) else len(part))
            row = int(offsets[np.searchsorted(offsets, z)])
            z = min(ahead, row)
            if len(parted) or row <= ahead:
                break
        yield a, min(z, n)
        a = z


def spelled(data: np.ndarray, offsets: np.ndarray, ids: list, letters: int = LETTERS, slip: int = SLIP) -> Iterator[pa.Array]:
    """The words of whole texts, as Latin-1 bytes, with the slips that ids and words call for."""
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    for a, z in windows(data, offsets):
        part = _LOWER[data[a:z]]
        lead = part == _LEAD
        second = np.zeros(len(part), bool)
        second[1:] = lead[:-1]
        inside = np.concatenate([[False], _LETTER[part] | lead | second, [False]])
        cut = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, z)] - a
        opens = ~inside[:-1]
        opens[cut] = True
        start = np.flatnonzero(inside[1:-1] & opens[:-1])
        closes = ~inside[1:]
        closes[cut] = True
        end = np.flatnonzero(inside[1:-1] & closes[1:]) + 1
        points = np.concatenate([[0], np.cumsum(~lead)])
        size = points[end] - points[start]
        long = size >= letters
        start, end, size = start[long], end[long], size[long]
        row = np.searchsorted(offsets, start + a, side="right") - 1
        crc = crc_on(prefix[row], part, start, end)
        # One byte a code point.
        latin = part + np.where(second, np.uint8(0x40), np.uint8(0))
        chars, first = gathered(latin[~lead], points[start], size)
        slips = np.flatnonzero(crc % np.uint32(slip) == 0)
        whole = np.ones(len(chars), bool)
        whole[first[slips] + crc[slips] % size[slips]] = False
        size[slips] -= 1
        chars, ends = chars[whole], np.concatenate([[0], np.cumsum(size)])
        words = binaries(chars, ends)
        yield words.filter(pa.array(size >= letters)) if (size < letters).any() else words


def binaries(chars: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(chars))])


def vocabulary(docs: DataFrame, text: str = "text", letters: int = LETTERS, twice: int = TWICE, slip: int = SLIP) -> DataFrame:
    """Words (``w``, Latin-1 bytes) of at least ``twice`` occurrences, and their number ``n``."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = list(spelled(data, offsets, batch.column("doc_id").to_pylist(), letters, slip))
            for counts in [pa.chunked_array(found, pa.binary()).value_counts()] if found else []:
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["w", "n"])

    counted = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "w binary, n long")
    return counted.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which words have each length, and their code points as rows of a matrix."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        yield which, data[offsets[which][:, None] + np.arange(n)]


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def hashes(chars: np.ndarray) -> np.ndarray:
    """Of words of one length: a polynomial in their code points, the first lowest."""
    return (_VALUE[chars] * powers(chars.shape[1] + 1)[:-1]).sum(axis=1, dtype=U64)


class Table:
    """Bits at two places for each hash of a slice of the vocabulary."""

    def __init__(self, bits: int, slices: int, number: int, sections: dict[int, bytes] | None = None):
        self.shift, self.slices, self.number = U64(64 - (bits.bit_length() - 1)), slices, number
        self.bytes = np.zeros(bits // 8 if sections else 0, np.uint8)
        for section, own in (sections or {}).items():
            self.bytes[section * len(own) :][: len(own)] = np.frombuffer(own, np.uint8)

    def within(self, h: np.ndarray) -> np.ndarray:
        """The hashes of this slice: its place among equal parts of the middle bits."""
        return ((h >> U64(20)) & U64(0xFFFFF)) * U64(self.slices) >> U64(20) == self.number

    def places(self, h: np.ndarray, k: int) -> np.ndarray:
        return (h * _SPREAD[k]) >> self.shift

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be the vocabulary's, ascending."""
        at = np.flatnonzero(self.within(h)) if self.slices > 1 else None
        for k in range(2):
            p = self.places(h if at is None else h[at], k)
            hit = np.flatnonzero(self.bytes[p >> U64(3)] >> (p & U64(7)).astype(np.uint8) & 1)
            at = hit if at is None else at[hit]
        return at


def neighbours(chars: np.ndarray, alphabet: np.ndarray, table: Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All distinct words one edit from each row of ``chars``, of those that the table holds:
    row numbers, and the words' code points as a matrix. Deletions of a repeated code point
    and insertions after an equal one come once."""
    rows, n = chars.shape
    up, wide = powers(n + 2), len(alphabet)
    value = _VALUE[chars] * up[:n]
    before = np.concatenate([np.zeros((rows, 1), U64), np.cumsum(value, axis=1, dtype=U64)], axis=1)
    whole = before[:, -1:]
    after = whole - before  # of the code points from each place on
    letters = _VALUE[alphabet]
    again = np.zeros((rows, n + 1), bool)  # equal to the code point before
    again[:, 1:n] = chars[:, 1:] == chars[:, :-1]

    lower = U64(pow(_BASE, -1, 1 << 64))
    h = before[:, :n] + after[:, 1:] * lower
    hit = table.holds(h.ravel())
    r, i = np.divmod(hit, n)
    keep = ~again[r, i]
    r, i = r[keep], i[keep]
    left = np.arange(n - 1)
    yield r, chars[r[:, None], left + (left >= i[:, None])]

    step = max(1, BLOCK // (rows * wide))
    for a in range(0, n, step):
        z = min(a + step, n)
        h = (whole - value[:, a:z])[:, :, None] + letters * up[a:z, None]
        hit = table.holds(h.ravel())
        r, i, c = np.unravel_index(hit, h.shape)
        i += a
        other = chars[r, i] != alphabet[c]
        r, i, c = r[other], i[other], c[other]
        out = chars[r]
        out[np.arange(len(r)), i] = alphabet[c]
        yield r, out

    moved = after * U64(_BASE)
    for a in range(0, n + 1, step):
        z = min(a + step, n + 1)
        h = (before[:, a:z] + moved[:, a:z])[:, :, None] + letters * up[a:z, None]
        hit = table.holds(h.ravel())
        r, i, c = np.unravel_index(hit, h.shape)
        i += a
        new = (i == 0) | (chars[r, np.maximum(i - 1, 0)] != alphabet[c])
        r, i, c = r[new], i[new], c[new]
        place = np.arange(n + 1)
        out = np.concatenate([chars, chars[:, -1:]], axis=1)[r[:, None], place - (place > i[:, None])]
        out[np.arange(len(r)), i] = alphabet[c]
        yield r, out


def slices_of(words: int, most: int = TABLE_BITS) -> tuple[int, int]:
    """Bits of a table and number of slices for so many words."""
    need = max(LEAST_SECTION, 16 * words)
    slices = math.ceil(need / most)
    return min(most, 1 << (math.ceil(need / slices) - 1).bit_length()), slices


def _sections(words: DataFrame, bits: int, slices: int, number: int) -> dict[int, bytes]:
    """The table's bytes in at most ``SECTIONS`` parts, each made by one task from the places
    that the words' tasks send to it."""
    ship(words.sparkSession)
    sections = min(SECTIONS, bits // LEAST_SECTION)
    size = bits // sections

    def sent(batches):
        table = Table(bits, slices, number)
        for batch in batches:
            h = np.concatenate([np.zeros(0, U64), *(hashes(chars) for _, chars in by_length(batch.column("w")))])
            h = h[table.within(h)]
            places = np.sort(np.concatenate([table.places(h, k) for k in range(2)]).astype(np.int64))
            cuts = np.searchsorted(places, np.arange(sections + 1) * size)
            some = np.flatnonzero(np.diff(cuts))
            packed = [(places[cuts[i] : cuts[i + 1]] - i * size).astype(np.uint32).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(packed, pa.binary())], ["section", "places"])

    def merged(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for section, packed in zip(batch.column("section").to_pylist(), batch.column("places").to_pylist(), strict=True):
                bytes_ = own.setdefault(section, np.zeros(size // 8, np.uint8))
                p = np.frombuffer(packed, np.uint32)
                np.bitwise_or.at(bytes_, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        for section, bytes_ in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([section], pa.int64()), pa.array([bytes_.tobytes()], pa.binary())], ["section", "places"])

    schema = "section long, places binary"
    rows = words.select("w").mapInArrow(sent, schema).repartition(sections, "section").mapInArrow(merged, schema).toArrow()
    return dict(zip(rows["section"].to_pylist(), rows["places"].to_pylist(), strict=True))


def near_counts(words: DataFrame, total: int, alphabet: np.ndarray, scratch: Scratch, most: int = TABLE_BITS) -> DataFrame:
    """For each word with near words: their number ``n_near``, and the one of largest count
    (``best``: its count negated, and itself)."""
    spark = words.sparkSession
    bits, slices = slices_of(total, most)
    parts = []
    for number in range(slices):
        shared = spark.sparkContext.broadcast(Table(bits, slices, number, _sections(words, bits, slices, number)))

        def run(batches, shared=shared):
            table = shared.value
            for batch in batches:
                counts = batch.column("n")
                for which, chars in by_length(batch.column("w")):
                    step = max(1, BLOCK // (chars.shape[1] * 4))
                    for a in range(0, len(which), step):
                        for r, made in neighbours(chars[a : a + step], alphabet, table):
                            if len(r):
                                source = pa.array(which[a + r])
                                candidates = binaries(made.ravel(), np.arange(len(r) + 1) * made.shape[1])
                                yield pa.RecordBatch.from_arrays([candidates, batch.column("w").take(source), counts.take(source)], ["w", "near", "n"])

        tasks = max(1, math.ceil(total / TASK_WORDS))
        found = words.select("w", "n").repartition(tasks).mapInArrow(run, "w binary, near binary, n long")
        # Counted per candidate, which the join then holds against the vocabulary.
        summed = found.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
        parts.append(scratch.save(summed.join(words.select("w"), "w"), f"near-{number}"))
        shared.destroy()
    return parts[0] if slices == 1 else _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Slices are of different words, so their rows stand side by side."""
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def as_text(word: Column) -> Column:
    return F.decode(word, "ISO-8859-1")


def variants(docs: DataFrame, text: str = "text", letters: int = LETTERS, twice: int = TWICE, ratio: int = RATIO, slip: int = SLIP, most: int = TABLE_BITS) -> DataFrame:
    """Each word with its form, root, counts and number of near words."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could go in circles")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, text, letters, twice, slip), "words")
    total, top = words.agg(F.count("*"), F.max("n")).first()
    if not total:
        none = F.lit(None).cast("string")
        return words.select(as_text("w").alias("word"), none.alias("form"), none.alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    letters_seen = words.select(F.explode(F.split(as_text("w"), "")).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters_seen.collect()), np.uint8)  # of 90 code points at most
    near = near_counts(words, total, alphabet, scratch, most)
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(near, "w", "left").select("w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = scratch.save(rows, "forms")
    scratch.drop_all_but("forms")
    roots = rows.where("form IS NOT NULL").select("w", F.col("form").alias("root"))
    for step in range(math.ceil(math.log2(math.log(top, ratio) + 1))):
        onward = roots.select(F.col("w").alias("root"), F.col("root").alias("onward"))
        roots = scratch.save(roots.join(onward, "root", "left").select("w", F.coalesce("onward", "root").alias("root")), f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
    made = rows.join(roots, "w", "left")
    return made.select(as_text("w").alias("word"), as_text("form").alias("form"), as_text(F.coalesce("root", "w")).alias("root"), "n", "n_near", "form_n")
