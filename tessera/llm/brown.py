"""Language-model scores by Brown class-based n-grams.

``P(text) = prod P(class_i | class_{i-1}) * P(word_i | class_i)`` over a text's words and
one end. The most frequent words of the training texts are assigned to classes by exchange
clustering: word by word, each goes to the class that gains most likelihood of the class
bigrams, until nothing moves. Every other word that occurs ``OFTEN`` times goes to the class
that gains most from the classes of its neighbours, which buckets of words add up. Rarer
words and words that training texts don't have are one class more. Class transitions are
counted over all classes then, smoothed by the class frequencies, emissions by one more
count a word.

The words with classes, 17 bytes for each, are sent out. Should more than ``LEXICON`` words
occur ``OFTEN`` times, those are sent that occur twice as often, or twice that, until they
are no more. The others keep their classes in the buckets of their counts: packets of texts
leave the bigrams with such words open until the buckets have told their classes. The
scores are the same.

Words are carried as 64-bit hashes. Counting: packets of texts give each word's count once,
buckets of the hash range add them up, so a frequent word is one entry a packet. Scoring:
a text's transitions and words with classes are scored where it is read; of its other words,
each packet asks the buckets for their counts (and classes), once for each word.

Cases: a null or empty text is the end alone; without training texts all words are unknown
and the base is 0; a text of any length is scored whole; repeated rows score alike; extra
columns pass through unless they have a new column's name; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import bucket_runs, packing
from tessera.llm.textkernel import row_sums, span_hashes, spans, utf8, word_bounds
from tessera.plans.runtime import Scratch, ship, shuffle_partitions

#: Words that exchange clustering assigns, and its classes.
HEAD, CLASSES = 1000, 48
#: The class of rare and unseen words, the end, the start; how many there are with these.
REST, END, START, SIZE = CLASSES, CLASSES + 1, CLASSES + 2, CLASSES + 3
#: Occurrences from which on a word's neighbours decide its class, and the most such words
#: that are sent out.
OFTEN, LEXICON = 3, 2 << 20
#: How often ``OFTEN`` can be doubled to find those.
DOUBLINGS = 40
#: Weight, in counts, of the class frequencies in a transition.
PRIOR = 5.0
PACKET, PACKET_DOCS, BUCKET_BYTES = 1_000_000, 50_000, 8 << 20


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and each row's first word."""
    start, end, first = word_bounds(data, offsets)
    return span_hashes(data, start, end), first


def _pieces(texts):
    """Runs of rows within a batch: first row, bytes, offsets."""
    data, offsets = utf8(texts)
    for a, z in spans(offsets):
        yield a, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts' sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


# ---- counting ---------------------------------------------------------------------------


def _count_packets(packet: int, buckets: int):
    names, types = ["bucket", "words", "counts"], [pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        held, n = [], 0

        def flush():
            nonlocal held, n
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
            return _batch([(b, found[a:z].tobytes(), counts[a:z].astype(np.uint32).tobytes()) for b, a, z in bucket_runs(found, buckets)], names, types)

        for batch in batches:
            for _, data, offsets in _pieces(batch.column("text")):
                held.append(read_words(data, offsets)[0])
                n += len(held[-1])
                if n >= packet:
                    yield flush()
        if n:
            yield flush()

    return run


def _add_counts(key, t):
    """A bucket's words with their counts, as arrays, and its figures: how many words and
    how many of their occurrences reach ``OFTEN`` and its doublings, and the top words."""
    words, counts = _added(*(np.concatenate([np.frombuffer(x, d) for x in t[c].to_pylist()]) for c, d in (("words", np.uint64), ("counts", np.uint32))))
    top = np.lexsort((words, -counts))[:HEAD]
    reach = [counts[counts >= OFTEN << k] for k in range(DOUBLINGS)]
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()], pa.int64()),
            "words": pa.array([words.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "n": pa.array([counts.sum()], pa.int64()),
            "v": pa.array([len(words)], pa.int64()),
            "reach_n": pa.array([[int(x.sum()) for x in reach]], pa.list_(pa.int64())),
            "reach_v": pa.array([[len(x) for x in reach]], pa.list_(pa.int64())),
            "top": pa.array([[{"w": int(words[i].view(np.int64)), "c": int(counts[i])} for i in top]], pa.list_(pa.struct([("w", pa.int64()), ("c", pa.int64())]))),
        }
    )


_COUNTED = "bucket long, words binary, counts binary, n long, v long, reach_n array<long>, reach_v array<long>, top array<struct<w:long,c:long>>"


# ---- the model --------------------------------------------------------------------------


@dataclass
class Words:
    """Words by ascending hash, with their counts, and a quick test for them."""

    words: np.ndarray
    counts: np.ndarray
    quick: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray) -> Words:
        order = np.argsort(words)
        bits = min(24, max(16, (8 * len(words)).bit_length()))
        quick = np.zeros(1 << bits, dtype=bool)
        quick[(words >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(words[order], counts[order], quick)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Each word's place, -1 for none."""
        out = np.full(len(words), -1, dtype=np.int32)
        if len(self.words):
            maybe = np.flatnonzero(self.quick[(words >> np.uint64(65 - len(self.quick).bit_length())).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, words[maybe]), len(self.words) - 1)
            same = self.words[at] == words[maybe]
            out[maybe[same]] = at[same]
        return out


@dataclass
class Lexicon:
    """The class of each word that has one of its own and is sent out; of the words that have
    one in buckets, each class's occurrences and number, if there are any."""

    words: Words
    label: np.ndarray
    kept: np.ndarray | None = None

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, label: np.ndarray) -> Lexicon:
        return cls(Words.of(words, counts), label[np.argsort(words)].astype(np.uint8))

    def classes_at(self, place: np.ndarray) -> np.ndarray:
        out = np.full(len(place), REST, dtype=np.int64)
        out[place >= 0] = self.label[place[place >= 0]]
        return out

    def classes_of(self, words: np.ndarray) -> np.ndarray:
        return self.classes_at(self.words.find(words))


def _followers(symbols: np.ndarray, first: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right symbols of all bigrams of the rows, with a start and an end each."""
    left = np.full(len(symbols) + len(first) - 1, start, dtype=np.int64)
    left[np.arange(len(symbols)) + np.repeat(np.arange(1, len(first)), np.diff(first))] = symbols
    right = np.full(len(left), end, dtype=np.int64)
    right[:-1] = np.where(left[1:] == start, end, left[1:])
    return left, right


def _pairs(symbols_of, size: int):
    """Counts of symbol pairs in the texts: (left, right, count). The last two of ``size``
    symbols are the end and the start."""

    def run(batches):
        symbols, total = symbols_of(), np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in _pieces(batch.column("text")):
                words, first = read_words(data, offsets)
                left, right = _followers(symbols(words), first, size - 2, size - 1)
                total += np.bincount(left * size + right, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some // size, pa.int32()), pa.array(some % size, pa.int32()), pa.array(total[some], pa.int64())], ["left", "right", "n"])

    return run


def _pair_table(training: DataFrame, symbols_of, size: int) -> np.ndarray:
    return _table_of(training.mapInArrow(_pairs(symbols_of, size), "left int, right int, n long"), size)


def _table_of(pairs: DataFrame, size: int) -> np.ndarray:
    found = pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((size, size))
    table[found["left"].to_numpy(), found["right"].to_numpy()] = found["n"].to_numpy()
    return table


def _word_edges(words: int, buckets: int) -> np.ndarray:
    return np.arange(buckets + 1, dtype=np.int64) * words // buckets


def _neighbours(shared, packet: int, buckets: int):
    """How often each class stands before (side 0) and after (side 1) each of the other
    frequent words: packed as (word * 2 + side) * classes + class, by buckets of words and
    counted from the bucket's first."""
    names, types = ["bucket", "entries", "counts"], [pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        head, label, mid = shared.value
        edges, held, n = _word_edges(len(mid.words), buckets), [], 0

        def flush():
            nonlocal held, n
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
            of = np.searchsorted(edges, found // (2 * SIZE), side="right") - 1
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            local = (found - edges[of] * 2 * SIZE).astype(np.uint32)
            return _batch([(int(of[a]), local[a:z].tobytes(), counts[a:z].astype(np.uint32).tobytes()) for a, z in zip(cuts, np.append(cuts[1:], len(of)), strict=True)], names, types)

        for batch in batches:
            for _, data, offsets in _pieces(batch.column("text")):
                words, first = read_words(data, offsets)
                at = head.find(words)
                classes, some = label[at], np.flatnonzero(at < 0)
                classes[some] = REST
                place = mid.find(words[some])
                some, place = some[place >= 0], place[place >= 0].astype(np.int64)
                full = np.diff(first) > 0
                before, after = np.roll(classes, 1), np.roll(classes, -1)
                before[first[:-1][full]], after[first[1:][full] - 1] = START, END
                for side, own in enumerate((before, after)):
                    held.append((place * 2 + side) * SIZE + own[some])
                n += 2 * len(some)
                if n >= packet:
                    yield flush()
        if n:
            yield flush()

    return run


def best_classes(entries: np.ndarray, counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words given by their neighbours' classes (distinct packed entries in order): the
    words and, of the exchanged classes, the one whose bigrams gain most likelihood."""
    size, k = len(table), np.arange(CLASSES)
    word, side, other = entries // (2 * size), entries // size % 2, entries % size
    seen = np.stack([table[:, k], table[k].T])  # side, neighbour, class
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    best, step = [], 32
    for a in range(0, len(start), step):
        lo, hi = start[a], start[a + step] if a + step < len(start) else len(entries)
        n, s, own = counts[lo:hi, None].astype(np.float64), side[lo:hi], start[a : a + step] - lo
        have = seen[s, other[lo:hi]]
        gain = np.add.reduceat(_xlogx(have + n) - _xlogx(have), own, axis=0)
        for x in (0, 1):
            total, room = np.add.reduceat(n[:, 0] * (s == x), own)[:, None], seen[x].sum(axis=0)
            gain -= _xlogx(room + total) - _xlogx(room)
        gain[:, seen.sum(axis=(0, 1)) == 0] = -np.inf  # a class without words would suit all of them
        best.append(np.argmax(gain, axis=1))
    return word[start], np.concatenate(best).astype(np.uint8)


def _kept_neighbours(shared, packet: int, buckets: int):
    """How often each class stands before (side 0) and after (side 1) each word that is not
    sent out: side * ``SIZE`` + class by word, in buckets of the hash range."""
    names, types = ["bucket", "packet", "words", "facts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        head, label, mid = shared.value
        held, n = [], 0

        def flush():
            nonlocal held, n
            words, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
            order = np.lexsort((codes, words))
            words, codes = words[order], codes[order]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), (words[1:] != words[:-1]) | (codes[1:] != codes[:-1])]))
            facts = np.stack([codes[start], np.diff(np.append(start, len(words)))], axis=1).astype(np.uint32)
            words = words[start]
            return _batch([(b, 0, words[a:z].tobytes(), facts[a:z].tobytes()) for b, a, z in bucket_runs(words, buckets)], names, types)

        for batch in batches:
            for _, data, offsets in _pieces(batch.column("text")):
                words, first = read_words(data, offsets)
                at = head.find(words)
                classes = label[at]
                classes[at < 0] = REST
                some = np.flatnonzero(at < 0)
                some = some[mid.find(words[some]) < 0]
                full = np.diff(first) > 0
                before, after = np.roll(classes, 1), np.roll(classes, -1)
                before[first[:-1][full]], after[first[1:][full] - 1] = START, END
                held += [(words[some], before[some]), (words[some], after[some] + SIZE)]
                n += 2 * len(some)
                if n >= packet:
                    yield flush()
        if n:
            yield flush()

    return run


_KEPT = "bucket long, words binary, facts binary, kept_n array<long>, kept_v array<long>"


def _keep(shared):
    """In a bucket: its words, their counts with their classes (``marked``), and how many
    words and occurrences of words each class has, of those that are not sent out."""

    def run(key, t):
        words, counts, entries, times = np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        asked = []
        for packet, w, c in zip(*(t[x].to_pylist() for x in ("packet", "words", "facts")), strict=True):
            if packet is None:
                words, counts = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
            else:
                asked.append((np.frombuffer(w, np.uint64), np.frombuffer(c, np.uint32).reshape(-1, 2).astype(np.int64)))
        for w, facts in asked:
            place = np.searchsorted(words, w)  # all of them are there
            often = counts[place] >= OFTEN
            entries.append(place[often] * 2 * SIZE + facts[often, 0])
            times.append(facts[often, 1])
        classes, n, v = np.full(len(words), REST, np.int64), np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        entries, times = _added(np.concatenate(entries), np.concatenate(times))
        if len(entries):
            own, chosen = best_classes(entries, times, shared.value)
            classes[own] = chosen
            np.add.at(n, chosen, counts[own])
            np.add.at(v, chosen, 1)
        lists = pa.list_(pa.int64())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()), "facts": pa.array([marked(counts, classes).tobytes()], pa.binary()), "kept_n": pa.array([n.tolist()], lists), "kept_v": pa.array([v.tolist()], lists)})

    return run


def marked(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A word's count and class in one number; 0 is a word that is not there."""
    return counts << 8 | classes


def unmarked(facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return facts >> 8, np.where(facts > 0, facts & 255, REST)


def _open_pairs(shared, packet: int, buckets: int):
    """Each packet's counts of pairs of classes, where words that are not sent out stand for
    themselves (``SIZE`` and on, in the order of the packet's such words), for the row with
    bucket null; and these words for buckets."""
    names, types = ["bucket", "packet", "words", "facts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        lexicon, part, k = shared.value, TaskContext.get().partitionId(), 0
        held, closed, n = [], np.zeros(SIZE * SIZE, np.int64), 0

        def flush():
            nonlocal held, closed, n, k
            one = (part << 24) | k
            found = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w[is_open] for *sides, in held for w, _, is_open in sides)]))
            width = SIZE + len(found)
            code = lambda w, own, is_open: np.where(is_open, SIZE + np.searchsorted(found, w), own)
            pairs = np.concatenate([np.zeros(0, np.int64), *(code(*left) * width + code(*right) for left, right in held)])
            some = np.flatnonzero(closed)
            pairs, counts = _added(np.concatenate([pairs, some // SIZE * width + some % SIZE]), np.concatenate([np.ones(len(pairs), np.int64), closed[some]]))
            held, closed, n, k = [], np.zeros(SIZE * SIZE, np.int64), 0, k + 1
            rows = [(b, one, found[a:z].tobytes(), None) for b, a, z in bucket_runs(found, buckets)]
            return _batch([*rows, (None, one, np.stack([pairs // width, pairs % width, counts]).tobytes(), None)], names, types)

        for batch in batches:
            for _, data, offsets in _pieces(batch.column("text")):
                words, first = read_words(data, offsets)
                at = lexicon.words.find(words)
                left, right = _followers(lexicon.classes_at(at), first, END, START)
                # The words of both sides: each row has one bigram more than words.
                last = np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
                is_open, word = np.zeros(len(left), bool), np.zeros(len(left), np.uint64)
                is_open[last], word[last] = at < 0, words
                before, prior = np.zeros(len(left), bool), np.zeros(len(left), np.uint64)
                before[last + 1], prior[last + 1] = at < 0, words
                some = is_open | before
                closed += np.bincount(left[~some] * SIZE + right[~some], minlength=len(closed))
                held.append(((prior[some], left[some], before[some]), (word[some], right[some], is_open[some])))
                n += int(some.sum())
                if n >= packet:
                    yield flush()
        if n or closed.any():
            yield flush()

    return run


def _close_pairs(t):
    """A packet's counts of class pairs, its open words' classes being known."""
    pairs, replies = None, []
    for bucket, words in zip(t["bucket"].to_pylist(), t["words"].to_pylist(), strict=True):
        if bucket is None:
            pairs = np.frombuffer(words, np.int64).reshape(3, -1)
        else:
            replies.append((bucket, np.frombuffer(words, np.int64)))
    classes = np.concatenate([np.arange(SIZE), *(unmarked(c)[1] for _, c in sorted(replies, key=lambda x: x[0]))])
    keys, counts = _added(classes[pairs[0]] * SIZE + classes[pairs[1]], pairs[2])
    return pa.table({"left": pa.array(keys // SIZE, pa.int32()), "right": pa.array(keys % SIZE, pa.int32()), "n": pa.array(counts, pa.int64())})


def _choose(shared, edges: np.ndarray):
    """In a bucket of words: their places and classes."""

    def run(key, t):
        entries, counts = _added(*(np.concatenate([np.frombuffer(x, np.uint32) for x in t[c].to_pylist()]) for c in ("entries", "counts")))
        words, classes = best_classes(entries.astype(np.int64) + edges[key[0].as_py()] * 2 * SIZE, counts, shared.value)
        return pa.table({"words": pa.array([words.tobytes()], pa.binary()), "classes": pa.array([classes.tobytes()], pa.binary())})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, words: int, classes: int) -> np.ndarray:
    """A class for each symbol. ``pairs`` counts symbol bigrams; the first ``words`` symbols,
    by descending frequency, are exchanged among ``classes`` until nothing moves (or, where
    rounding makes moves look like gains, classes come again), the others keep one of their
    own after those."""
    others = len(pairs) - words
    label = np.concatenate([np.arange(words) % max(1, min(classes, words)), classes + np.arange(others)]).astype(np.int64)
    size = classes + others
    to_class = np.zeros((len(pairs), size))  # symbol -> counts of the class that follows
    np.add.at(to_class.T, label, pairs.T)
    from_class = np.zeros((size, len(pairs)))
    np.add.at(from_class, label, pairs)
    table = np.zeros((size, size))
    np.add.at(table, label, to_class)
    left, right = pairs.sum(axis=1), pairs.sum(axis=0)
    class_left, class_right = table.sum(axis=1), table.sum(axis=0)
    k, met, moved = np.arange(classes), set(), words
    while moved and (state := label.tobytes()) not in met:
        met.add(state)
        moved = 0
        for w in range(words):
            old, own = label[w], pairs[w, w]
            out, into = to_class[w].copy(), from_class[:, w].copy()
            out[old] -= own  # bigrams with itself move with it
            into[old] -= own
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            class_left[old] -= left[w]
            class_right[old] -= right[w]
            rows, cols = table[k], table[:, k].T
            gain = (_xlogx(rows + out) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + into) - _xlogx(cols)).sum(axis=1)
            corner = table[k, k]
            gain += _xlogx(corner + out[k] + into[k] + own) + _xlogx(corner) - _xlogx(corner + out[k]) - _xlogx(corner + into[k])
            gain -= _xlogx(class_left[k] + left[w]) - _xlogx(class_left[k]) + _xlogx(class_right[k] + right[w]) - _xlogx(class_right[k])
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            label[w] = new
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            class_left[new] += left[w]
            class_right[new] += right[w]
            if new != old:
                moved += 1
                to_class[:, old] -= pairs[:, w]
                to_class[:, new] += pairs[:, w]
                from_class[old] -= pairs[w]
                from_class[new] += pairs[w]
    return label


@dataclass
class Figures:
    transition: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of a class's words' counts and of one more for each


@dataclass
class Model(Figures):
    lexicon: Lexicon

    def score_rows(self, data: np.ndarray, offsets: np.ndarray):
        """Of each row: words, sum without emission counts, words with classes and their
        log-counts; and the other words with their rows. If any of those have classes in
        buckets, bigrams with them are left out of the sums and follow, as rows, words and
        classes of both sides (the class -1: as the word's)."""
        words, first = read_words(data, offsets)
        at, n = self.lexicon.words.find(words), np.diff(first)
        classes = self.lexicon.classes_at(at)
        before = np.full(len(classes), START, dtype=np.int64)
        before[1:] = classes[:-1]
        before[first[:-1][n > 0]] = START
        final = np.full(len(n), START, dtype=np.int64)
        final[n > 0] = classes[first[1:][n > 0] - 1]
        known, row = at >= 0, np.repeat(np.arange(len(n)), n)
        steps, ends = self.transition[before, classes] - self.room[classes], self.transition[final, END]
        left_open = None
        if self.lexicon.kept is not None:
            own, prior = np.where(known, classes, -1), np.where(before == START, START, -1)
            prior[1:] = np.where(before[1:] == START, START, own[:-1])
            word = np.roll(words, 1)
            some = np.flatnonzero((own < 0) | (prior < 0))
            last = first[1:][n > 0] - 1
            over = last[own[last] < 0]
            left_open = tuple(np.concatenate(x) for x in ((row[some], row[over]), (word[some], words[over]), (prior[some], own[over]), (words[some], words[over]), (own[some], np.full(len(over), END))))
            steps[some] = 0.0
            ends[row[over]] = 0.0
        sums = row_sums(steps, first) + ends
        counts = self.lexicon.words.counts
        logs = row_sums(np.where(known, np.log10(counts[at] + 1.0), 0.0) if len(counts) else np.zeros(len(at)), first)
        return n, sums, np.bincount(row[known], minlength=len(n)), logs, words[~known], row[~known], left_open


def cluster(head: Words, order: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's class, and counts of class pairs. ``order``: the frequent words' places
    by descending count."""
    h = len(head.words)
    by_rank = np.concatenate([order, np.arange(h, len(pairs))])
    ranked = exchange(pairs[np.ix_(by_rank, by_rank)].astype(np.float64), h, CLASSES)
    label = np.empty(len(pairs), dtype=np.int64)
    label[by_rank] = ranked
    table = np.zeros((SIZE, SIZE))
    np.add.at(table, (label[:, None], label[None, :]), pairs)
    return label, table


def build(lexicon: Lexicon, table: np.ndarray, rest_n: int, rest_v: int) -> Model:
    """A model from counts of class pairs, and of the words without a class of their own."""
    seen = table.sum(axis=0)[:START]  # outcomes are everything but the start
    prior = (seen + 1.0) / (seen.sum() + START)
    transition = np.full((SIZE, SIZE), -np.inf)
    transition[:, :START] = np.log10((table[:, :START] + PRIOR * prior) / (table.sum(axis=1) + PRIOR)[:, None])
    n, v = np.zeros(SIZE), np.zeros(SIZE)
    np.add.at(n, lexicon.label, lexicon.words.counts)
    np.add.at(v, lexicon.label, 1)
    n[REST], v[REST] = rest_n, rest_v + 1  # all unseen words share one
    if lexicon.kept is not None:  # of the rest, these have a class
        n += lexicon.kept[0]
        v += lexicon.kept[1]
        n[REST] -= lexicon.kept[0].sum()
        v[REST] -= lexicon.kept[1].sum()
    return Model(transition, np.log10(np.maximum(n + v, 1.0)), lexicon)


def _often(least: int):
    """Of each bucket, the words that occur often and their counts."""

    def run(batches):
        for batch in batches:
            out = []
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(c, np.int64)
                out.append((np.frombuffer(w, np.uint64)[counts >= least].tobytes(), counts[counts >= least].tobytes()))
            yield _batch(out, ["words", "counts"], [pa.binary(), pa.binary()])

    return run


def learn(training: DataFrame, counted: DataFrame, head: Words, least: int, packet: int, buckets: int, scratch: Scratch) -> tuple[Lexicon, np.ndarray, DataFrame]:
    """Classes of all words that occur ``least`` times, counts of class pairs, and the buckets'
    words (words, facts). Where ``least`` is more than ``OFTEN`` and other words have classes
    too, the facts are ``marked``, else counts."""
    sc, h = training.sparkSession.sparkContext, len(head.words)
    shared_head = sc.broadcast(head)

    def head_symbols():
        own = shared_head.value
        return lambda words: np.where((at := own.find(words)) >= 0, at, h)

    label, table = cluster(head, np.argsort(-head.counts, kind="stable"), _pair_table(training, head_symbols, h + 3))
    lexicon = Lexicon.of(head.words, head.counts, label[:h])
    tables = counted.select("bucket", F.lit(None).cast("long").alias("packet"), "words", F.col("counts").alias("facts"))
    if not h:
        return lexicon, table, tables
    often = counted.select("words", "counts").mapInArrow(_often(least), "words binary, counts binary").toArrow()
    words, counts = (np.concatenate([np.frombuffer(x, d) for x in often[c].to_pylist()]) for c, d in (("words", np.uint64), ("counts", np.int64)))
    other = head.find(words) < 0
    if not other.any() and least <= OFTEN:
        return lexicon, table, tables
    mid = Words.of(words[other], counts[other])
    shared, seen = sc.broadcast((head, label, mid)), sc.broadcast(table)
    if other.any():
        lexicon = _with_mid(training, shared, seen, packet, min(buckets, len(mid.words)))
    kept = None
    if least > OFTEN:
        near = training.mapInArrow(_kept_neighbours(shared, packet, buckets), _PACKED)
        kept = scratch.save(near.unionByName(tables).groupBy("bucket").applyInArrow(_keep(seen), _KEPT), "kept")
        sums = kept.agg(*(F.coalesce(F.sum(F.col(c)[k]), F.lit(0)).alias(f"{c}{k}") for c in ("kept_n", "kept_v") for k in range(SIZE))).first()
        lexicon.kept = np.array(sums, np.float64).reshape(2, SIZE)
        tables = kept.select("bucket", F.lit(None).cast("long").alias("packet"), "words", "facts")
    shared.destroy()
    all_words = sc.broadcast(lexicon)
    if kept is None:
        return lexicon, _pair_table(training, lambda: all_words.value.classes_of, SIZE), tables
    packed = scratch.save(training.mapInArrow(_open_pairs(all_words, packet, buckets), _PACKED), "pairs")
    told = packed.where("bucket IS NOT NULL").unionByName(tables).groupBy("bucket").applyInArrow(_look_up, _PACKED)
    closed = told.unionByName(packed.where("bucket IS NULL")).groupBy("packet").applyInArrow(_close_pairs, "left int, right int, n long")
    table = _table_of(closed, SIZE)
    scratch.drop("pairs")
    return lexicon, table, tables


def _with_mid(training: DataFrame, shared, seen, packet: int, buckets: int) -> Lexicon:
    """The head's words, and the other words that are sent out with their neighbours' classes."""
    head, label, mid = shared.value
    near = training.mapInArrow(_neighbours(shared, packet, buckets), "bucket long, entries binary, counts binary")
    chosen = near.groupBy("bucket").applyInArrow(_choose(seen, _word_edges(len(mid.words), buckets)), "words binary, classes binary").toArrow()
    own = np.zeros(len(mid.words), np.int64)
    own[np.concatenate([np.frombuffer(x, np.int64) for x in chosen["words"].to_pylist()])] = np.concatenate([np.frombuffer(x, np.uint8) for x in chosen["classes"].to_pylist()])
    return Lexicon.of(np.concatenate([head.words, mid.words]), np.concatenate([head.counts, mid.counts]), np.concatenate([label[: len(head.words)], own]))


# ---- scoring ----------------------------------------------------------------------------

_PACKED = "bucket long, packet long, words binary, facts binary"


def _score_packets(shared, packet_words: int, buckets: int, kept: list[str]):
    """A packet's rare words for buckets, and one row (bucket null) with the packet's other
    columns and what is known already: its texts' figures, where its rare words stand, and
    bigrams with them that are open."""
    names, types = ["bucket", "packet", "words", "facts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        model, part, k = shared.value, TaskContext.get().partitionId(), 0
        words, rows, facts, opens, ids, docs, n = [], [], [], [], [], 0, 0

        def flush():
            nonlocal words, rows, facts, opens, ids, docs, n, k
            packet = (part << 24) | k
            w, r = np.concatenate(words), np.concatenate(rows)
            order = np.argsort(w, kind="stable")
            w, r = w[order], r[order]
            one = np.ones(min(1, len(w)), bool)
            new_word = np.concatenate([one, w[1:] != w[:-1]])
            entry = np.flatnonzero(np.concatenate([one, (w[1:] != w[:-1]) | (r[1:] != r[:-1])]))
            where = ((np.cumsum(new_word) - 1)[entry].astype(np.uint32), r[entry].astype(np.uint32), np.diff(np.append(entry, len(w))).astype(np.uint32))
            found = w[new_word]
            out = [(b, packet, found[a:z].tobytes(), None) for b, a, z in bucket_runs(found, buckets)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids[0].schema) as writer:
                for x in ids:
                    writer.write_batch(x)
            left_open = None
            if opens:
                row, prior, left, own, right = (np.concatenate(x) for x in zip(*opens, strict=True))
                left, right = (np.where(c < 0, SIZE + np.searchsorted(found, w), c).astype(np.uint32) for w, c in ((prior, left), (own, right)))
                left_open = (row.astype(np.uint32), left, right)
            out.append((None, packet, sink.getvalue().to_pybytes(), pickle.dumps(([np.concatenate([f[i] for f in facts]) for i in range(4)], where, left_open))))
            words, rows, facts, opens, ids, docs, n, k = [], [], [], [], [], 0, 0, k + 1
            return _batch(out, names, types)

        for batch in batches:
            # A copy: a slice would keep the batch's texts.
            ids.append(batch.select(kept).take(pa.array(np.arange(len(batch)))))
            for _, data, offsets in _pieces(batch.column("_text")):
                counts, sums, known, logs, w, r, left_open = model.score_rows(data, offsets)
                if left_open is not None:
                    opens.append((left_open[0] + docs, *left_open[1:]))
                words.append(w)
                rows.append(r + docs)
                facts.append((counts, sums, known, logs))
                docs, n = docs + len(counts), n + len(w)
            if docs and (n >= packet_words or docs >= PACKET_DOCS):
                yield flush()
        if docs:
            yield flush()

    return run


def _look_up(key, t):
    """In a bucket: the counts of each packet's words, with their classes if they are marked."""
    words, counts, out = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    asked = []
    for packet, w, c in zip(*(t[x].to_pylist() for x in ("packet", "words", "facts")), strict=True):
        if packet is None:
            words, counts = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
        else:
            asked.append((packet, np.frombuffer(w, np.uint64)))
    for packet, own in asked:
        c = np.zeros(len(own), np.int64)
        if len(words):
            i = np.minimum(np.searchsorted(words, own), len(words) - 1)
            c = np.where(words[i] == own, counts[i], 0)
        out.append((key[0].as_py(), packet, c.tobytes(), None))
    return pa.Table.from_batches([_batch(out, ["bucket", "packet", "words", "facts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])])


def _finish(shared, kept: list[str], names: list[str], n: int, v: int, ends: int, types):
    """A packet's texts with all their figures."""
    room = math.log10(n + v + 1) if n else 0.0

    def run(t):
        model = shared.value
        found, replies = None, []
        for bucket, words, facts in zip(*(t[c].to_pylist() for c in ("bucket", "words", "facts")), strict=True):
            if bucket is None:
                found = (pa.ipc.open_stream(words).read_all(), *pickle.loads(facts))
            else:
                replies.append((bucket, np.frombuffer(words, np.int64)))
        ids, (words, sums, known, logs), (word, row, times), left_open = found
        if replies:
            told = np.concatenate([c for _, c in sorted(replies, key=lambda x: x[0])])
            if left_open is not None:
                told, classes = unmarked(told)
                classes = np.concatenate([np.arange(SIZE), classes])
                at, left, right = left_open[0], classes[left_open[1]], classes[left_open[2]]
                steps = model.transition[left, right] - np.where(right == END, 0.0, model.room[right])
                sums = sums + np.bincount(at, steps, minlength=len(words))
            count = told[word]
            logs = logs + np.bincount(row, times * np.log10(count + 1.0), minlength=len(words))
            known = known + np.bincount(row, np.where(count > 0, times, 0), minlength=len(words)).astype(np.int64)
        tokens = words + 1
        score = sums + logs
        new = {
            "n_tokens": tokens,
            "n_known": known + (ends > 0),
            "train_tokens": np.full(len(words), n),
            "base_score": logs + math.log10(ends + 1) - tokens * room,
            "score": score,
            "perplexity": 10.0 ** (-score / tokens),
        }
        return pa.table([*(ids.column(c) for c in kept), *(pa.array(new[x], ty) for x, ty in zip(names, types, strict=True))], [*kept, *names])

    return run


def score(docs: DataFrame, is_training: Column, text: str = "text") -> DataFrame:
    """In place of the text: ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` and ``perplexity`` (a token's, from the score). The model learns from the rows
    for which ``is_training`` holds."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "brown")
    training = docs.where(is_training).select(F.col(text).alias("text"))
    size, ends = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    packet, buckets = packing(size, PACKET, BUCKET_BYTES, shuffle_partitions(spark))

    counted = training.mapInArrow(_count_packets(packet, buckets), "bucket long, words binary, counts binary")
    counted = scratch.save(counted.groupBy("bucket").applyInArrow(_add_counts, _COUNTED), "counts")
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("reach_n", "reach_v") for k in range(DOUBLINGS)]
    n, v, *reach = (x or 0 for x in counted.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *sums).first())
    reach_n, reach_v = reach[:DOUBLINGS], reach[DOUBLINGS:]
    k = next(k for k in range(DOUBLINGS) if reach_v[k] <= LEXICON or k == DOUBLINGS - 1)
    least = OFTEN << k
    top = counted.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "w").limit(HEAD).collect()
    head = Words.of(np.array([r["w"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64))
    rest_n, rest_v = (n - reach_n[k], v - reach_v[k]) if top else (n, v)
    few = head.counts[head.counts < least]  # frequent enough for an exchange among few words
    lexicon, table, tables = learn(training, counted, head, least, packet, buckets, scratch)
    model = build(lexicon, table, rest_n - int(few.sum()), rest_v - len(few))
    n, v = n + ends, v + (ends > 0)

    names, types = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    kept = [c for c in docs.columns if c not in (text, *names)]
    source = docs.select(*kept, F.col(text).alias("_text"))
    shared, figures = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(Figures(model.transition, model.room))
    packed = scratch.save(source.mapInArrow(_score_packets(shared, packet, buckets, kept), _PACKED), "packets")
    looked = packed.where("bucket IS NOT NULL").unionByName(tables).groupBy("bucket").applyInArrow(_look_up, _PACKED)
    schema = docs.select(*kept).schema
    for x, ty in zip(names, ("long", "long", "long", "double", "double", "double"), strict=True):
        schema = schema.add(x, ty)
    done = looked.unionByName(packed.where("bucket IS NULL")).groupBy("packet").applyInArrow(_finish(figures, kept, names, n, v, ends, types), schema)
    done = scratch.save(done, "scores")
    scratch.drop_all_but("scores")
    return done
