"""Toxicity scores by a factorization machine over hashed terms.

The model is ``b + sum w_i + sum_{i<j} <v_i, v_j>`` over a text's distinct terms: the pair
part gives weight to two terms together that neither has alone. Terms are runs of letters
and digits, ``A``-``Z`` as ``a``-``z``, and the beginnings of longer ones, hashed to a fixed
number of buckets. A bucket takes part that ``MIN_TEXTS`` training texts hold and that tells
something: alone, by its share among the two labels, or with another one, where among the
texts that hold either the other makes a difference. So terms that are neutral alone are
learned if a pair is not, as long as each is in ``PAIR_SHARE`` of the training texts. Fitted
by AdaGrad on the log-loss.

Fitted on at most ``sample`` labelled texts (a parameter); every text is scored whole,
whatever its length.

Cases: a null or empty text gets the bias alone; without labelled rows, or with one class
only, every score is the smoothed share of that class; repeated rows score alike; other
columns pass through, and columns named as new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.labelled import add_scores, features_of, sigmoid, training_features
from tessera.llm.textkernel import distinct_by_row, row_sums, stem_hashes

BITS = 18
FACTORS = 8
MIN_TEXTS = 5
MIN_BEARING = 15.0
#: For pairs: the evidence that each makes a difference among the other's texts, and the
#: share of texts, and number of texts, that hold each.
PAIR_BEARING, PAIR_SHARE, PAIR_TEXTS = 60.0, 0.02, 20
#: Terms whose pairs are counted at once.
TILE = 1024
#: Beginnings of a term, in bytes, that are terms too: inflected words share them.
STEMS = (4, 5, 6)
SAMPLE = 8_000


def terms(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's distinct terms and term beginnings."""
    hashes, first = stem_hashes(data, offsets, STEMS)
    return distinct_by_row((hashes >> np.uint64(64 - bits)).astype(np.uint32), first)


@dataclass
class Machine:
    bias: float
    known: np.ndarray  # bucket -> row of weights and factors, -1 for none
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = self.known[buckets]
        use = at >= 0
        first = np.concatenate([[0], np.cumsum(use)])[first]
        at = at[use]
        v = self.factors[at]
        alone = row_sums(self.weights[at] - 0.5 * (v * v).sum(axis=1), first)
        return self.bias + alone + 0.5 * (row_sums(v, first) ** 2).sum(axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.margins(*terms(data, offsets)))


def constant(labels: np.ndarray) -> Machine:
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    return Machine(float(np.log(share / (1 - share))), np.full(1 << BITS, -1, np.int32), np.zeros(1), np.zeros((1, FACTORS)))


def bearing(held: np.ndarray, held_toxic: np.ndarray, toxic, texts) -> np.ndarray:
    """Log-likelihood ratio statistic of each bucket's split over the two labels of so many
    texts."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    share, clean = toxic / texts, held - held_toxic
    without, without_toxic = texts - held, toxic - held_toxic
    return 2 * (part(held_toxic, held * share) + part(clean, held * (1 - share)) + part(without_toxic, without * share) + part(without - without_toxic, without * (1 - share)))


def distinct_rows(buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first row of each different set of buckets: copies are no further evidence."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    seen: dict[bytes, int] = {}
    for r in range(len(sizes)):
        seen.setdefault(buckets[first[r] : first[r + 1]].tobytes(), r)
    return np.array(sorted(seen.values()), dtype=np.int64)


def pair_terms(buckets: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Buckets of pairs that tell what neither does alone: among the texts that hold one, the
    other changes the share of toxic ones, and the other way round. Pairs are counted by
    products of tiles of terms x texts; terms of the same texts are counted once."""
    rows = distinct_rows(buckets, sizes)
    place = np.full(len(sizes), -1)
    place[rows[np.argsort(-labels[rows], kind="stable")]] = np.arange(len(rows))  # toxic first
    row = place[np.repeat(np.arange(len(sizes)), sizes)]
    buckets, row = buckets[row >= 0], row[row >= 0]
    toxic, n = int(labels[rows].sum()), len(rows)
    held = np.bincount(buckets, minlength=1 << BITS)
    some = np.flatnonzero((held >= max(PAIR_TEXTS, PAIR_SHARE * n)) & (held < n))
    at = np.full(1 << BITS, -1)
    at[some] = np.arange(len(some))
    use = at[buckets] >= 0
    term, row = at[buckets[use]], row[use]
    marks = np.zeros(len(some), np.uint64)
    np.add.at(marks, term, np.random.default_rng(7).integers(0, 1 << 62, n, dtype=np.uint64)[row])
    _, lead, same = np.unique(marks, return_index=True, return_inverse=True)
    leads = np.full(len(some), -1)
    leads[lead] = np.arange(len(lead))
    use = leads[term] >= 0
    term, row = leads[term[use]], row[use]
    order = np.argsort(term, kind="stable")
    term, row = term[order], row[order]
    total = np.bincount(term, minlength=len(lead)).astype(np.float32)
    share = np.bincount(term[row < toxic], minlength=len(lead)).astype(np.float32) / np.maximum(total, 1)
    tells = np.zeros(len(lead), bool)

    def dense(a: int) -> np.ndarray:
        lo, hi = np.searchsorted(term, [a, a + TILE])
        x = np.zeros((min(TILE, len(lead) - a), n), np.float32)
        x[term[lo:hi] - a, row[lo:hi]] = 1
        return x

    def changes(both, both_toxic, share, total):
        """Chi-square of the other's split of these texts."""
        with np.errstate(all="ignore"):
            return (both_toxic - both * share) ** 2 / (share * (1 - share) * both * (1 - both / total))

    for a in range(0, len(lead), TILE):
        x = dense(a)
        for b in range(a, len(lead), TILE):
            y = x if b == a else dense(b)
            both_toxic = x[:, :toxic] @ y[:, :toxic].T
            both = both_toxic + x[:, toxic:] @ y[:, toxic:].T
            ends = [(share[a : a + TILE, None], total[a : a + TILE, None]), (share[None, b : b + TILE], total[None, b : b + TILE])]
            i, j = np.nonzero(np.minimum(*(changes(both, both_toxic, *e) for e in ends)) >= PAIR_BEARING / 3)
            if len(i):  # counts are exact below 2**24
                c, ct = both[i, j].astype(float), both_toxic[i, j].astype(float)
                sides = [np.round(total[k].astype(float)) for k in (a + i, b + j)]
                found = np.minimum(*(bearing(c, ct, np.round(share[k].astype(float) * t), t) for k, t in zip((a + i, b + j), sides, strict=True))) >= PAIR_BEARING
                tells[a + i[found]] = tells[b + j[found]] = True
    return some[tells[same]]


def fit(texts: pa.ChunkedArray, labels: np.ndarray, **settings) -> Machine:
    """A machine for texts with labels 0 and 1."""
    return fit_rows(*(features_of(texts, terms) if len(labels) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))), labels, **settings)


def fit_rows(buckets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Machine:
    """A machine for rows given by their buckets."""
    if not len(labels) or labels.min() == labels.max():
        return constant(labels)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    held = np.bincount(buckets, minlength=1 << BITS).astype(np.float64)
    held_toxic = np.bincount(buckets, labels[row], minlength=1 << BITS)
    alone = bearing(held, held_toxic, labels.sum(), float(len(labels))) >= MIN_BEARING
    tells = np.union1d(np.flatnonzero((held >= MIN_TEXTS) & alone), pair_terms(buckets, sizes, labels))
    known = np.full(1 << BITS, -1, np.int32)
    known[tells] = np.arange(len(tells))
    at = known[buckets]
    use = at >= 0
    at, first = at[use], np.concatenate([[0], np.cumsum(np.bincount(row[use], minlength=len(sizes)))])
    size = max(1, len(tells))
    rng = np.random.default_rng(seed)
    share = labels.mean()
    m = Machine(float(np.log(share / (1 - share))), known, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    seen_b, seen_w, seen_v = 1e-4, np.full(size, 1e-4), np.full((size, FACTORS), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            n = first[rows + 1] - first[rows]
            starts = np.concatenate([[0], np.cumsum(n)])
            own = at[np.arange(starts[-1]) - np.repeat(starts[:-1] - first[rows], n)]
            v = m.factors[own]
            sums = row_sums(v, starts)
            margin = m.bias + row_sums(m.weights[own] - 0.5 * (v * v).sum(axis=1), starts) + 0.5 * (sums**2).sum(axis=1)
            slope = (sigmoid(margin) - labels[rows]) / len(rows)
            seen_b += slope.sum() ** 2
            m.bias -= rate * slope.sum() / np.sqrt(seen_b)
            if not len(own):
                continue
            each = np.repeat(slope, n)
            touched, back = np.unique(own, return_inverse=True)
            gw = np.bincount(back, each) + decay * m.weights[touched]
            gv = np.stack([np.bincount(back, each * (np.repeat(sums[:, k], n) - v[:, k])) for k in range(FACTORS)], axis=1) + decay * m.factors[touched]
            seen_w[touched] += gw**2
            seen_v[touched] += gv**2
            m.weights[touched] -= rate * gw / np.sqrt(seen_w[touched])
            m.factors[touched] -= 0.3 * rate * gv / np.sqrt(seen_v[touched])
    return m


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """Add ``score`` and ``predicted`` to all documents."""
    machine = fit_rows(*training_features(docs, labels, "toxic", sample, terms))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size
    return add_scores(docs, lambda: shared.value.scores, threshold, keep_text=keep_text)
