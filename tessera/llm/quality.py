"""Quality scores by naive-Bayes support vectors.

Features are indicators of a text's byte n-grams, hashed to a fixed number of buckets, and
of how many of its word bigrams are one word twice (levels of their share). Each
indicator is scaled by its class log-count ratio ``log(p/|p|) - log(q/|q|)``, the row to
unit length; a linear hinge-loss model is fitted to these by dual coordinate descent, and
a logistic curve on the margins of rows left out of the fit turns margins into scores.

Fitted on at most ``sample`` labelled texts (a parameter); every text is scored whole.

Cases: a null or empty text has no n-gram and gets the score of the bias alone; without
labelled rows, or with one class only, every score is that class's smoothed share; repeated
rows score alike; other columns pass through, and columns named as new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.labelled import add_scores, features_of, sigmoid, training_features
from tessera.llm.textkernel import byte_grams, distinct_by_row, row_sums, word_hashes

BITS = 18
SIZES = (2, 3)
SAMPLE = 8_000


#: Shares of word bigrams, above which a text has an indicator.
TWICE = (0.0, 0.02, 0.1, 0.3, 0.6)
FEATURES = (1 << BITS) + len(TWICE)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's distinct n-grams and repetition levels."""
    found, first = distinct_by_row(*byte_grams(data, offsets, SIZES, BITS))
    words, word_first = word_hashes(data, offsets)
    rows = np.repeat(np.arange(len(word_first) - 1), np.diff(word_first))
    again = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    share = np.bincount(rows[1:][again], minlength=len(word_first) - 1) / np.maximum(np.diff(word_first) - 1, 1)
    over = share[:, None] > np.array(TWICE)
    row, level = np.nonzero(over)
    found = np.insert(found, first[row + 1], ((1 << BITS) + level).astype(found.dtype))
    return found, first + np.concatenate([[0], np.cumsum(over.sum(axis=1))])


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        r = self.ratio[buckets]
        length = np.sqrt(row_sums(r * r, first))
        return row_sums(r * self.weights[buckets], first) / np.maximum(length, 1e-12) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(*grams(data, offsets)) + self.shift)


def log_count_ratio(buckets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Of each bucket, over texts that hold it."""
    good = np.repeat(labels > 0.5, sizes)
    p = np.bincount(buckets[good], minlength=FEATURES) + smoothing
    q = np.bincount(buckets[~good], minlength=FEATURES) + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(values: np.ndarray, buckets: np.ndarray, first: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise 1/2 |w|^2 + sum cost * hinge: one dual variable at a
    time, in random order, each set to its own optimum within [0, cost]."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    square = row_sums(values * values, first) + 1.0  # the bias is a feature of value 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            at, x = buckets[first[i] : first[i + 1]], values[first[i] : first[i + 1]]
            gradient = y[i] * (x @ w[at] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * x
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with a light prior."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(texts: pa.ChunkedArray, labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 1) -> Model:
    """A model of texts with labels 0 and 1."""
    return fit_rows(*(features_of(texts, grams) if len(labels) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))), labels, cost, epochs, seed)


def fit_rows(buckets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 1) -> Model:
    """A model of rows given by their buckets; every fifth row only calibrates."""
    size = FEATURES
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    first = np.concatenate([[0], np.cumsum(sizes)])
    left_out = np.random.default_rng(seed).permutation(len(labels)) % 5 == 0
    if len(labels) < 50 or len(set(labels[left_out])) < 2 or len(set(labels[~left_out])) < 2:
        left_out[:] = False
    keep = np.repeat(~left_out, sizes)
    ratio = log_count_ratio(buckets[keep], sizes[~left_out], labels[~left_out])
    values = ratio.astype(np.float32)[buckets]
    values /= np.repeat(np.maximum(np.sqrt(row_sums(values * values, first)), 1e-12).astype(np.float32), sizes)
    y = np.where(labels > 0.5, 1.0, -1.0)
    share = labels[~left_out].mean()
    costs = cost * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    own_first = np.concatenate([[0], np.cumsum(sizes[~left_out])])
    w, bias = dual_descent(values[keep], buckets[keep], own_first, y[~left_out], costs[~left_out], size, epochs, seed)
    model = Model(ratio, w, bias, 1.0, 0.0)
    judged = left_out if left_out.any() else ~left_out
    margins = row_sums(values * w[buckets], first) + bias
    model.slope, model.shift = calibrate(margins[judged], labels[judged])
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """Add ``score`` and ``predicted`` to all documents."""
    model = fit_rows(*training_features(docs, labels, "quality", sample, grams))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    return add_scores(docs, lambda: shared.value.scores, threshold, keep_text=keep_text)
