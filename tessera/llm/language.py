"""The language of texts by error-correcting output codes.

Each learned language has a codeword of bits: for up to five languages all different ways of
parting them in two (the exhaustive code), for more a code of ``CODE_BITS`` bits, drawn with a
fixed seed as the best of many by the smallest distance between codewords, then by that
between columns. A binary classifier predicts each bit: a logistic model on the shares of a
text's hashed byte n-grams, all bits fitted side by side by mini-batches with steps scaled by
each weight's own gradients. Digits, punctuation and white space count as one separator, and
case is folded, so n-grams are of letters and word ends.

Decoding is loss-weighted: a language's loss is the mean over bits of the logistic loss of
the bit's margin against the codeword's, weighted by how often, on rows left out of the fit,
that bit was right for that language. The language of least loss is chosen; ``score`` is its
share of the languages' likelihoods ``exp(-slope * loss)``, with the slope that fits the
left-out rows best; ``ambiguous`` marks texts whose runner-up comes within ``AMBIGUOUS`` of it.

Fitted on at most ``sample`` rows (a parameter), as evenly by language as the hash of their
ids allows; every text is predicted whole.

Cases: a null text and one without a letter are ``und`` with score 0, and not ambiguous; a
text of letters that no n-gram was learned for goes by the biases; with one learned language
every other text is of it, with score 1; with none every text is ``und`` with score 0; a null
id is the empty string for its checksum; repeated rows are predicted alike; other columns are
left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import pieces, sigmoid
from tessera.llm.textkernel import TERM_BREAKS, byte_grams, row_sums
from tessera.plans.runtime import ship

UNDETERMINED = "und"
SAMPLE = 4_000
BITS = 16
SIZES = (2, 3)
#: Bits of a codeword where there are more languages than an exhaustive code is made for.
EXHAUSTIVE, CODE_BITS, DRAWS = 5, 31, 400
AMBIGUOUS = 0.1
EPOCHS, BATCH, STEP = 8, 128, 2.0

_SEPARATED = np.where(TERM_BREAKS | np.isin(np.arange(256), list(b"0123456789")), ord(" "), np.arange(256)).astype(np.uint8)


def code(languages: int, bits: int = CODE_BITS, seed: int = 12) -> np.ndarray:
    """Codewords of -1 and 1, a row a language, a column a bit."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= EXHAUSTIVE:
        parted = range(1, 1 << (languages - 1))  # the first language is on the same side always
        return np.array([[1.0 if i and p >> (i - 1) & 1 else -1.0 for p in parted] for i in range(languages)])
    bits = max(bits, 4 * (languages - 1).bit_length())
    rng, best = np.random.default_rng(seed), None
    for _ in range(DRAWS):
        drawn = rng.choice([-1.0, 1.0], (languages, bits))
        rows = drawn @ drawn.T - 2 * bits * np.eye(languages)
        columns = np.abs(drawn.T @ drawn) - 2 * languages * np.eye(bits)
        if np.abs(drawn.sum(axis=0)).max() == languages:
            continue  # a bit that is the same for all tells nothing
        rank = (-rows.max(), -columns.max())
        if best is None or rank > best[0]:
            best = (rank, drawn)
    return best[1]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's n-grams of letters and separators, runs of which are one. A
    separator stands before and after each text."""
    plain = _SEPARATED[data]
    blank = plain == ord(" ")
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first of a run stays
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = ~blank[starts]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    keep[ends] &= ~blank[ends]
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    size = np.diff(kept)
    at = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.full(at[-1], ord(" "), np.uint8)
    where = np.ones(at[-1], bool)
    where[at[:-1]] = where[at[1:] - 1] = False
    out[where] = plain[keep]
    return byte_grams(out, at, SIZES, BITS)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # a row a bucket, a column a bit
    bias: np.ndarray
    right: np.ndarray  # a row a language, a column a bit: weights of the losses
    slope: float

    def margins(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.stack([row_sums(self.weights[:, b][buckets], first) for b in range(len(self.bias))], axis=1) if len(self.bias) else np.zeros((len(first) - 1, 0))
        return sums / np.maximum(np.diff(first), 1)[:, None] + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Of each row and language; the loss of a bit grows as its margin is against the codeword's."""
        against = -margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0.0, against) * self.right[None, :, :]).sum(axis=2)

    def likelihoods(self, margins: np.ndarray) -> np.ndarray:
        x = -self.slope * self.losses(margins)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.likelihoods(self.margins(*grams(data, offsets)))


def fit(buckets: np.ndarray, counts: np.ndarray, sizes: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """A model of rows given by their buckets, with how often each occurs; every fifth row
    only weighs bits and calibrates."""
    languages = sorted(set(labels))
    words = code(len(languages))
    n, bits = len(labels), words.shape[1]
    if len(languages) < 2:
        return Model(languages, words, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros((len(languages), 0)), 1.0)
    label = np.searchsorted(languages, labels)
    first = np.concatenate([[0], np.cumsum(sizes)])
    share = (counts / np.maximum(np.repeat(row_sums(counts.astype(np.float32), first), sizes), 1.0)).astype(np.float32)
    rng = np.random.default_rng(seed)
    left_out = rng.permutation(n) % 5 == 0
    if n < 50 or len(set(label[~left_out])) < len(languages) or len(set(label[left_out])) < len(languages):
        left_out[:] = False
    target = words[label] > 0
    # Languages of few rows weigh as much as others.
    weight = n / (len(languages) * np.bincount(label, minlength=len(languages)))[label]
    w, bias = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits)
    seen, seen_bias = np.full(w.shape, 1e-12, np.float32), np.full(bits, 1e-12)
    own = np.flatnonzero(~left_out)
    for _ in range(epochs):
        order = rng.permutation(own)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            size = sizes[rows]
            at = np.arange(int(size.sum())) + np.repeat(first[rows] - (np.cumsum(size) - size), size)
            b, x = buckets[at], share[at]
            inner = np.concatenate([[0], np.cumsum(size)])
            p = sigmoid(row_sums(w[b] * x[:, None], inner) + bias)
            wrong = (p - target[rows]) * weight[rows][:, None] / len(rows)
            touched, place = np.unique(b, return_inverse=True)
            row = np.repeat(np.arange(len(rows)), size)
            gradient = np.stack([np.bincount(place, x * wrong[row, k], minlength=len(touched)) for k in range(bits)], axis=1)
            seen[touched] += gradient**2
            w[touched] -= STEP * gradient / np.sqrt(seen[touched])
            seen_bias += wrong.sum(axis=0) ** 2
            bias -= 0.1 * wrong.sum(axis=0) / np.sqrt(seen_bias)
    judged = left_out if left_out.any() else ~left_out
    margins = np.stack([row_sums(w[:, k][buckets] * share, first) for k in range(bits)], axis=1) + bias
    hit = (margins > 0) == target
    right = np.stack([(hit[judged & (label == k)].sum(axis=0) + 1.0) / ((judged & (label == k)).sum() + 2.0) for k in range(len(languages))])
    model = Model(languages, words, w, bias, right / right.sum(axis=1, keepdims=True), 1.0)
    losses, truth = model.losses(margins[judged]), label[judged]

    def fitness(slope: float) -> float:
        x = -slope * losses
        x = x - x.max(axis=1, keepdims=True)
        return float((x[np.arange(len(truth)), truth] - np.log(np.exp(x).sum(axis=1))).sum())

    model.slope = max((2.0**k for k in range(-2, 7)), key=fitness)
    return model


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    buckets, first = grams(data, offsets)
    return [np.unique(buckets[a:z], return_counts=True) for a, z in zip(first, first[1:], strict=False)]


def training_rows(docs: DataFrame, train: Column, text: str, lang: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Buckets, their counts, each row's number of buckets, and languages of at most ``most``
    rows. Rows are taken by the hash of their ids and texts, with the share that gives each
    language equal parts, so that no group of rows meets in one task."""
    ship(docs.sparkSession)
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    per_language = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not per_language:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    quota = most / len(per_language)
    shares = F.create_map(*(F.lit(x) for k, n in sorted(per_language.items()) for x in (k, min(1.0, quota / n))))
    drawn = F.xxhash64("doc_id", text) % 1_000_003 / 1_000_003.0
    chosen = rows.where(F.abs(drawn) < F.element_at(shares, F.col(lang)))
    given = chosen.select("doc_id", F.col(lang).alias("lang"), _folded(F.col(text)).alias("text"))
    schema = "h long, lang string, buckets binary, counts binary"

    def run(batches):
        for batch in batches:
            found = [x for data, offsets in pieces(batch.column("text")) for x in _counted(data, offsets)]
            columns = [pa.array([b.astype(np.uint32).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), *columns], ["h", "lang", "buckets", "counts"])

    hashed = given.select(F.xxhash64("doc_id", "text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    got = hashed.mapInArrow(run, schema).orderBy("h", "lang").limit(most).toArrow()
    buckets = got["buckets"].to_pylist()
    return np.frombuffer(b"".join(buckets), np.uint32), np.frombuffer(b"".join(got["counts"].to_pylist()), np.uint32), np.array([len(b) // 4 for b in buckets], np.int64), got["lang"].to_pylist()


def identify(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, ambiguous: float = AMBIGUOUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids, the columns ``keep``, ``lang_pred``, ``score``, ``runner_up`` and ``ambiguous`` of
    all documents; ``train`` tells which rows may be learned from."""
    model = fit(*training_rows(docs, train, text, lang, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the languages' names
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    given = docs.select("doc_id", *keep, letters.alias("_letters"), _folded(F.col(text)).alias("_text"))
    fields = given.select("doc_id", *keep).schema
    out = fields.add("lang_pred", "string").add("score", "double").add("runner_up", "string").add("ambiguous", "boolean")
    names = ["doc_id", *keep]

    def run(batches):
        model = shared.value
        for batch in batches:
            n, found = batch.num_rows, []
            if len(model.languages) > 1:
                found = [model.predict(data, offsets) for data, offsets in pieces(batch.column("_text"))]
            p = np.concatenate(found) if found else np.ones((n, len(model.languages)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *decided(model.languages, p, batch.column("_letters").to_numpy(zero_copy_only=False), ambiguous)], out.names)

    return given.mapInArrow(run, out)


def decided(languages: list[str], p: np.ndarray, letters: np.ndarray, ambiguous: float) -> list[pa.Array]:
    """Prediction, score, runner-up and flag of rows with these likelihoods of languages."""
    n = len(letters)
    if not languages:
        return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.string()), pa.array(np.zeros(n, bool))]
    order = np.argsort(-p, axis=1, kind="stable")
    rows, best = np.arange(n), order[:, 0]
    score = np.where(letters, p[rows, best], 0.0)
    named = np.array([*languages, UNDETERMINED], object)
    next_best = order[:, 1] if len(languages) > 1 else np.zeros(n, int)
    close = letters & (len(languages) > 1) & (score - p[rows, next_best] < ambiguous)
    second = pa.array(named[next_best], pa.string(), mask=~letters | (len(languages) < 2))
    return [pa.array(named[np.where(letters, best, len(languages))], pa.string()), pa.array(score, pa.float64()), second, pa.array(close)]

