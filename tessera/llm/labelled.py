"""Folds, bounded labelled samples and scoring passes of the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textkernel import spans, utf8
from tessera.plans.runtime import ship


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _chosen(labels: DataFrame, label: str, most: int, folds: int, out_fold: int) -> DataFrame:
    """Ids and labels (``_y``) of at most ``most`` labelled documents of the training folds.

    Which ones is by a hash of the id, so the sample is the same for the same rows. A
    document with several labels counts with the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    return known.where(remainder(F.col("doc_id"), folds) != out_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5, out_fold: int = 0) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Texts and labels of the sample. An id that repeats counts with each of its rows, by
    the order of their texts' hashes (at most ``most`` rows in all)."""
    chosen = _chosen(labels, label, most, folds, out_fold)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy("doc_id", "_h").limit(most).select("text", "_y").toArrow()
    return rows["text"], rows["_y"].to_numpy().astype(np.float64)


def training_features(docs: DataFrame, labels: DataFrame, label: str, most: int, extract: Callable, folds: int = 5, out_fold: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same sample's feature buckets, how many each row has, and its labels. Features
    are made where the texts are, so that a long text sends no more than its distinct
    buckets, of which there is a fixed number."""
    ship(docs.sparkSession)
    chosen = _chosen(labels, label, most, folds, out_fold)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h")).join(F.broadcast(chosen.withColumn("_y", F.col("_y").cast("double"))), "doc_id")
    schema = rows.drop("text").schema.add("features", "binary")

    def run(batches):
        for batch in batches:
            found = []
            for data, offsets in pieces(batch.column("text")):
                buckets, first = extract(data, offsets)
                found += [buckets[a:z].astype(np.uint32).tobytes() for a, z in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(found, pa.binary())], schema.names)

    got = rows.select(*schema.names[:-1], "text").mapInArrow(run, schema).orderBy("doc_id", "_h").limit(most).select("_y", "features").toArrow()
    features = got["features"].to_pylist()
    return np.frombuffer(b"".join(features), np.uint32), np.array([len(x) // 4 for x in features], np.int64), got["_y"].to_numpy()


def pieces(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of whole texts, a bounded number of bytes at a time."""
    data, offsets = utf8(texts)
    for a, z in spans(offsets):
        yield data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]


def features_of(texts: pa.Array | pa.ChunkedArray, extract: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of texts, and how many each has."""
    parts = [extract(d, o) for d, o in pieces(texts)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([np.diff(f) for _, f in parts])


def add_scores(df: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], threshold: float, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``score`` and ``predicted``; the scorer sees the bytes of whole texts only."""
    ship(df.sparkSession)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields = [f for f in df.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    names = [f.name for f in fields]

    def run(batches):
        score = make_scorer()
        for batch in batches:
            found = [score(data, offsets) for data, offsets in pieces(batch.column(text))]
            p = np.clip(np.concatenate(found), 0.0, 1.0) if found else np.zeros(0)
            cols = [*(batch.column(n) for n in names), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*fields, *new]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
