"""A corpus clean-up in five stages over ``documents``, part of the ``llm`` subpackage.

Each stage takes the documents its predecessor kept and returns documents with all their
columns, whatever their names; the last one returns what the shards need. A stage's model
learns from labelled rows of its own input (a bounded sample, see the operators) that are
outside fold 0 of crc32(doc_id) mod 5.

Cases: a null or empty text is scored like any other by the classifiers, is no near copy of
anything, holds no benchmark passage and encodes to nothing; a null id is an id that no
label has, and such rows are never near copies; texts of any length are worked on whole; of
rows that repeat each other, or have one id and near copies for texts, one stays, while rows
that repeat an id with unlike texts all stay; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytebpe, ngramjoin, quality, tiling, toxicity
from tessera.llm.queries import vocabulary
from tessera.plans.runtime import Scratch, table


def _where_predicted(docs: DataFrame, score: Callable[[DataFrame], DataFrame], predicted: int) -> DataFrame:
    """The documents with this prediction; columns that are named as a score's come back."""
    own = {c: f"_own_{c}" for c in ("score", "predicted") if c in docs.columns}
    kept = score(docs.withColumnsRenamed(own)).where(F.col("predicted") == predicted)
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below one half."""
    return _where_predicted(docs, lambda d: toxicity.score(d, table(spark, sf_dir, "labels"), keep_text=True), 0)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is at least 0.3."""
    return _where_predicted(docs, lambda d: quality.score(d, table(spark, sf_dir, "labels"), keep_text=True), 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the smallest id, of each group that five-word shingle
    similarities of 0.8 or more connect. Rows without an id or without words stay.

    Where an id repeats, its rows are told apart by their sets of shingles: of a group the
    smallest pair of id and set stays, and of that pair's rows the one with the smallest hash.
    """
    scratch = Scratch(spark, "near-copies")
    found = scratch.save(ngramjoin.cluster(docs, n=5, percent=80, with_sets=True), "components")
    known = found.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    # Aggregates are written before rows of a hot group meet them, so that Spark can split it.
    first = scratch.save(known.groupBy("label").agg(F.min(F.struct("doc_id", "set_id")).alias("first")), "first")
    out = known.join(first, "label").where("doc_id <> first.doc_id OR set_id <> first.set_id").select("doc_id", "set_id").distinct()
    out = scratch.save(out, "out")
    repeated = scratch.save(known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    # Ids of a corpus outgrow a broadcast, so texts are shuffled to them at every size.
    single = docs.join(repeated.unionByName(out.select("doc_id")).distinct().hint("merge"), "doc_id", "left_anti")
    if repeated.isEmpty():
        return single
    rows = docs.join(repeated, "doc_id", "left_semi").select("text", F.struct(*docs.columns).alias("_row"))
    rows = ngramjoin.describe(rows, 5).withColumn("doc_id", F.col("_row.doc_id"))
    sets = rows.where("set_id IS NOT NULL").join(out, ["doc_id", "set_id"], "left_anti")
    one = sets.groupBy("doc_id", "set_id").agg(F.min_by("_row", F.struct(F.xxhash64("_row"), F.col("_row.text"))).alias("_row"))
    return single.unionByName(one.unionByName(rows.where("set_id IS NULL"), allowMissingColumns=True).select("_row.*"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark passage."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes; ids that don't decode to
    the text would show as ``exact`` false."""
    keyed = docs.withColumn("_text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = bytebpe.round_trip(keyed, *vocabulary())
    return coded.withColumn("exact", F.col("_text_sha256") == F.col("decoded_sha256")).drop("_text_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("encoding", encode),
]

#: Trained scores and tokenizers have no SQL form; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    scratch.drop_all_but(STAGES[-1][0].replace(" ", "-"))
    return docs
