"""The stages against plain code on the small tables."""

import re
import zlib

import pytest
from pyspark.sql import functions as F
from brute import components_by_brute_force
from test_tiling import brute as contaminated

import corpus_pipeline
from tessera.llm import labelled, quality, toxicity
from tessera.plans.runtime import table


def pieces_scores(model, texts):
    import pyarrow as pa

    return [float(s) for d, o in labelled.pieces(pa.array(texts)) for s in model.scores(d, o)]


def test_run_equals_plain_stages(spark, sf_dir):
    rows = [r.asDict() for r in table(spark, sf_dir, "documents").collect()]
    for label, module, keep in (("toxic", toxicity, lambda s: s < 0.5), ("quality", quality, lambda s: s >= 0.3)):
        frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
        model = module.fit(*labelled.training_sample(frame, table(spark, sf_dir, "labels"), label, module.SAMPLE))
        scores = pieces_scores(model, [r["text"] for r in rows])
        rows = [r for r, s in zip(rows, scores, strict=True) if keep(s)]
    found = components_by_brute_force([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for r in rows if found[r["doc_id"]][1] == r["doc_id"]]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    bad = {d for d, _, _ in contaminated([(r["doc_id"], r["text"]) for r in rows], items)}
    want = {r["doc_id"] for r in rows} - bad
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == want
    assert all(r.exact for r in got)


def test_clean_documents_stay_and_stages_return_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.count() > 0.6 * docs.count(), name


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_nulls_and_more_columns(spark, sf_dir, name, stage):
    docs = table(spark, sf_dir, "documents")
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "some words", None, None, None, "y"), (3, "a b c d e f g", "en", "s", 13, "z"), (3, "a b c d e f g", "en", "s", 13, "z")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    ids = sorted(str(r.doc_id) for r in stage(spark, odd, sf_dir).collect())
    assert set(ids) <= {"1", "2", "3", "None"}
    if name == "near copies":
        assert ids == ["1", "2", "3", "None"]


def test_repeated_ids_lose_only_near_copies(spark, sf_dir):
    words = [f"w{n}" for n in range(60)]
    near, other = " ".join(words), " ".join(f"v{n}" for n in range(60))
    rows = [(1, near, 7), (1, other, 7), (2, near + " tail", 8), (1, near, 7), (3, other + " x", 9), (4, "", 1), (4, None, 2), (None, near, 3), (5, "alone here with some words", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id long").repartition(4)
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(1, near, 7), (1, other, 7), (4, "", 1), (4, None, 2), (None, near, 3), (5, "alone here with some words", 4)], key=str)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(50).withColumn("score", F.lit("own")).withColumn("predicted", F.lit(3)).withColumn("label", F.col("doc_id") + 1).withColumn("component_id", F.lit("c"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0 and out.count() > 0, name


def test_folds_are_crc32(spark):
    rows = spark.range(50).select("id", labelled.remainder(labelled.F.col("id"), 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert re.fullmatch(r"\d", str(rows[0].m))
