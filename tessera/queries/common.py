"""Stand-ins: embeddings are 4 x 4 x 4 volumes, even ids method A and odd ids method B."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import volumes as vol
from tessera.plans.runtime import table

DIM = (4, 4, 4)

VOX = """vox AS (
  SELECT vec_id, CAST(p % 4 + 1 AS INTEGER) AS i, CAST((p // 4) % 4 + 1 AS INTEGER) AS j,
         CAST(p // 16 + 1 AS INTEGER) AS k, CAST(embedding[p + 1] AS DOUBLE) AS v
  FROM embeddings, range(64) AS t(p) WHERE embedding IS NOT NULL
)"""


def r6(x: Column, name: str) -> Column:
    """Six decimals, and never a negative 0, so that sums in another order hash alike."""
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def q6(x: str, name: str = "") -> str:
    return f"(round({x}, 6) + 0.0)" + (f" AS {name}" if name else "")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select("vec_id", "label", vol.doubles(F.col("embedding")).alias("data"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    return vol.to_cells(rows, DIM, ["vec_id"], "embedding")


def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's 64 slots as 16 voxels of an atlas, each with 4 log-probabilities."""
    t = tiles(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("voxel"), "data")
    return t.select("vec_id", "voxel", F.slice("data", F.col("voxel") * 4 + 1, F.lit(4)).alias("logp"))


ATLAS = """atlas AS (
  SELECT vec_id, CAST(a AS INTEGER) AS voxel, list_transform(embedding[4 * a + 1:4 * a + 4], lambda x: CAST(x AS DOUBLE)) AS l
  FROM embeddings, range(16) AS t(a) WHERE embedding IS NOT NULL
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as subjects, return flags as tissues, line status as methods F (x), O (y)."""
    lines = table(spark, sf_dir, "lineitem")
    by = lines.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("tissue"))
    return by.agg(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount").cast("double"))).alias("x"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount").cast("double"))).alias("y"))


def pairs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, each mean's values added in the order of the files' rows, however
    tasks divide them: ranks tell means apart that differ in the last bit only."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus IN ('F', 'O') AND l_discount IS NOT NULL")
    value = F.struct(F.col("_metadata.row_index").alias("at"), (F.col("l_linestatus") == "F").alias("f"), F.col("l_discount").cast("double").alias("v"))
    of_file = lines.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("tissue"), F.col("_metadata.file_path").alias("_file")).agg(F.array_sort(F.collect_list(value)).alias("_rows"))
    met = of_file.groupBy("subject", "tissue").agg(F.array_sort(F.collect_list(F.struct("_file", "_rows"))).alias("_files"))
    met = met.select("subject", "tissue", F.flatten(F.transform("_files", lambda f: f["_rows"])).alias("_rows"))

    def mean(of: Column) -> Column:
        return F.try_divide(F.aggregate(of, F.lit(0.0), lambda s, r: s + r["v"]), F.size(of).cast("double"))

    return met.select("subject", "tissue", mean(F.filter("_rows", lambda r: r["f"])).alias("x"), mean(F.filter("_rows", lambda r: ~r["f"])).alias("y"))


PAIRS = """pairs AS (
  SELECT l_suppkey AS subject, l_returnflag AS tissue,
         avg(CASE WHEN l_linestatus = 'F' THEN CAST(l_discount AS DOUBLE) END) AS x,
         avg(CASE WHEN l_linestatus = 'O' THEN CAST(l_discount AS DOUBLE) END) AS y
  FROM lineitem GROUP BY ALL
)"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumetrics: each supplier's quantity by line status, F as x and O as y."""
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(F.sum(F.when(F.col("l_linestatus") == "F", q)).alias("x"), F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("y"))


TOTALS = """totals AS (
  SELECT l_suppkey AS subject,
         sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DOUBLE) END) AS x,
         sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DOUBLE) END) AS y
  FROM lineitem GROUP BY ALL
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets 0 / 1 with the document's length as score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("target"), F.col("n_chars").cast("double").alias("score"))


SCORED = """scored AS (
  SELECT l.doc_id, d.lang, l.quality AS target, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d USING (doc_id)
)"""
