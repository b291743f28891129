"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import brown, bytebpe, hashtree, htmltext, labelled, language, ngramjoin, periodic, quality, shards, spelling, tiling, topk, toxicity
from tessera.plans.runtime import table


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component and number of links to other sets, all of them verified."""
    return ngramjoin.cluster(table(spark, sf_dir, "documents"), n=4, percent=85, all_links=True)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytebpe.round_trip(docs, *vocabulary())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _with_fold(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_fold(toxicity.score(docs, table(spark, sf_dir, "labels")))


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_fold(quality.score(docs, table(spark, sf_dir, "labels")))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = labelled.remainder(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return brown.score(docs, ~F.col("held_out"))


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("vector"))
    return topk.search(rows, F.col("vec_id") % 50 == 0, k=5)


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(table(spark, sf_dir, "documents"), *vocabulary())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = labelled.remainder(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text", "lang")
    return language.identify(docs, ~F.col("held_out"), keep=("held_out",))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), u AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), sets AS (
  SELECT doc_id, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s
), links AS (
  SELECT l.a AS doc_id, count(DISTINCT y.k) FILTER (x.k <> y.k) AS n_links
  FROM link l JOIN sets x ON x.doc_id = l.a JOIN sets y ON y.doc_id = l.b GROUP BY l.a
), components AS (
  SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id
  FROM s LEFT JOIN reach ON a = s.doc_id GROUP BY s.doc_id, len(s)
)
SELECT doc_id, n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM components LEFT JOIN links USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

#: crc32 by its table of 256 entries, of a list of byte values.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ID_BYTES = "list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"

OP11_SQL = rf"""
WITH {CRC_TABLE}, d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc_sql(ID_BYTES)} AS h FROM documents, crc
), a AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d
), b AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), m AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM b
), x AS MATERIALIZED (
  SELECT r, list_transform(w, lambda s: hash(s)) AS w, n FROM m
), q AS (
  SELECT r, w, n, unnest(range(1, n // 4 + 1)) AS q FROM x
), e AS (
  SELECT r, q, unnest(list_filter(range(0, n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM q
), s AS (
  SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM e
), o AS (
  SELECT r, q, min(i) AS s, count(*) + q AS n FROM s GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), u AS MATERIALIZED (
  SELECT r, s, n, min(q) AS q FROM o GROUP BY r, s, n
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM u
), kept AS (
  SELECT r, string_agg(v.w, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS w, unnest(range(0, n)) AS i FROM m) v ANTI JOIN gone USING (r, i) GROUP BY r
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, s, q) AS k FROM u
), all_runs AS (
  SELECT r, count(*) AS c, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM u GROUP BY r
)
SELECT m.doc_id, coalesce(c, 0) AS n_runs, s AS start, best.n AS length, q AS period, 1000 * best.n // q AS exponent_milli,
       sha256(coalesce(all_runs.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM m LEFT JOIN all_runs USING (r) LEFT JOIN kept USING (r) LEFT JOIN best ON best.r = m.r AND k = 1
"""
#: Of an id, a colon and a word of Latin letters in UTF-8.
WORD_BYTES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) - 64 AS BIGINT)] END))"

OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents
), c AS (
  SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 7 GROUP BY ALL
), h AS (
  SELECT w, n, {crc_sql(WORD_BYTES)} AS h FROM c, crc
), v AS MATERIALIZED (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2
), i AS (
  SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v
), one AS MATERIALIZED (
  SELECT w, i, substr(w, 1, i - 1) AS a, substr(w, i + 1) AS z FROM i
), shorter AS (
  SELECT DISTINCT one.w AS w, v.w AS y FROM one JOIN v ON v.w = a || z
), near AS (
  SELECT p.w, q.w AS y FROM one p JOIN one q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND p.w <> q.w
  UNION ALL SELECT w, y FROM shorter UNION ALL SELECT y, w FROM shorter
), b AS (
  SELECT near.w, y, v.n, count(*) OVER (PARTITION BY near.w) AS n_near, row_number() OVER (PARTITION BY near.w ORDER BY v.n DESC, y) AS k FROM near JOIN v ON v.w = y
), f AS MATERIALIZED (
  SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN y END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n FROM v LEFT JOIN b ON b.w = v.w AND k = 1
), r AS (
  SELECT w, w AS root, form FROM f UNION ALL SELECT r.w, f.w, f.form FROM r JOIN f ON f.w = r.form
)
SELECT f.w AS word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.w = f.w AND r.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_byte_bpe, op3_html_text, op4_toxicity_fm, op5_quality_nbsvm, op6_brown_lm, op7_hash_tree, op8_exact_topk, op9_string_tiling, op10_training_order, op11_periodic_runs, op12_language_ecoc, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op8_exact_topk": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op13_spelling_variants": OP13_SQL}
