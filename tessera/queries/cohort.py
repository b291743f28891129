"""Cohort operators on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import strings
from tessera.operators import cohort as co
from tessera.plans.runtime import table
from tessera.queries.common import PAIRS, pairs, q6, r6
from tessera.sources.files import parse_demographics


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("bal"))


def exclude_anti(spark, d):
    s = _suppliers(spark, d)
    listed = s.join(table(spark, d, "nation").where("n_name LIKE '%A'").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi").select("subject")
    return co.exclude(s.select("subject", "s_name"), listed)


def test_semi(spark, d):
    s = _suppliers(spark, d)
    return co.only(s.select("subject", "s_name"), s.where("subject % 7 = 0").select("subject"))


def first_n(spark, d):
    return co.first_n(_suppliers(spark, d).select("subject", "s_name"), 12)


def complete_case(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("method"))
    return co.complete_cases(o, ["F", "O", "P"])


def complete_nonzero(spark, d):
    """Values are 0 but for large seventh lines, so that some subjects lack a tissue."""
    value = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), F.col("l_quantity").cast("double")).otherwise(0.0)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linestatus").alias("method"), F.col("l_returnflag").alias("tissue"), value.alias("value"))
    return co.complete_nonzero(rows, 6)


def first_match_lookup(spark, d):
    """Each customer's first order (by date, then key), whatever else they ordered."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), "c_name")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return co.lookup(c, o, "subject", ["o_orderdate", "first_order"]).select("subject", "c_name", "first_order")


def fallback_source(spark, d):
    """The quality label where there is one, else a guess from the length."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 100, 1).otherwise(0).alias("quality"))
    return co.fallback(table(spark, d, "labels").select("doc_id", "quality"), docs, "doc_id", ["quality"]).select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("source").cast("int").alias("source"))


def worst_first(spark, d):
    rows = co.worst_first(pairs(spark, d).select("subject", "x"), "subject", "x")
    return rows.select("subject", r6(F.col("mean_value"), "mean_value"))


def argbest(spark, d):
    best = co.best_of(_suppliers(spark, d), "bal", "subject", ["s_nationkey"])
    return best.select("s_nationkey", "subject", r6(F.col("bal"), "bal"))


def middle_subject(spark, d):
    rows = co.median_row(_suppliers(spark, d), "bal", "subject", ["s_nationkey"])
    return rows.select("s_nationkey", "subject", r6(F.col("bal"), "bal"))


def set_operations(spark, d):
    o = table(spark, d, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("subject"))
    part = lambda df, name: df.select("subject", F.lit(name).alias("part"))
    return part(of("F").intersect(of("O")), "both").unionByName(part(of("F").exceptAll(of("O")).distinct(), "more in F")).unionByName(part(of("P").union(of("F")).distinct(), "either"))


def success_counts(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(*(F.max((F.col("o_orderstatus") == s).cast("int")).alias(s) for s in "FOP"))
    return o.agg(F.count("*").alias("n"), *(F.sum(s).alias(f"n_{s.lower()}") for s in "FOP"), F.count_if((F.col("F") == 1) & (F.col("O") == 1) & (F.col("P") == 1)).alias("n_complete"))


def configurations(spark, d):
    """All combinations of the settings that customers stand for; numbers of iterations vary
    for one machine only."""
    c = table(spark, d, "customer")
    axes = {"machine": F.col("c_mktsegment"), "fwhm": (F.col("c_nationkey") % 3 * 4 + 4).cast("int"), "iterations": (F.col("c_custkey") % 2 * 50 + 50).cast("int")}
    return co.configurations_of(c, axes, {"iterations": ("machine", ["BUILDING", "MACHINERY"])})


def class_map(spark, d):
    """Lines' tax classes as Gaussians, mapped to three tissues."""
    mapping = spark.createDataFrame([(g, "GM" if g < 3 else "WM" if g < 6 else "CSF") for g in range(9)], "g int, tissue string")
    lines = table(spark, d, "lineitem").select(F.round(F.col("l_tax").cast("double") * 100).cast("int").alias("g"))
    counted = lines.groupBy("g").agg(F.count("*").alias("n"))  # nine classes: lines themselves would meet in as many tasks
    return counted.join(F.broadcast(mapping), "g").groupBy("tissue").agg(F.sum("n").alias("n"))


def demographics(spark, d):
    c = table(spark, d, "customer")
    age = F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0"), F.lit("Y")))
    sex = F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("?")
    return parse_demographics(c.select(F.col("c_custkey").alias("ID"), age.alias("PatientAge"), sex.alias("PatientSex"))).select("subject_id", r6(F.col("age"), "age"), "sex")


def parse_paths(spark, d):
    p = F.concat(F.lit("/data/"), F.col("s_name"), F.lit("/c1_x = "), F.col("s_suppkey").cast("string"), F.lit(".nii.gz"))
    s = table(spark, d, "supplier").select("s_suppkey", p.alias("path"))
    key, value = strings.key_value(F.lit(" DimSize = 1 2 = 3 "))
    return s.select("s_suppkey", strings.file_folder(F.col("path")).alias("folder"), strings.file_stem(F.col("path")).alias("stem"), strings.strip_tissue_prefix(F.lit("c2name")).alias("bare"), key.alias("key"), value.alias("value"))


def requested_outputs(spark, d):
    wanted = spark.createDataFrame([("A", "F"), ("R", "F"), ("N", "O")], "class string, space string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("class"), F.col("l_linestatus").alias("space"))
    return co.requested(rows, wanted).groupBy("class", "space").agg(F.count("*").alias("n"))


def pending_work(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.lit("segment").alias("step"), F.col("o_orderkey").alias("input"), "o_orderstatus")
    done = o.where("o_orderstatus = 'F'")
    return co.pending(o, done, ["subject", "step", "input"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def failure_log(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.col("user_id").alias("subject")).agg(F.count("*").alias("n_failures"))


def category_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def number_format(spark, d):
    x = _suppliers(spark, d).withColumn("p", F.col("subject") / F.lit(17001.0))
    return x.select("subject", num.format_interval(F.lit(0.5), F.col("p"), F.lit(0.125)).alias("shown"), num.format_p(F.col("p")).alias("p_shown"))


def paired_translation(spark, d):
    """One shift for both images of a subject."""
    s = _suppliers(spark, d)
    images = s.select("subject", F.explode(F.array(F.lit("CT"), F.lit("MR"))).alias("image"), F.col("bal").alias("x0"))
    shift = s.where("subject % 2 = 0").select("subject", (F.col("bal") / 100).alias("dx"))
    return images.join(shift, "subject").select("subject", "image", r6(F.col("x0") + F.col("dx"), "x"))


QUERIES = {
    "exclude_anti": (exclude_anti, "SELECT s_suppkey AS subject, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A')"),
    "test_semi": (test_semi, "SELECT s_suppkey AS subject, s_name FROM supplier WHERE s_suppkey % 7 = 0"),
    "first_n": (first_n, "SELECT s_suppkey AS subject, s_name FROM supplier ORDER BY 1 LIMIT 12"),
    "complete_case": (complete_case, "SELECT o_custkey AS subject FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3"),
    "complete_nonzero": (complete_nonzero, "SELECT subject FROM (SELECT l_suppkey AS subject, l_linestatus, l_returnflag, sum(CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN CAST(l_quantity AS DOUBLE) ELSE 0 END) AS s FROM lineitem GROUP BY ALL) GROUP BY 1 HAVING count(*) FILTER (s > 0) = 6"),
    "first_match_lookup": (first_match_lookup, "SELECT c_custkey AS subject, c_name, first_order FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS first_order, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) o ON c_custkey = o_custkey AND r = 1"),
    "fallback_source": (fallback_source, "SELECT d.doc_id, CAST(coalesce(l.quality, CASE WHEN n_chars > 100 THEN 1 ELSE 0 END) AS INTEGER) AS quality, CAST(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS source FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "worst_first": (worst_first, f"WITH {PAIRS} SELECT subject, {q6('avg(x)', 'mean_value')} FROM pairs GROUP BY subject"),
    "argbest": (argbest, f"SELECT s_nationkey, s_suppkey AS subject, {q6('CAST(s_acctbal AS DOUBLE)', 'bal')} FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1"),
    "middle_subject": (middle_subject, f"SELECT s_nationkey, s_suppkey AS subject, {q6('CAST(s_acctbal AS DOUBLE)', 'bal')} FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE r = greatest(round(n / 2.0), 1)"),
    "set_operations": (
        set_operations,
        """WITH f AS (SELECT o_custkey AS s FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_custkey AS s FROM orders WHERE o_orderstatus = 'O'), p AS (SELECT o_custkey AS s FROM orders WHERE o_orderstatus = 'P')
SELECT s AS subject, 'both' AS part FROM (SELECT s FROM f INTERSECT SELECT s FROM o)
UNION ALL SELECT DISTINCT s, 'more in F' FROM (SELECT s FROM f EXCEPT ALL SELECT s FROM o)
UNION ALL SELECT s, 'either' FROM (SELECT s FROM p UNION SELECT s FROM f)""",
    ),
    "success_counts": (
        success_counts,
        "SELECT count(*) AS n, CAST(sum(f) AS BIGINT) AS n_f, CAST(sum(o) AS BIGINT) AS n_o, CAST(sum(p) AS BIGINT) AS n_p, count(*) FILTER (f = 1 AND o = 1 AND p = 1) AS n_complete FROM (SELECT o_custkey, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS f, max(CAST(o_orderstatus = 'O' AS INTEGER)) AS o, max(CAST(o_orderstatus = 'P' AS INTEGER)) AS p FROM orders GROUP BY 1)",
    ),
    "configurations": (
        configurations,
        "SELECT DISTINCT machine, fwhm, CASE WHEN machine IN ('BUILDING', 'MACHINERY') THEN iterations END AS iterations FROM (SELECT DISTINCT c_mktsegment AS machine FROM customer), (SELECT DISTINCT CAST(c_nationkey % 3 * 4 + 4 AS INTEGER) AS fwhm FROM customer), (SELECT DISTINCT CAST(c_custkey % 2 * 50 + 50 AS INTEGER) AS iterations FROM customer)",
    ),
    "class_map": (class_map, "SELECT CASE WHEN g < 3 THEN 'GM' WHEN g < 6 THEN 'WM' ELSE 'CSF' END AS tissue, count(*) AS n FROM (SELECT CAST(round(CAST(l_tax AS DOUBLE) * 100) AS INTEGER) AS g FROM lineitem) GROUP BY 1"),
    "demographics": (demographics, f"SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 11 <> 0 THEN {q6('CAST(c_custkey % 100 AS DOUBLE)')} END AS age, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER) AS sex FROM customer"),
    "parse_paths": (parse_paths, "SELECT s_suppkey, '/data/' || s_name AS folder, 'c1_x = ' || s_suppkey AS stem, 'name' AS bare, 'DIMSIZE' AS key, '1 2 = 3' AS value FROM supplier"),
    "requested_outputs": (requested_outputs, "SELECT l_returnflag AS class, l_linestatus AS space, count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F'), ('N', 'O')) GROUP BY ALL"),
    "pending_work": (pending_work, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"),
    "failure_log": (failure_log, "SELECT user_id AS subject, count(*) AS n_failures FROM events WHERE event_type = 'error' GROUP BY 1"),
    "category_counts": (category_counts, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "number_format": (number_format, "SELECT s_suppkey AS subject, printf('%.3f [%.3f, %.3f]', CAST(0.5 AS DOUBLE), s_suppkey / CAST(17001 AS DOUBLE), CAST(0.125 AS DOUBLE)) AS shown, CASE WHEN s_suppkey / CAST(17001 AS DOUBLE) < 0.001 THEN '<0.001' ELSE printf('%.3f', s_suppkey / CAST(17001 AS DOUBLE)) END AS p_shown FROM supplier"),
    "paired_translation": (paired_translation, f"SELECT s_suppkey AS subject, image, {q6('CAST(s_acctbal AS DOUBLE) + CAST(s_acctbal AS DOUBLE) / 100', 'x')} FROM supplier, (VALUES ('CT'), ('MR')) t(image) WHERE s_suppkey % 2 = 0"),
}
