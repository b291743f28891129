"""Statistics on paired measurements and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cohort as co
from tessera.operators import statistics as st
from tessera.plans.runtime import table
from tessera.queries.common import PAIRS, SCORED, TOTALS, pairs, pairs_in_order, q6, r6, scored, totals


def _round(df, keys, values):
    return df.select(*keys, *(r6(F.col(v), v) for v in values))


def summary_stats(spark, d):
    return _round(st.summary(pairs(spark, d), ["tissue"], "x"), ["tissue", "n"], ["mean", "sd", "median", "min", "max"])


def runtime_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), F.col("value").cast("double").alias("runtime_s"))
    return _round(st.summary(e, ["method"], "runtime_s"), ["method", "n"], ["mean", "sd", "median", "min", "max"])


def bland_altman(spark, d):
    return _round(st.bland_altman(pairs(spark, d), ["tissue"], "x", "y"), ["tissue", "n"], ["bias", "lower", "upper"])


def pearson(spark, d):
    return _round(st.correlation(pairs(spark, d), ["tissue"], "x", "y"), ["tissue", "n"], ["r"])


def icc31(spark, d):
    return _round(st.icc(pairs(spark, d), ["tissue"], "x", "y"), ["tissue", "n"], ["icc"])


def icc_ci(spark, d):
    return _round(st.icc_interval(totals(spark, d).withColumn("g", F.lit(1)), ["g"], "x", "y"), ["n"], ["icc", "lower", "upper"])


QUARTILES = ((0.25, 0.5, 0.75, 0.95), ("q25", "q50", "q75", "q95"))


def hazen_iqr(spark, d):
    return _round(st.hazen(pairs(spark, d), ["tissue"], "x", *QUARTILES), ["tissue"], QUARTILES[1])


def wilcoxon_w(spark, d):
    return _round(st.signed_rank(pairs_in_order(spark, d), ["tissue"], "x", "y"), ["tissue", "n"], ["w_plus", "w_minus", "ties"])


def wilcoxon_p(spark, d):
    return _round(st.signed_rank_test(pairs_in_order(spark, d), ["tissue"], "x", "y"), ["tissue", "n"], ["w_plus", "p"])


def bonferroni_flag(spark, d):
    p = pairs(spark, d).groupBy("tissue").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("x").alias("n"))
    raw = F.col("n") / 10000.0
    metric = F.when(F.col("tissue") == "A", "dice").otherwise("hd95")
    return p.select("tissue", r6(st.bonferroni(raw, 3), "p"), st.better_flag(metric, st.bonferroni(raw, 3), F.col("x"), F.col("y")).alias("mark"))


def pred_errors(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("double"))).alias("t"), F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("double"))).alias("p"))
    o = o.select((F.col("o_custkey") % 3).alias("method"), (F.col("t") / 1000).alias("t"), (F.col("p") / 1000).alias("p"))
    return _round(st.prediction_errors(o, ["method"], "t", "p"), ["method", "n"], ["rmse", "mae", "sd", "bias", "r", "r2"])


def accuracy(spark, d):
    s = scored(spark, d).withColumn("predicted", (F.col("score") > 1000).cast("int"))
    return _round(st.accuracy(s, ["lang"], "target", "predicted"), ["lang", "n"], ["accuracy"])


def auc_pairs(spark, d):
    return _round(st.auc_by_ranks(scored(spark, d), ["lang"], "target", "score"), ["lang", "n_pos", "n_neg"], ["auc"])


def auc_other_class(spark, d):
    return _round(st.auc_by_ranks(scored(spark, d), ["lang"], "target", "score", 0), ["lang", "n_pos", "n_neg"], ["auc"])


def roc_curve(spark, d):
    return _round(st.roc_curve(scored(spark, d), ["lang"], "target", "score"), ["lang", "score"], ["fpr", "tpr"])


def roc_area(spark, d):
    return _round(st.roc_area(scored(spark, d), ["lang"], "target", "score"), ["lang"], ["auc"])


def histogram15(spark, d):
    return st.histogram(scored(spark, d), "score", 15)


def boxplot_stats(spark, d):
    return _round(st.box_plot(totals(spark, d).withColumn("g", F.col("subject") % 4), ["g"], "x"), ["g", "n_outliers"], ["q25", "q50", "q75", "whisker_low", "whisker_high"])


def tissue_mean(spark, d):
    return pairs(spark, d).groupBy("subject").agg(r6(F.avg("y"), "mean_y"))


def distinct_scores(spark, d):
    return scored(spark, d).groupBy("lang").agg(F.countDistinct("score").alias("n_scores"), F.countDistinct("target").alias("n_targets"))


def grid_best(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("machine"), F.col("l_linenumber").alias("fwhm")).agg(F.sum(F.col("l_quantity").cast("double")).alias("score"))
    return _round(co.best_of(g.withColumn("tie", F.concat("machine", F.col("fwhm").cast("string"))), "score", "tie", highest=False), ["machine", "fwhm"], ["score"])


def paired_present(spark, d):
    return st.paired(pairs(spark, d), "x", "y").groupBy("tissue").agg(F.count("*").alias("n"))


def _mid(x="x"):
    return f"""held AS (SELECT tissue, {x} AS v FROM pairs WHERE {x} IS NOT NULL),
ranked AS (SELECT tissue, v, row_number() OVER (PARTITION BY tissue ORDER BY v) AS r, count(*) OVER (PARTITION BY tissue) AS n FROM held)"""


def _hazen_sql(group, p):
    h = f"least(greatest({p} * n + 0.5, 1), n)"
    return f"sum(CASE WHEN r = floor({h}) THEN v * (1 - ({h} - floor({h}))) WHEN r = floor({h}) + 1 THEN v * ({h} - floor({h})) ELSE 0 END)"


SIGNED = f"""WITH {PAIRS}, d AS (SELECT tissue, x - y AS d FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL AND x - y <> 0),
r AS (SELECT tissue, d, rank() OVER (PARTITION BY tissue ORDER BY abs(d)) + (count(*) OVER (PARTITION BY tissue, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY tissue, abs(d)) AS t FROM d)
SELECT tissue, count(*) AS n, {q6("coalesce(sum(r) FILTER (d > 0), 0)", "w_plus")}, {q6("coalesce(sum(r) FILTER (d < 0), 0)", "w_minus")}, {q6("CAST(sum(t * t - 1) AS DOUBLE)", "ties")} FROM r GROUP BY tissue"""

POINTS = f"""{SCORED}, c AS (SELECT lang, score, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN target = 1 THEN 0 ELSE 1 END) AS q FROM scored WHERE score IS NOT NULL AND target IS NOT NULL GROUP BY ALL),
points AS (
  SELECT lang, score, CAST(sum(q) OVER w AS DOUBLE) / nullif(CAST(sum(q) OVER a AS DOUBLE), 0) AS fpr, CAST(sum(p) OVER w AS DOUBLE) / nullif(CAST(sum(p) OVER a AS DOUBLE), 0) AS tpr
  FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC), a AS (PARTITION BY lang)
  UNION ALL SELECT DISTINCT lang, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c
)"""


def _auc_sql(positive):
    return f"""WITH {SCORED}, r AS (SELECT lang, target, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / CAST(2 AS DOUBLE) AS r FROM scored WHERE score IS NOT NULL AND target IS NOT NULL),
s AS (SELECT lang, count(*) FILTER (target = {positive}) AS n_pos, count(*) FILTER (target <> {positive}) AS n_neg, coalesce(sum(r) FILTER (target = {positive}), 0) AS rp FROM r GROUP BY lang)
SELECT lang, n_pos, n_neg, {q6("(rp - n_pos * (n_pos + 1) / CAST(2 AS DOUBLE)) / nullif(CAST(n_pos * n_neg AS DOUBLE), 0)", "auc")} FROM s"""


def _summary_sql(key, value):
    return f"{key}, count({value}) AS n, {q6(f'avg({value})', 'mean')}, {q6(f'CASE WHEN count({value}) = 1 THEN 0 ELSE stddev_samp({value}) END', 'sd')}, {q6(f'median({value})', 'median')}, {q6(f'min({value})', 'min')}, {q6(f'max({value})', 'max')}"


BOTH = "x IS NOT NULL AND y IS NOT NULL"


def _simpson(f, low, high, steps):
    """The integral of f(t) by Simpson's rule, as SQL."""
    at = f"({low} + ({high} - ({low})) * g / CAST({steps} AS DOUBLE))"
    weight = f"CASE WHEN g IN (0, {steps}) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END"
    return f"list_sum(list_transform(range({steps + 1}), lambda g: ({weight}) * {f(at)})) * ({high} - ({low})) / CAST({3 * steps} AS DOUBLE)"


# The beta distribution of equal parameters is the F distribution of equal degrees of
# freedom; it is symmetric, so half of it is integrated, and its quantile is bisected.
_HALF_BETA = lambda t: f"pow(greatest(4 * {t} * (1 - {t}), CAST(0 AS DOUBLE)), m / CAST(2 AS DOUBLE) - 1)"
ICC_CI = f"""WITH RECURSIVE {TOTALS}, h AS (SELECT count(*) AS n, count(*) - 1 AS m, 2 * covar_samp(x, y) / (var_samp(x) + var_samp(y)) AS icc FROM totals WHERE {BOTH}),
w AS (SELECT m, {_simpson(_HALF_BETA, "CAST(0.5 AS DOUBLE)", "CAST(1 AS DOUBLE)", 4000)} AS half FROM h),
b AS (
  SELECT 0 AS k, CAST(0.5 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN part < 0.475 THEN mid ELSE lo END, CASE WHEN part < 0.475 THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, mid, {_simpson(_HALF_BETA, "CAST(0.5 AS DOUBLE)", "mid", 4000)} / (2 * half) AS part FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid, m, half FROM b, w WHERE k < 45))
), q AS (SELECT lo / (1 - lo) AS q FROM b WHERE k = 45), f AS (SELECT n, icc, (1 + icc) / (1 - icc) AS f, q FROM h, q)
SELECT n, {q6("icc", "icc")}, {q6("(f / q - 1) / (f / q + 1)", "lower")}, {q6("(f * q - 1) / (f * q + 1)", "upper")} FROM f"""

_DENSITY = lambda t: f"exp(-{t} * {t} / 2) / sqrt(2 * pi())"
WILCOXON_P = f"""{SIGNED.rpartition("SELECT tissue")[0].rstrip()},
s AS (SELECT tissue, count(*) AS n, CAST(coalesce(sum(r) FILTER (d > 0), 0) AS DOUBLE) AS w, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY tissue),
z AS (SELECT *, least(w, n * (n + 1) / 2.0 - w) AS low, abs(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z FROM s),
few AS (SELECT tissue, count(*) FILTER (list_sum(list_transform(range(1, n + 1), lambda g: CAST(g * ((mask >> (g - 1)) & 1) AS BIGINT))) <= low) AS ways, count(*) AS all_ways FROM z, range(32768) AS x(mask) WHERE n <= 15 AND mask < (1 << n) GROUP BY tissue)
SELECT tissue, n, {q6("w", "w_plus")}, {q6(f"least(CASE WHEN n <= 15 AND ties = 0 AND w = floor(w) THEN 2 * ways / CAST(all_ways AS DOUBLE) ELSE 1 - 2 * {_simpson(_DENSITY, 'CAST(0 AS DOUBLE)', 'z', 4000)} END, 1)", "p")} FROM z LEFT JOIN few USING (tissue)"""

QUERIES = {
    "summary_stats": (summary_stats, f"WITH {PAIRS} SELECT {_summary_sql('tissue', 'x')} FROM pairs WHERE x IS NOT NULL GROUP BY tissue"),
    "runtime_summary": (runtime_summary, f"SELECT {_summary_sql('event_type AS method', 'CAST(value AS DOUBLE)')} FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "bland_altman": (bland_altman, f"WITH {PAIRS} SELECT tissue, count(*) AS n, {q6('avg(y - x)', 'bias')}, {q6('avg(y - x) - 1.96 * stddev_samp(y - x)', 'lower')}, {q6('avg(y - x) + 1.96 * stddev_samp(y - x)', 'upper')} FROM pairs WHERE {BOTH} GROUP BY tissue"),
    "pearson": (pearson, f"WITH {PAIRS} SELECT tissue, count(*) AS n, {q6('corr(x, y)', 'r')} FROM pairs WHERE {BOTH} GROUP BY tissue"),
    "icc31": (icc31, f"WITH {PAIRS} SELECT tissue, count(*) AS n, {q6('2 * covar_samp(x, y) / nullif(var_samp(x) + var_samp(y), 0)', 'icc')} FROM pairs WHERE {BOTH} GROUP BY tissue"),
    "icc_ci": (icc_ci, ICC_CI),
    "hazen_iqr": (hazen_iqr, f"WITH {PAIRS}, {_mid()} SELECT tissue, " + ", ".join(q6(_hazen_sql("tissue", p), n) for p, n in zip(*QUARTILES, strict=True)) + " FROM ranked GROUP BY tissue"),
    "wilcoxon_w": (wilcoxon_w, SIGNED),
    "wilcoxon_p": (wilcoxon_p, WILCOXON_P),
    "bonferroni_flag": (
        bonferroni_flag,
        f"WITH {PAIRS}, m AS (SELECT tissue, avg(x) AS x, avg(y) AS y, least(count(x) / CAST(10000 AS DOUBLE) * 3, 1) AS p FROM pairs GROUP BY tissue) SELECT tissue, {q6('p', 'p')}, CASE WHEN p < 0.05 AND CASE WHEN tissue = 'A' THEN y > x ELSE y < x END THEN '*' ELSE '' END AS mark FROM m",
    ),
    "pred_errors": (
        pred_errors,
        f"""WITH o AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DOUBLE) END) / 1000 AS t, avg(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DOUBLE) END) / 1000 AS p FROM orders GROUP BY 1)
SELECT o_custkey % 3 AS method, count(*) AS n, {q6("sqrt(avg((p - t) * (p - t)))", "rmse")}, {q6("avg(abs(p - t))", "mae")}, {q6("stddev_samp(p - t)", "sd")}, {q6("avg(p - t)", "bias")}, {q6("corr(t, p)", "r")}, {q6("corr(t, p) * corr(t, p)", "r2")}
FROM o WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1""",
    ),
    "accuracy": (accuracy, f"WITH {SCORED} SELECT lang, count(*) AS n, {q6('avg(CAST(target = CAST(score > 1000 AS INTEGER) AS DOUBLE))', 'accuracy')} FROM scored WHERE target IS NOT NULL AND score IS NOT NULL GROUP BY lang"),
    "auc_pairs": (auc_pairs, _auc_sql(1)),
    "auc_other_class": (auc_other_class, _auc_sql(0)),
    "roc_curve": (roc_curve, f"WITH {POINTS} SELECT lang, score, {q6('fpr', 'fpr')}, {q6('tpr', 'tpr')} FROM points"),
    "roc_area": (roc_area, f"WITH {POINTS}, s AS (SELECT lang, fpr, tpr, lag(fpr) OVER w AS f, lag(tpr) OVER w AS t FROM points WINDOW w AS (PARTITION BY lang ORDER BY score DESC NULLS FIRST)) SELECT lang, {q6('sum((fpr - f) * (tpr + t) / 2)', 'auc')} FROM s GROUP BY lang"),
    "histogram15": (
        histogram15,
        f"WITH {SCORED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored) SELECT CAST(least(floor((score - lo) / ((hi - lo) / 15)), 14) + 1 AS INTEGER) AS bin, count(*) AS n FROM scored, e WHERE score IS NOT NULL GROUP BY 1",
    ),
    "boxplot_stats": (
        boxplot_stats,
        f"""WITH {TOTALS}, ranked AS (SELECT subject % 4 AS g, x AS v, row_number() OVER (PARTITION BY subject % 4 ORDER BY x) AS r, count(*) OVER (PARTITION BY subject % 4) AS n FROM totals WHERE x IS NOT NULL),
q AS (SELECT g, {_hazen_sql('g', 0.25)} AS q25, {_hazen_sql('g', 0.5)} AS q50, {_hazen_sql('g', 0.75)} AS q75 FROM ranked GROUP BY g),
b AS (SELECT ranked.*, q25, q50, q75, v >= q25 - 1.5 * (q75 - q25) AND v <= q75 + 1.5 * (q75 - q25) AS inside FROM ranked JOIN q USING (g))
SELECT g, count(*) FILTER (NOT inside) AS n_outliers, {q6("any_value(q25)", "q25")}, {q6("any_value(q50)", "q50")}, {q6("any_value(q75)", "q75")}, {q6("min(v) FILTER (inside)", "whisker_low")}, {q6("max(v) FILTER (inside)", "whisker_high")} FROM b GROUP BY g""",
    ),
    "tissue_mean": (tissue_mean, f"WITH {PAIRS} SELECT subject, {q6('avg(y)', 'mean_y')} FROM pairs GROUP BY subject"),
    "distinct_scores": (distinct_scores, f"WITH {SCORED} SELECT lang, count(DISTINCT score) AS n_scores, count(DISTINCT target) AS n_targets FROM scored GROUP BY lang"),
    "grid_best": (grid_best, f"SELECT machine, fwhm, {q6('score', 'score')} FROM (SELECT l_returnflag || l_linestatus AS machine, l_linenumber AS fwhm, sum(CAST(l_quantity AS DOUBLE)) AS score FROM lineitem GROUP BY ALL) ORDER BY score, machine || CAST(fwhm AS VARCHAR) LIMIT 1"),
    "paired_present": (paired_present, f"WITH {PAIRS} SELECT tissue, count(*) AS n FROM pairs WHERE {BOTH} GROUP BY tissue"),
}
