"""Agreement and prediction statistics over paired measurements, one row a group.

Pairs with a missing side are dropped first. A group with too few pairs gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import f_quantile_udf, signed_rank_p_udf
from tessera.operators.ordered import default_parts, joined, range_bounds, running_totals, selected


def paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sd (0 for a single value), median, min and max."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("sd"),
        F.median(v).alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def hazen(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Percentiles that interpolate at n * p + 0.5, cut to the first and last value. Of a
    large group only the values around the wanted places are ordered."""
    return selected(df, by, value, shares, names)


def box_plot(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 times the quartiles' distance)
    and how many values lie beyond."""
    q = hazen(df, by, value, (0.25, 0.5, 0.75), ("q25", "q50", "q75"))
    joined = df.where(F.col(value).isNotNull()).join(q, list(by))
    low, high = F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))
    v = F.col(value)
    inside = (v >= low) & (v <= high)
    return joined.groupBy(*by, "q25", "q50", "q75").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("n_outliers")
    )


def bland_altman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    d = F.col(y) - F.col(x)
    found = paired(df, x, y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("_sd"))
    return found.select(*by, "n", "bias", (F.col("bias") - 1.96 * F.col("_sd")).alias("lower"), (F.col("bias") + 1.96 * F.col("_sd")).alias("upper"))


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return paired(df, x, y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))


def icc(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Intraclass correlation (3, 1) of two methods: 2 cov / (var + var), n - 1 in each."""
    both = F.var_samp(x) + F.var_samp(y)
    return paired(df, x, y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(2 * F.covar_samp(x, y), F.when(both != 0, both)).alias("icc"))


def icc_interval(df: DataFrame, by: Sequence[str], x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """The same with its confidence interval from the F distribution."""
    found = icc(df, by, x, y).withColumn("_f", F.try_divide(1 + F.col("icc"), F.when(F.col("icc") != 1, 1 - F.col("icc"))))
    q = f_quantile_udf()(F.lit(1 - alpha / 2), F.col("n").cast("double") - 1, F.col("n").cast("double") - 1)
    found = found.withColumn("_q", q)
    low, high = F.try_divide(F.col("_f"), F.col("_q")), F.col("_f") * F.col("_q")
    return found.select(*by, "n", "icc", ((low - 1) / (low + 1)).alias("lower"), ((high - 1) / (high + 1)).alias("upper"))


def signed_rank(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Wilcoxon's signed-rank statistic: differences of 0 dropped, mid-ranks of the sizes,
    sums of the ranks of positive and negative differences. Equal sizes are counted first, and
    ranks come from running totals of the counts."""
    d = paired(df, x, y).select(*by, (F.col(x) - F.col(y)).cast("double").alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    up = (F.col("_d") > 0).cast("long")
    counts = d.groupBy(*by, "_a").agg(F.sum(up).alias("_up"), F.sum(1 - up).alias("_down"), F.count(F.lit(1)).alias("_t"))
    ranked = running_totals(counts, by, "_a", {"_last": "_t"}, range_bounds(d, "_a", default_parts(df))).withColumn("_r", F.col("_last") - (F.col("_t") - 1) / 2.0)
    t = F.col("_t").cast("double")
    return ranked.groupBy(*by).agg(F.sum("_t").alias("n"), F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum(F.col("_down") * F.col("_r")).alias("w_minus"), F.sum(t * (t * t - 1)).alias("ties"))


def signed_rank_test(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return signed_rank(df, by, x, y).withColumn("p", signed_rank_p_udf()(F.col("w_plus"), F.col("n"), F.col("ties")))


def bonferroni(p, m: int):
    return F.least(p * m, F.lit(1.0))


def better_flag(metric, p, x, y, alpha: float = 0.05):
    """'*' where p is below alpha and y is better: higher for dice, lower for distances."""
    return F.when((p < alpha) & F.when(metric == "dice", y > x).otherwise(y < x), F.lit("*")).otherwise(F.lit(""))


def prediction_errors(df: DataFrame, by: Sequence[str], true: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(true)
    return paired(df, true, predicted).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.stddev_samp(e).alias("sd"),
        F.avg(e).alias("bias"),
        F.corr(true, predicted).alias("r"),
        F.pow(F.corr(true, predicted), F.lit(2.0)).alias("r2"),
    )


def accuracy(df: DataFrame, by: Sequence[str], true: str, predicted: str) -> DataFrame:
    return paired(df, true, predicted).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))


def _by_score(df: DataFrame, by: Sequence[str], target: str, score: str, positive: int, descending: bool) -> DataFrame:
    """A row a distinct score with its positives ``_p`` and negatives ``_n``, and these with
    all before it, ``_cp`` and ``_cn``."""
    held = paired(df, target, score)
    is_pos = (F.col(target) == positive).cast("long")
    counts = held.groupBy(*by, F.col(score).alias("score")).agg(F.sum(is_pos).alias("_p"), F.sum(1 - is_pos).alias("_n"))
    return running_totals(counts, by, "score", {"_cp": "_p", "_cn": "_n"}, range_bounds(held, score, default_parts(df)), descending)


def auc_by_ranks(df: DataFrame, by: Sequence[str], target: str, score: str, positive: int = 1) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties one half, from rank sums.

    Scores are counted by value first: what is ordered has a row for each distinct score, in
    ranges. NULL with one class only.
    """
    won = F.col("_p") * (F.col("_cn") - F.col("_n") + F.col("_n") / 2.0)
    found = _by_score(df, by, target, score, positive, False).groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum(won).alias("_won"))
    return found.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_won"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def _class_sizes(df: DataFrame, by: Sequence[str], target: str, score: str, positive: int) -> DataFrame:
    is_pos = (F.col(target) == positive).cast("long")
    return paired(df, target, score).groupBy(*by).agg(F.sum(is_pos).alias("_all_p"), F.sum(1 - is_pos).alias("_all_n"))


def roc_curve(df: DataFrame, by: Sequence[str], target: str, score: str, positive: int = 1) -> DataFrame:
    """A point for each distinct score, highest first, and the origin (score NULL)."""
    sizes = _class_sizes(df, by, target, score, positive)
    met = joined(_by_score(df, by, target, score, positive, True), sizes, by)
    share = lambda c, n: F.try_divide(F.col(c).cast("double"), F.col(n).cast("double"))
    points = met.select(*by, F.col("score").cast("double").alias("score"), share("_cn", "_all_n").alias("fpr"), share("_cp", "_all_p").alias("tpr"))
    origin = sizes.where("_all_p + _all_n > 0").select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_area(df: DataFrame, by: Sequence[str], target: str, score: str, positive: int = 1) -> DataFrame:
    """Trapezoids under the curve: each score's step to the right, times its mean height."""
    step = F.col("_n") * (F.col("_cp") - F.col("_p") / 2.0)
    found = _by_score(df, by, target, score, positive, True).groupBy(*by).agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"), F.sum(step).alias("_area"))
    return found.select(*by, F.try_divide(F.col("_area"), (F.col("_all_p") * F.col("_all_n")).cast("double")).alias("auc"))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins from the smallest to the largest value; the last one is closed."""
    held = df.where(F.col(value).isNotNull())
    ends = held.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1))
    dealt = held.crossJoin(F.broadcast(ends)).withColumn("bin", (F.coalesce(at, F.lit(0)) + 1).cast("int"))  # one row of ends
    return dealt.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
