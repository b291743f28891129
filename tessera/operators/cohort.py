"""Cohort operators: which subjects take part, which source they use, who comes first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exclude(subjects: DataFrame, excluded: DataFrame, key: str = "subject") -> DataFrame:
    """Subjects that are not on the list. Spark broadcasts the list while it is small."""
    return subjects.join(excluded.select(key), key, "left_anti")


def only(subjects: DataFrame, chosen: DataFrame, key: str = "subject", required: bool = True) -> DataFrame:
    """Subjects on the list; an error if none is, unless not required."""
    found = subjects.join(chosen.select(key), key, "left_semi")
    if required and found.isEmpty():
        raise ValueError("none of the chosen subjects exists")
    return found


def first_n(subjects: DataFrame, n: int, key: str = "subject") -> DataFrame:
    return subjects.orderBy(key).limit(n)


def complete_cases(rows: DataFrame, methods: Sequence[str], key: str = "subject", method: str = "method", good: Column | None = None) -> DataFrame:
    """Subjects that have all methods (in rows that are ``good``), in one aggregation."""
    use = rows.where(F.col(method).isin(*methods)) if good is None else rows.where(F.col(method).isin(*methods) & good)
    return use.groupBy(key).agg(F.countDistinct(method).alias("_n")).where(F.col("_n") == len(methods)).select(key)


def complete_nonzero(rows: DataFrame, cells: int, key: str = "subject", by: Sequence[str] = ("method", "tissue"), value: str = "value") -> DataFrame:
    """Subjects with a sum above 0 in each of so many method x tissue cells."""
    sums = rows.groupBy(key, *by).agg(F.sum(value).alias("_s"))
    return sums.groupBy(key).agg(F.count(F.when(F.col("_s") > 0, 1)).alias("_n")).where(F.col("_n") == cells).select(key)


def first_match(rows: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first by the order. Lookups use it so that they can't fan out."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def lookup(rows: DataFrame, table: DataFrame, key: str, order: Sequence[Column | str], how: str = "left") -> DataFrame:
    return rows.join(first_match(table, key, order), key, how)


def fallback(preferred: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each key of either table the preferred table's row if it is there, else the other's."""
    ranked = preferred.select(key, *columns, F.lit(0).alias("_rank")).unionByName(other.select(key, *columns, F.lit(1).alias("_rank")))
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*columns), "_rank").alias("_row"), F.min("_rank").alias("source"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in columns), "source")


def best_of(rows: DataFrame, value: str, tie: str, by: Sequence[str] = (), highest: bool = True) -> DataFrame:
    """The row of the best value for each group; of equal ones the first by ``tie``."""
    value_order = F.col(value).desc_nulls_last() if highest else F.col(value).asc_nulls_last()
    if not by:
        return rows.orderBy(value_order, tie).limit(1)
    w = Window.partitionBy(*by).orderBy(value_order, tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def median_row(rows: DataFrame, value: str, tie: str, by: Sequence[str]) -> DataFrame:
    """For each group the row whose value stands at place round(n / 2) of the sorted ones."""
    w = Window.partitionBy(*by)
    held = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count(F.lit(1)).over(w))
    return held.where(F.col("_r") == F.greatest(F.round(F.col("_n") / 2), F.lit(1))).drop("_r", "_n")


def worst_first(scores: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of each key's values, lowest first, keys without one last."""
    return scores.groupBy(key).agg(F.avg(value).alias("mean_value")).orderBy(F.col("mean_value").asc_nulls_last(), key)


def configurations(spark, axes: dict[str, Sequence], only_for: dict[str, tuple[str, Sequence]] | None = None) -> DataFrame:
    """All combinations of a few settings. An axis in ``only_for`` varies only where another
    setting has one of the given values, and is missing elsewhere."""
    grid = spark.range(1).select()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    for name, (other, where) in (only_for or {}).items():
        grid = grid.withColumn(name, F.when(F.col(other).isin(*where), F.col(name))).distinct()
    return grid


def configurations_of(rows: DataFrame, axes: dict[str, Column], only_for: dict[str, tuple[str, Sequence]] | None = None, most: int = 1000) -> DataFrame:
    """As ``configurations``, of the values that a table's rows have on each axis. A table of
    more than ``most`` values on an axis holds no settings, and is an error."""
    sets = rows.agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in axes.items()))
    fits = F.lit(True)
    for n in axes:
        fits = fits & (F.size(n) <= most)
    grid = sets.select("*", F.assert_true(fits, F.lit(f"an axis has more than {most} values")).alias("_ok"))
    for n in axes:
        grid = grid.withColumn(n, F.explode(n))
    for name, (other, where) in (only_for or {}).items():
        grid = grid.withColumn(name, F.when(F.col(other).isin(*where), F.col(name)))
    return grid.where("_ok IS NULL").select(*axes).distinct()


def requested(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the requested (class, space) outputs."""
    return rows.join(wanted.select("class", "space"), ["class", "space"], "left_semi")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """What has not been done, by the key of subject, step and input; all of it if forced."""
    return work if force else work.join(done.select(*keys), list(keys), "left_anti")
