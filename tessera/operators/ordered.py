"""Running totals and exact selection of groups of any size, on as many tasks as there are.

A window orders its group in one task, so a group of most of the rows would be one task's
work. *Running totals* part the order into ranges by approximate quantiles of all rows: each
range of each group has its own running totals, and the totals of the ranges before it, a row
a range, are added. *Selection* counts a group's values in cells, keeps the cells that the
wanted places fall in, and cuts these again until what is left of a group is at most
``WHOLE`` values or one value over and over; only that is ordered. Cells are of equal width,
or, where the values left differ by more than a millionth of their size, of equal width in
the signed logarithm: seven rounds of 1,024 cells part any two doubles. Both are exact,
whatever the quantiles or the spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.runtime import Scratch, shuffle_partitions

#: Values of a group that one task orders, and cells that a round counts.
WHOLE, CELLS = 1 << 20, 1024


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """By keys of which a missing one is a key, too; the right's keys go."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row of the whole table's
    own = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(own[f"_r_{k}"]) for k in keys]
    return left.join(own, on, how).drop(*(f"_r_{k}" for k in keys))


def range_bounds(df: DataFrame, value: str, parts: int) -> list[float]:
    """About equal ranges of a column, by their inner bounds: at most ``parts`` - 1 numbers."""
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10 * parts)).first()[0]
    return sorted({x for x in found or () if x == x})


def range_number(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds lie below a value, by halving; those equal to one stay with it."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value.cast("double") <= float(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def running_totals(rows: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], bounds: Sequence[float], descending: bool = False) -> DataFrame:
    """Add, under the names in ``sums``, each column's total over the group's rows up to and
    with this one. ``order`` must be different within a group: count equal values first."""
    number = range_number(F.col(order), bounds)
    placed = rows.withColumn("_range", -number if descending else number)
    within = Window.partitionBy(*by, "_range").orderBy(F.col(order).desc() if descending else F.col(order))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    offsets = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))
    local = placed.select("*", *(F.sum(c).over(within).alias(f"_own_{n}") for n, c in sums.items()))
    met = joined(local, offsets, [*by, "_range"])
    return met.withColumns({n: F.col(f"_own_{n}") + F.col(f"_off_{n}") for n in sums}).drop("_range", *(f"_own_{n}" for n in sums), *(f"_off_{n}" for n in sums))


def default_parts(df: DataFrame) -> int:
    return min(512, max(8, shuffle_partitions(df.sparkSession)))


def _wanted(shares: Sequence[float], n: Column) -> list[tuple[Column, Column, Column]]:
    """For each share the places (1-based) of two neighbours, and how far between them it is."""
    out = []
    for p in shares:
        h = F.least(F.greatest(F.lit(float(p)) * n + 0.5, F.lit(1.0)), n.cast("double"))
        low = F.floor(h)
        out.append((low, F.least(low + 1, n), h - low))
    return out


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """The cell of a value between two ends, by a scale that never falls."""
    scale = lambda x: F.signum(x) * F.when(x == 0, 0.0).otherwise(F.log2(F.abs(x)) + 1100.0)  # noqa: E731  logarithms of doubles end at -1074
    wide = scale(high) - scale(low)
    even = (v / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))  # halves: the widest range is no double
    share = F.when(wide > 1e-6, (scale(v) - scale(low)) / F.nullif(wide, F.lit(0.0))).otherwise(even)
    # Ends as close as the smallest double have no half between them: each is a cell.
    return F.coalesce(F.least(F.floor(share * cells), F.lit(cells - 1)), F.when(v > low, F.lit(cells - 1)).otherwise(F.lit(0)))


def selected(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], whole: int = WHOLE, cells: int = CELLS) -> DataFrame:
    """Percentiles that interpolate at n * p + 0.5, cut to the first and last value, of each
    group's values that are there."""
    scratch = Scratch(df.sparkSession, "selection")
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    open_ = scratch.save(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(*by, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held")), "groups")
    small = lambda df: df.where((F.col("_held") <= whole) | (F.col("_lo") == F.col("_hi")))
    done, n = small(open_), 0
    while True:
        left = open_.where((F.col("_held") > whole) & (F.col("_lo") < F.col("_hi")))
        if left.isEmpty():
            break
        n += 1
        inside = joined(rows, left, by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        cell = _cell(F.col("_v"), F.col("_lo"), F.col("_hi"), cells)
        counts = inside.groupBy(*by, "_n", "_below", F.col("_lo").alias("_from"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        last = F.col("_below") + F.sum("_held").over(Window.partitionBy(*by, "_from").orderBy("_cell"))
        placed = counts.withColumn("_last", last)
        holds = F.lit(False)
        for low, high, _ in _wanted(shares, F.col("_n")):
            for place in (low, high):
                holds = holds | ((place <= F.col("_last")) & (place > F.col("_last") - F.col("_held")))
        cut = placed.where(holds).select(*by, "_n", "_lo", "_hi", (F.col("_last") - F.col("_held")).alias("_below"), "_held")
        open_ = scratch.save(cut, f"round-{n}")
        done = done.unionByName(small(open_))
    inside = joined(rows, done, by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    counts = inside.groupBy(*by, "_n", "_below", "_lo", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = counts.withColumn("_last", F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "_lo").orderBy("_v")))
    out = []
    for (low, high, between), name in zip(_wanted(shares, F.col("_n")), names, strict=True):
        holds = lambda place: (place <= F.col("_last")) & (place > F.col("_last") - F.col("_c"))
        out.append((F.sum(F.when(holds(low), F.col("_v") * (1 - between))) + F.sum(F.when(holds(high), F.col("_v") * between))).alias(name))
    return placed.groupBy(*by).agg(*out)
