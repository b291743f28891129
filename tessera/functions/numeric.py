"""Scalar and array expressions with the engine's numeric semantics.

Missing is NULL, never NaN: NaN compares as larger than everything in SQL, so every source
goes through ``not_nan`` once and later operators need not think of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE_EPS = 1.1920928955078125e-07  # machine epsilon of 32-bit floats
DOUBLE_EPS = 2.220446049250313e-16


def not_nan(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def finite_or(x: Column, other: float = 0.0) -> Column:
    """Values that are missing or infinite replaced."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x).otherwise(F.lit(other))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` limited to [low, high]; NULL stays NULL."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.least(as_col(high), F.greatest(as_col(low), x)))


def window_level(x: Column, low: float, high: float) -> Column:
    """Intensities mapped so that [low, high] becomes [0, 1], cut at both."""
    return clamp((x - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def between_open(x: Column, low: float, high: float) -> Column:
    """low < x < high, both ends open; NULL is not in the range."""
    return F.coalesce((x > low) & (x < high), F.lit(False))


def normal_pdf(x: Column, mean: Column | float, sd: Column | float) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def array_sum(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def renormalise(p: Column, eps: float = SINGLE_EPS) -> Column:
    """Class responsibilities divided by their sum, which ``eps`` keeps from being 0."""
    total = array_sum(p) + eps
    return F.transform(p, lambda x: x / total)


def softmax_background(logp: Column) -> Column:
    """Probabilities of K - 1 log-channels and of a last class whose log is 0, stable for
    large logs: everything is shifted by the largest channel."""
    top = F.array_max(logp)
    e = F.transform(logp, lambda x: F.exp(x - top))
    total = array_sum(e) + F.exp(-top)
    return F.concat(F.transform(e, lambda x: x / total), F.array(F.exp(-top) / total))


def softmax_plain(logp: Column) -> Column:
    """As ``softmax_background`` without the shift: exp(x) / (1 + sum exp)."""
    total = array_sum(F.transform(logp, F.exp)) + 1.0
    return F.concat(F.transform(logp, lambda x: F.exp(x) / total), F.array(1.0 / total))


def implicit_background(p: Column) -> Column:
    """What the classes leave of 1, at least 0."""
    return F.greatest(1.0 - array_sum(p), F.lit(0.0))


def channels(p: Column, order: Sequence[int]) -> Column:
    """Channels chosen, repeated or reordered by their 1-based numbers."""
    return F.array(*(F.element_at(p, i) for i in order))


def eight_classes(classes: int) -> int:
    """Classes after grey and white matter are split by side; only six can be."""
    if classes != 6:
        raise ValueError(f"hemispheres need an atlas of 6 classes, not {classes}")
    return classes + 2


def hemisphere_split(p: Column, i: Column, nx: Column, lowest: Column) -> Column:
    """The first two channels twice, once for each side; a side's channel has the lowest
    value on the other side. With an even ``nx`` the plane nx / 2 is blank on both sides,
    with an odd one the middle plane stays with the far side only."""
    near, far = F.floor(nx / 2), F.ceil(nx / 2)
    both = channels(p, (1, 1, 2, 2, *range(3, 6)))
    blank = lambda x, n: F.when((n.isin(0, 2) & (i <= near)) | (n.isin(1, 3) & (i >= far)), lowest).otherwise(x)
    return F.transform(both, blank)


def mid_rank(value: Column, by: Sequence[str] = ()) -> Column:
    """Average rank (ties share theirs) within groups."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def format_interval(mid: Column, low: Column, high: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", mid, low, high)


def format_p(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


HU_OFFSET = 1024.0


def prior_mean_hu(m: Column) -> Column:
    """A prior's mean on the scanner's scale."""
    return m - HU_OFFSET


def prior_sd(n: Column, w: Column) -> Column:
    """Standard deviation that degrees of freedom and a scale imply; NULL where they are 0."""
    return F.sqrt(F.abs(F.try_divide(F.lit(1.0), n * w)))
