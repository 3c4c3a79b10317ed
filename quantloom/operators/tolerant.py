"""Rolling operators that take what a window has: windows of n days, values where there are any.

Each function returns a Column over the present cell's window; a null cell is no value. Rank, return and the extremes of a window say
below what few or equal values give.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from quantloom.functions.scalar import clip, col
from quantloom.operators import rolling as R

LEAST_VARIANCE = 1e-10


def _at_least(x, n: int, k: int, e: Column) -> Column:
    return F.when(F.count(col(x)).over(R.window(n)) >= k, e)


def std(x, n: int) -> Column:
    """Sample spread, from two values on."""
    return _at_least(x, n, 2, F.stddev_samp(col(x)).over(R.window(n)))


def extent(x, n: int) -> Column:
    """Largest less smallest value."""
    return F.max(col(x)).over(R.window(n)) - F.min(col(x)).over(R.window(n))


def _both(x, y) -> tuple[Column, Column]:
    return F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))


def cov(x, y, n: int) -> Column:
    a, b = _both(x, y)
    return _at_least(a, n, 2, F.covar_samp(a, b).over(R.window(n)))


def corr(x, y, n: int) -> Column:
    """Null where the sum of squares of either is not above the least variance."""
    a, b = _both(x, y)
    w, c = R.window(n), F.count(a).over(R.window(n))
    enough = (F.var_pop(a).over(w) * c > LEAST_VARIANCE) & (F.var_pop(b).over(w) * c > LEAST_VARIANCE)
    return _at_least(a, n, 2, F.when(enough, F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))))


def skew(x, n: int) -> Column:
    """Third central moment over the cube of the sample spread, from three values on."""
    w, c = R.window(n), F.count(col(x)).over(R.window(n))
    sd, pop = F.stddev_samp(col(x)).over(w), F.stddev_pop(col(x)).over(w)
    return F.when((c >= 3) & (sd > LEAST_VARIANCE), F.skewness(col(x)).over(w) * F.pow(pop / sd, F.lit(3.0)))


def kurt(x, n: int) -> Column:
    """Fourth central moment over the square of the sample variance, less 3, from four values on."""
    w, c = R.window(n), F.count(col(x)).over(R.window(n))
    var, pop = F.var_samp(col(x)).over(w), F.var_pop(col(x)).over(w)
    return F.when((c >= 4) & (var > LEAST_VARIANCE), (F.kurtosis(col(x)).over(w) + 3) * F.pow(pop / var, F.lit(2.0)) - 3)


def gaussian_rank(x, n: int) -> Column:
    """Place of the cell in its window from 1 to the number of values, by the normal distribution of its z-score (a tanh stands for it);
    1 for a lone value, and where all are equal."""
    v, w = col(x), R.window(n)
    c, sd = F.count(v).over(w), F.stddev_pop(v).over(w)
    z = (v - F.avg(v).over(w)) / F.when(sd * sd > 1e-12, sd)
    phi = clip(0.5 * (1 + F.tanh(0.7978845608028654 * (z + 0.044715 * z * z * z))), 0.0, 1.0)
    return F.when(v.isNotNull(), F.coalesce(phi * (c - 1) + 1, F.lit(1.0)))


def information_ratio(x, n: int) -> Column:
    """Mean over sample spread within 20; null below two values or without spread."""
    sd = std(x, n)
    return clip(F.avg(col(x)).over(R.window(n)) / F.when(sd > LEAST_VARIANCE, sd), -20.0, 20.0)


def change_ratio(x, n: int = 1, eps: float = 1e-3) -> Column:
    """Change over n days relative to the size of the value then, within 10; 0 where that is small or missing."""
    before = R.ref(x, n)
    return clip(F.when(F.abs(before) > eps, (col(x) - before) / (F.abs(before) + eps)).otherwise(0.0), -10.0, 10.0)


def ordinal_rank(x, tie: str = "instrument") -> Column:
    """Ordinal rank on the date over the number of values; ties by `tie`."""
    v = col(x)
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.asc_nulls_last(v), tie))
    return F.when(v.isNotNull(), place / F.count(v).over(Window.partitionBy("date")))


def scaled(x, total: float = 1.0) -> Column:
    """Values whose absolute sum on the date is `total`; as they are (times `total`) where that sum is nothing."""
    s = F.sum(F.abs(col(x))).over(Window.partitionBy("date"))
    return total * col(x) / F.when(s < 1e-10, 1.0).otherwise(s)
