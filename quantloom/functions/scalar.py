"""Null-safe scalar functions. Missing is null everywhere: NaN and infinities become null at the edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-12


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    """x, or null where it is NaN or infinite."""
    c = col(x).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_div(a, b, eps: float = EPS) -> Column:
    """a / b, null where |b| <= eps."""
    return F.when(F.abs(col(b)) > eps, F.try_divide(col(a).cast("double"), col(b).cast("double")))


def divide(a, b) -> Column:
    """a / b as floating-point numbers divide, without an error: infinite over zero, NaN where both are zero."""
    x, y = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), float("nan")).otherwise(F.signum(x) * float("inf"))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def natural_log(x) -> Column:
    """ln x without nulls of its own: minus infinity at 0, NaN below."""
    c = col(x).cast("double")
    return F.when(c == 0, -float("inf")).when(c < 0, float("nan")).otherwise(F.log(c))


def nearest(x, places: int) -> Column:
    """x rounded in binary: the nearest whole number of units, halves away from zero, over the units. F.round goes by x's decimal digits
    instead and takes, say, 0.575 up where 0.575 * 100 lies below 57.5."""
    c, unit = col(x).cast("double"), float(10**places)
    return F.when(F.abs(c) * unit < 2.0**52, F.round(c * unit, 0) / unit).otherwise(c)


def fused(a, b, c) -> Column:
    """a * b + c rounded once, not after the product and again after the sum; for values far from the bounds of doubles."""
    x, y, z = (col(e).cast("double") for e in (a, b, c))
    cut = lambda e: e * 134217729.0 - (e * 134217729.0 - e)  # noqa: E731  (the upper 26 bits)
    product, total = x * y, x * y + z
    lost = ((cut(x) * cut(y) - product) + cut(x) * (y - cut(y)) + (x - cut(x)) * cut(y)) + (x - cut(x)) * (y - cut(y))
    added = total - product
    return total + (((product - (total - added)) + (z - added)) + lost)


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """Bounds on x; null stays null."""
    c = col(x)
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def signed_power(x, p: float) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(p))


def signed_sqrt(x) -> Column:
    return F.signum(col(x)) * F.sqrt(F.abs(col(x)))


def safe_log(x) -> Column:
    """sign(x) * log(1 + |x|)."""
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))


def log_positive(x) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def arcsin(x) -> Column:
    return F.asin(clip(x, -1.0, 1.0))


def arccos(x) -> Column:
    return F.acos(clip(x, -1.0, 1.0))


def symbol(x) -> Column:
    """Upper case, trimmed, without the quote asset at its end."""
    return F.regexp_replace(F.upper(F.trim(col(x))), "USDT$", "")


def epoch_millis(x) -> Column:
    return F.timestamp_millis(col(x).cast("long"))


def normal_cdf(x) -> Column:
    """The standard normal distribution by a rational approximation (error below 1e-7)."""
    z = F.abs(col(x))
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(col(x) >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p) -> Column:
    """The inverse of the standard normal distribution by a rational approximation (error below 5e-4)."""
    q = F.least(col(p), 1 - col(p))
    t = F.sqrt(-2 * F.log(q))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(col(p) >= 0.5, z).otherwise(-z)
