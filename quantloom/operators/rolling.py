"""Rolling time-series operators over calendar windows of n days, one instrument a partition.

Every function returns a Column. A window with fewer than `least` values (the full window by default) gives null. Kernels
that need the window's order work on its array with higher-order functions, inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.scalar import EPS, col, divide, safe_div

BY, DAY = "instrument", "day"


def window(n: int, before: int = 0) -> WindowSpec:
    """The n days up to `before` days ago."""
    if n < 1:
        raise ValueError("a window has at least one day")
    return Window.partitionBy(BY).orderBy(DAY).rangeBetween(-(n - 1) - before, -before)


def past() -> WindowSpec:
    return Window.partitionBy(BY).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)


def full(x, n: int, e: Column, least: int | None = None) -> Column:
    return F.when(F.count(col(x)).over(window(n)) >= (n if least is None else least), e)


def values(x, n: int) -> Column:
    """The window's values, oldest first, without nulls."""
    return F.collect_list(col(x)).over(window(n))


def ref(x, n: int) -> Column:
    return F.max(col(x)).over(Window.partitionBy(BY).orderBy(DAY).rangeBetween(-n, -n))


def lead(x, n: int) -> Column:
    return F.max(col(x)).over(Window.partitionBy(BY).orderBy(DAY).rangeBetween(n, n))


def diff(x, n: int = 1) -> Column:
    return col(x) - ref(x, n)


def roc(x, n: int = 1) -> Column:
    return divide(x, ref(x, n)) - 1


def ts_mean(x, n: int, least: int | None = None) -> Column:
    return full(x, n, F.avg(col(x)).over(window(n)), least)


def ts_sum(x, n: int, least: int | None = None) -> Column:
    return full(x, n, F.sum(col(x)).over(window(n)), least)


def product(x, n: int, least: int | None = None) -> Column:
    return full(x, n, F.product(col(x)).over(window(n)), least)


def ts_std(x, n: int, ddof: int = 1, least: int | None = None) -> Column:
    return full(x, n, (F.stddev_samp if ddof else F.stddev_pop)(col(x)).over(window(n)), least)


def ts_var(x, n: int, least: int | None = None) -> Column:
    return full(x, n, F.var_samp(col(x)).over(window(n)), least)


def ts_max(x, n: int, least: int | None = None) -> Column:
    return full(x, n, F.max(col(x)).over(window(n)), least)


def ts_min(x, n: int, least: int | None = None) -> Column:
    return full(x, n, F.min(col(x)).over(window(n)), least)


def ts_middle(x, n: int) -> Column:
    return (ts_max(x, n) + ts_min(x, n)) / 2


def ts_mad(x, n: int) -> Column:
    """Mean absolute deviation from the window's mean."""
    mean = F.avg(col(x)).over(window(n))
    dev = F.aggregate(values(x, n), F.lit(0.0), lambda s, v: s + F.abs(v - mean))
    return full(x, n, dev / F.count(col(x)).over(window(n)))


def ts_rank(x, n: int) -> Column:
    """Average rank of the last value among the window's, as a share."""
    a, v = values(x, n), col(x)
    below = F.size(F.filter(a, lambda y: y < v))
    same = F.size(F.filter(a, lambda y: y == v))
    return full(x, n, (below + (same + 1) / 2) / F.size(a))


def _day_of(x, n: int, largest: bool) -> Column:
    at = F.struct(col(x).alias("v"), (-F.col(DAY) if largest else F.col(DAY)).alias("d"))
    return (F.max_by if largest else F.min_by)(F.col(DAY), F.when(col(x).isNotNull(), at)).over(window(n))


def ts_argmax(x, n: int) -> Column:
    """Place of the first maximum, from 1 at the oldest day."""
    return full(x, n, n - (F.col(DAY) - _day_of(x, n, True)))


def ts_argmin(x, n: int) -> Column:
    return full(x, n, n - (F.col(DAY) - _day_of(x, n, False)))


def hhvbars(x, n: int) -> Column:
    """Days since the window's first maximum."""
    return full(x, n, F.col(DAY) - _day_of(x, n, True))


def llvbars(x, n: int) -> Column:
    return full(x, n, F.col(DAY) - _day_of(x, n, False))


def count_true(c: Column, n: int) -> Column:
    return full(c, n, F.count_if(c).over(window(n)))


def every(c: Column, n: int) -> Column:
    return full(c, n, F.count_if(c).over(window(n)) == n)


def exist(c: Column, n: int) -> Column:
    return full(c, n, F.count_if(c).over(window(n)) > 0)


def barssincen(c: Column, n: int) -> Column:
    """Days since the first day of the window on which c holds."""
    return F.col(DAY) - F.min(F.when(c, F.col(DAY))).over(window(n))


def barslast(c: Column) -> Column:
    """Days since c last held."""
    return F.col(DAY) - F.max(F.when(c, F.col(DAY))).over(past())


def run_length(df: DataFrame, c: Column, out: str = "value") -> DataFrame:
    """Rows in the present run of c, 0 where it doesn't hold: a run is what lies between two breaks."""
    broke = F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    df = df.withColumn("_run", F.sum(broke).over(past()))
    in_run = Window.partitionBy(BY, "_run").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(1 - broke).over(in_run)).drop("_run")


def const(x) -> Column:
    """The instrument's last value, on all its days; looks ahead, for evaluation only."""
    return F.last(col(x), ignorenulls=True).over(Window.partitionBy(BY).orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def slope(x, n: int) -> Column:
    """Least-squares slope over a full window."""
    return full(x, n, F.regr_slope(col(x), F.col(DAY)).over(window(n)))


def angle(x, n: int) -> Column:
    return F.degrees(F.atan(slope(x, n)))


def intercept(x, n: int) -> Column:
    """Fitted value at the window's first day."""
    return ts_mean(x, n) - slope(x, n) * (n - 1) / 2


def forecast(x, n: int) -> Column:
    """Fitted value on the day after the window."""
    return ts_mean(x, n) + slope(x, n) * (n + 1) / 2


def wma(x, n: int) -> Column:
    """Mean with weights 1 to n, the last day's largest."""
    w = F.sum(col(x) * F.col(DAY)).over(window(n)) - (F.col(DAY) - n) * F.sum(col(x)).over(window(n))
    return full(x, n, w / (n * (n + 1) / 2))


def ts_zscore(x, n: int) -> Column:
    return (col(x) - ts_mean(x, n)) / (ts_std(x, n) + EPS)


def ts_skew(x, n: int, least: int | None = None) -> Column:
    """Bias-corrected skewness."""
    m = F.count(col(x)).over(window(n)).cast("double")
    return full(x, n, F.when(m > 2, F.skewness(col(x)).over(window(n)) * F.sqrt(m * (m - 1)) / (m - 2)), least)


def ts_kurt(x, n: int, least: int | None = None) -> Column:
    """Bias-corrected excess kurtosis."""
    m = F.count(col(x)).over(window(n)).cast("double")
    return full(x, n, F.when(m > 3, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * F.kurtosis(col(x)).over(window(n)) + 6)), least)


def ts_quantile(x, n: int, q: float, least: int | None = None) -> Column:
    return full(x, n, F.percentile(col(x), F.lit(q)).over(window(n)), least)


def ts_median(x, n: int, least: int | None = None) -> Column:
    return ts_quantile(x, n, 0.5, least)


def reach(keep: float) -> int:
    """Values after which a weight falling by `keep` a value is below the precision of a double."""
    return max(1, math.ceil(-40 / math.log(keep))) if 0 < keep < 1 else 1


def recent(x, ordinal: str | None, keep: float) -> Column:
    """The values so far, oldest first, without nulls: all of them, or those within reach where `ordinal` names the running
    count of x, which bounds the array whatever the length of the history."""
    w = past() if ordinal is None else Window.partitionBy(BY).orderBy(ordinal).rangeBetween(-(reach(keep) - 1), 0)
    return F.collect_list(col(x).cast("double")).over(w)


def dma(x, a: float, ordinal: str | None = None) -> Column:
    """Recursive a * x + (1 - a) * before; a null carries what was before."""
    def step(before: Column, v: Column) -> Column:
        return F.coalesce(v * a + before * (1 - a), v)

    return F.aggregate(recent(x, ordinal, 1 - a), F.lit(None).cast("double"), step)


def ema(x, n: int, ordinal: str | None = None) -> Column:
    """Recursive mean of span n."""
    return dma(x, 2 / (n + 1), ordinal)


def ewm(x, n: int, ordinal: str | None = None) -> Column:
    """Mean of all values so far with weights falling by a fixed share (finite weights, not the recursive form)."""
    keep = 1 - 2 / (n + 1)
    seen = F.count(col(x)).over(past()) if ordinal is None else F.col(ordinal)
    total = F.aggregate(recent(x, ordinal, keep), F.lit(0.0), lambda s, y: s * keep + y)
    return F.when(seen > 0, total / ((1 - F.pow(F.lit(keep), seen)) / (1 - keep)))


def running_count(x) -> Column:
    return F.count(col(x)).over(past())


def recursive(df: DataFrame, **columns: tuple[str, float]) -> DataFrame:
    """Adds recursive means, name=(column, weight), inside the JVM: running counts, then folds over bounded arrays, one mean after the
    other, so that a sort never holds more than its rows' numbers. Means that are there already stay."""
    columns = {name: c for name, c in columns.items() if name not in df.columns}
    ready = {name: x for name, (x, _) in columns.items() if x not in columns}
    df = df.select("*", *[running_count(x).alias(f"_o_{name}") for name, x in ready.items()])
    for name, (x, a) in columns.items():
        if name not in ready:  # a mean of a mean above
            df = df.select("*", running_count(x).alias(f"_o_{name}"))
        df = df.select("*", dma(x, a, f"_o_{name}").alias(name)).drop(f"_o_{name}")
    return df


def recursive_pass(df: DataFrame, **columns: tuple[str, float]) -> DataFrame:
    """The same in one pass over all rows: weight * x + (1 - weight) * before, from the first value on; a null carries what was
    before. A column may be a mean named before it. Rows are dealt by instrument and sorted by
    day, and the last means go along from row to row and from batch to batch, so the work is in proportion to the rows and a
    task holds one batch, however long a history is."""
    columns = {name: c for name, c in columns.items() if name not in df.columns}
    if not columns:
        return df
    chained = [x if x in columns else f"_x_{name}" for name, (x, _) in columns.items()]
    inputs = {f"_x_{name}": col(x).cast("double") for name, (x, _) in columns.items() if x not in columns}
    means = list(zip(columns, chained, (a for _, a in columns.values())))
    by, kept, names, needed = BY, df.columns, list(columns), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), {}
        for b in batches:
            who = b.column(by).to_pylist()
            fresh = [x != y for x, y in zip(who, [last, *who])]
            last = who[-1] if who else last
            now = {x: b.column(x).to_numpy().tolist() if b.column(x).null_count == 0 else b.column(x).to_pylist() for x in needed}
            for name, x, a in means:
                m, keep, out = state.get(name), 1 - a, []
                for new, v in zip(fresh, now[x]):
                    if new:
                        m = v
                    elif v is not None:
                        m = v if m is None else v * a + m * keep
                    out.append(m)
                now[name], state[name] = out, m
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(now[n], pa.float64()) for n in names)], names=[*kept, *names])

    shape = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in columns)])
    rows = df.select("*", *[e.alias(name) for name, e in inputs.items()]).repartition(BY).sortWithinPartitions(BY, DAY)
    return rows.mapInArrow(run, shape)


def future_return(x, n: int) -> Column:
    """Return over the next n days; looks ahead, for evaluation only."""
    return divide(lead(x, n), x) - 1


def sharpe(x, n: int) -> Column:
    return ts_mean(x, n) / (ts_std(x, n) + EPS)


def ts_cov(x, y, n: int, least: int | None = None) -> Column:
    both = F.when(col(y).isNotNull(), col(x))
    return full(both, n, F.covar_samp(col(x), col(y)).over(window(n)), least)


def ts_corr(x, y, n: int, least: int | None = None) -> Column:
    """Pearson correlation on days that have both; null where either is constant. That of two days is 1 or -1: by quotient it would be off by
    what the moments lose where steps are small beside values, and ranks would tell equal ones apart."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    w = window(n)
    together, apart = F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    value = safe_div(together, apart)
    if (n if least is None else least) <= 2:
        value = F.when((F.count(a).over(w) == 2) & (apart > EPS), F.signum(together)).otherwise(value)
    return full(a, n, value, least)


def ts_beta(y, x, n: int, least: int | None = None) -> Column:
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return full(a, n, safe_div(F.covar_samp(a, b).over(window(n)), F.var_samp(a).over(window(n))), least)


def forward_fill(x) -> Column:
    return F.last(col(x), ignorenulls=True).over(past())


def change_sums(df: DataFrame, x: str, n: int, mean: bool = False, out: str = "value") -> DataFrame:
    """Rolling sum (or mean) of |x - yesterday's x|: two stages of windows."""
    return df.withColumn("_change", F.abs(diff(x, 1))).withColumn(out, (ts_mean if mean else ts_sum)("_change", n)).drop("_change")
