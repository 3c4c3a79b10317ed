"""Statistics of the minutes of an (instrument, period): of one variable, of two, of the last minutes against all, and of bucket means.

Minutes are rows (instrument, date, ts, seq, a, b). TINY keeps quotients of nothing small; a plain quotient is null where its
denominator is within TINY of 0. A statistic of fewer rows than it needs is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import clip, col, safe_div
from quantloom.operators.intraday import KEY, in_period, in_time

TINY = 1e-8
AT = F.struct


def div(a, b) -> Column:
    return safe_div(a, b, TINY)


def _last(x: str) -> Column:
    return F.max_by(x, F.when(F.col(x).isNotNull(), F.struct("ts", "seq")))


def _first(x: str) -> Column:
    return F.min_by(x, F.when(F.col(x).isNotNull(), F.struct("ts", "seq")))


def _power(x: Column, n: int) -> Column:
    return F.avg(F.pow(x, F.lit(float(n))))


def single(minutes: DataFrame, bins: int = 10) -> DataFrame:
    """Statistics of a per period. entropy: of ten bins of equal width; autocorr: of neighbouring rows, from five pairs on;
    zero_cross: share of neighbouring rows between which the sign of a changes; skew from three, kurt from four rows on."""
    a = F.col("a")
    before = F.lag("a").over(in_time())
    low, high = F.min("a").over(in_period()), F.max("a").over(in_period())
    m = minutes.select(
        *KEY, "ts", "seq", "a", F.when(a.isNotNull(), before).alias("_x0"), F.when(before.isNotNull(), a).alias("_x1"),
        (a - F.avg("a").over(in_period())).alias("_d"), F.count("a").over(in_period()).alias("_n"),
        F.when(a.isNotNull(), clip(F.floor((a - low) / (high - low + TINY) * 9.99), 0, bins - 1)).alias("_bin"),
    )
    in_bin = F.when(a.isNotNull(), F.count("a").over(Window.partitionBy(*KEY, "_bin")) / F.col("_n"))
    m = m.withColumn("_p", in_bin)  # every row of a bin has the bin's share, so the sum of p ln p over bins is a mean over rows
    n, pairs = F.count("a"), F.count("_x1")
    mean, sd = F.avg("a"), F.stddev_samp("a")
    last, first = _last("a"), _first("a")
    spread = lambda x: F.sqrt(F.var_pop(x) + TINY)
    moved = div(last - first, F.abs(first) + TINY)
    return m.groupBy(*KEY).agg(
        n.alias("n"), mean.alias("mean"), sd.alias("std"), F.percentile("a", F.lit(0.5)).alias("median"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("sum"),
        F.max("a").alias("max"), F.min("a").alias("min"), (F.max("a") - F.min("a")).alias("range"), first.alias("first"), last.alias("last"),
        div(last - mean, sd + TINY).alias("zscore"), moved.alias("momentum"), moved.alias("ret"),
        div(last - F.min("a"), F.max("a") - F.min("a") + TINY).alias("range_position"),
        F.when(n >= 3, _power(F.col("_d"), 3) / (F.pow(F.sqrt(_power(F.col("_d"), 2) + TINY), F.lit(3.0)) + TINY)).alias("skew"),
        F.when(n >= 4, _power(F.col("_d"), 4) / (F.pow(_power(F.col("_d"), 2), F.lit(2.0)) + TINY) - 3).alias("kurt"),
        F.when(pairs >= 5, F.covar_pop("_x0", "_x1") / (spread("_x0") * spread("_x1") + TINY)).alias("autocorr"),
        F.coalesce(-F.avg(F.log(F.col("_p") + TINY)), F.lit(0.0)).alias("entropy"),
        div(F.count_if(F.signum("_x0") != F.signum("_x1")), pairs).alias("zero_cross"),
    )


PAIR = ["n", "corr", "slope", "intercept", "r2", "euc_dist", "cov", "cos_sim", "wmean", "rank_corr", "beta", "residual_std", "diff_mean", "diff_std", "ratio_mean", "ratio_std"]


def pair(minutes: DataFrame, shift: int = 0, least: int = 5) -> DataFrame:
    """Statistics of a and b per period; b may be shifted by rows (a positive shift takes earlier ones). Correlations, slopes, covariance
    and distance are of rows that have both, from `least` on; ranks are ordinal, ties in time order. diff and ratio compare all of a with
    all of b."""
    moved = F.lag("b", shift) if shift >= 0 else F.lead("b", -shift)
    m = minutes.select(*KEY, "ts", "seq", "a", moved.over(in_time()).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    m = m.withColumn("x", F.when(both, F.col("a").cast("double"))).withColumn("y", F.when(both, F.col("b").cast("double")))
    place = lambda c: F.when(both, F.row_number().over(in_period().orderBy(F.asc_nulls_last(c), "ts", "seq")).cast("double"))
    mean = lambda c: F.avg(c).over(in_period())
    sd = lambda c: F.stddev_pop(c).over(in_period()) + TINY
    beta = F.covar_pop("x", "y").over(in_period()) / (F.var_pop("y").over(in_period()) + TINY)
    m = m.select(
        "*", place("x").alias("_rx"), place("y").alias("_ry"), ((F.col("x") - mean("x")) / sd("x") - (F.col("y") - mean("y")) / sd("y")).alias("_apart"),
        (F.col("x") - (beta * F.col("y") + mean("x") - beta * mean("y"))).alias("_left"),
    )
    n = F.count("x")
    ok = lambda c: F.when(n >= least, c)
    corr = lambda p, q: F.covar_pop(p, q) / (F.sqrt(F.var_pop(p) * F.var_pop(q)) + TINY)
    slope = F.covar_pop("x", "y") / (F.var_pop("y") + TINY)
    weight = F.when(F.col("y") > 0, F.col("y")).when(both, 0.0)
    return m.groupBy(*KEY).agg(
        n.alias("n"), ok(clip(corr("x", "y"), -1.0, 1.0)).alias("corr"), ok(slope).alias("slope"), ok(F.avg("x") - slope * F.avg("y")).alias("intercept"),
        ok(clip(F.pow(corr("x", "y"), F.lit(2.0)), 0.0, 1.0)).alias("r2"), ok(F.sqrt(F.avg(F.col("_apart") * F.col("_apart")))).alias("euc_dist"), ok(F.covar_pop("x", "y")).alias("cov"),
        div(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) + TINY) * F.sqrt(F.sum(F.col("y") * F.col("y")) + TINY)).alias("cos_sim"),
        div(F.sum(weight * F.col("x")), F.sum(weight)).alias("wmean"), ok(clip(corr("_rx", "_ry"), -1.0, 1.0)).alias("rank_corr"), ok(slope).alias("beta"), F.stddev_pop("_left").alias("residual_std"),
        (F.avg("a") - F.avg("b")).alias("diff_mean"), (F.stddev_pop("a") - F.stddev_pop("b")).alias("diff_std"), div(F.avg("a"), F.avg("b")).alias("ratio_mean"), div(F.stddev_pop("a"), F.stddev_pop("b")).alias("ratio_std"),
    ).select(*KEY, *PAIR)


def short_against_long(minutes: DataFrame, n: int) -> DataFrame:
    """The last n rows of a period against all of it: ratios and difference of mean and spread, and how far the last value and the
    short mean are from the long mean in its spread."""
    back = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("seq")))
    m = minutes.withColumn("_s", F.when(back <= n, F.col("a")))
    long, sd = F.avg("a"), F.stddev_samp("a")
    return m.groupBy(*KEY).agg(
        div(F.avg("_s"), long).alias("mean_ratio"), div(F.stddev_samp("_s"), sd).alias("std_ratio"), (F.avg("_s") - long).alias("mean_diff"),
        div(_last("_s") - long, sd + TINY).alias("zscore_anchor"), div(F.avg("_s") - long, sd + TINY).alias("std_normalized_diff"),
    )


def sorted_buckets(minutes: DataFrame, groups: int) -> DataFrame:
    """Mean of a (level) and b (key) and the sum of positive a (gain) of buckets of equal counts in order of b, ties in time order.
    Bucket g of G holds the ranks from floor(n g / G) up to floor(n (g + 1) / G), so with fewer rows than buckets some are empty."""
    m = minutes.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    place, n = F.row_number().over(in_period().orderBy("b", "ts", "seq")), F.count("*").over(in_period())
    m = m.withColumn("bucket", F.floor((place * groups - 1) / n).cast("int"))
    return m.groupBy(*KEY, "bucket").agg(F.avg("a").alias("level"), F.avg("b").alias("key"), F.sum(F.greatest("a", F.lit(0.0))).alias("gain"))


def clock_buckets(minutes: DataFrame, groups: int) -> DataFrame:
    """The same of buckets of equal shares of |b| in time: a row's bucket follows from the share that is reached with it."""
    reached, total = F.sum(F.abs("b")).over(in_time().rowsBetween(Window.unboundedPreceding, 0)), F.sum(F.abs("b")).over(in_period())
    at = F.when(total > TINY, F.floor(reached / (total + TINY) * groups)).otherwise(0)
    m = minutes.withColumn("bucket", F.when(F.col("b").isNotNull(), F.least(at, F.lit(groups - 1))).cast("int")).filter("bucket is not null and a is not null")
    return m.groupBy(*KEY, "bucket").agg(F.avg("a").alias("level"), F.avg("b").alias("key"), F.sum(F.greatest("a", F.lit(0.0))).alias("gain"))


BUCKETS = ["slope", "dispersion", "early_late_diff", "top_share", "corr", "beta", "skew", "path_length", "jump_ratio", "first_last_diff"]


def bucket_stats(levels: DataFrame, groups: int) -> DataFrame:
    """Of a period's bucket means: slope over the bucket's number and dispersion (from two buckets on), late less early half, the largest
    bucket's share of positive sums, correlation and slope against b, skew and share of outliers (from three on), last less first, and
    path_length, how straight the way from the first to the last bucket is: its length over the length of all steps."""
    w = Window.partitionBy(*KEY).orderBy("bucket")
    level = F.col("level")
    step = F.when(F.lag("bucket").over(w) == F.col("bucket") - 1, F.abs(level - F.lag("level").over(w)))
    mean, sd = F.avg("level").over(in_period()), F.stddev_pop("level").over(in_period())
    early = F.col("bucket") < max(1, groups // 2)
    m = levels.select(
        "*", step.alias("_step"), (level - mean).alias("_d"), (F.abs(level - mean) > sd + TINY).cast("int").alias("_jump"), F.when(early, level).alias("_early"), F.when(~early, level).alias("_late"),
        F.when(F.col("bucket") == 0, level).alias("_first"), F.when(F.col("bucket") == groups - 1, level).alias("_last"),
    )
    n, path, net = F.count("level"), F.coalesce(F.sum("_step"), F.lit(0.0)), F.max("_last") - F.max("_first")
    from_ = lambda k, c: F.when(n >= k, c)
    squares = F.var_pop("bucket") * n
    return m.groupBy(*KEY).agg(
        from_(2, F.covar_pop("level", "bucket") * n / (squares + TINY)).alias("slope"), from_(2, F.stddev_samp("level")).alias("dispersion"), (F.avg("_late") - F.avg("_early")).alias("early_late_diff"),
        F.when(F.sum("gain") > TINY, F.max("gain") / (F.sum("gain") + TINY)).alias("top_share"),
        from_(3, clip(F.covar_pop("level", "key") / (F.sqrt(F.var_pop("level") * F.var_pop("key")) + TINY), -1.0, 1.0)).alias("corr"), from_(3, F.covar_pop("level", "key") / (F.var_pop("key") + TINY)).alias("beta"),
        from_(3, _power(F.col("_d"), 3) / (F.pow(_power(F.col("_d"), 2), F.lit(1.5)) + TINY)).alias("skew"), F.when(path > TINY, F.abs(net) / (path + TINY)).alias("path_length"),
        from_(3, F.avg("_jump")).alias("jump_ratio"), net.alias("first_last_diff"),
    ).select(*KEY, *BUCKETS)


__all__ = ["bucket_stats", "clock_buckets", "col", "pair", "short_against_long", "single", "sorted_buckets"]
