"""Evaluation of factors and return series: information coefficients, groups, coverage, returns and quality of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.sources.tables import staged

PERIODS = 365


def pearson(x, y) -> Column:
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def with_ranks(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Average ranks r_<col> within `by`."""
    for c in cols:
        w = Window.partitionBy(*by)
        df = df.withColumn(f"r_{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2)
    return df


def daily_ic(panel: DataFrame, x: str = "x", label: str = "label", least: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Per date: pairs, Pearson and Spearman of factor and label; null with fewer than `least` pairs or a constant side."""
    p = with_ranks(panel.filter(F.col(x).isNotNull() & F.col(label).isNotNull()), [*by, "date"], [x, label])
    ok = (F.count("*") >= least) & (F.min(x) < F.max(x)) & (F.min(label) < F.max(label))
    return p.groupBy(*by, "date").agg(F.count("*").alias("n"), F.when(ok, pearson(x, label)).alias("ic"), F.when(ok, pearson(f"r_{x}", f"r_{label}")).alias("rank_ic"))


def ic_summary(ic: DataFrame, col: str = "rank_ic", by: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, ratio, yearly ratio, t statistic and share above zero."""
    m, s, n = F.avg(col), F.stddev_samp(col), F.count(col)
    return ic.groupBy(*by).agg(
        n.alias("n"), m.alias("mean"), s.alias("sd"), F.try_divide(m, s).alias("ir"), (F.try_divide(m, s) * F.sqrt(F.lit(float(PERIODS)))).alias("ir_year"),
        F.try_divide(m, s / F.sqrt(n)).alias("t"), F.avg((F.col(col) > 0).cast("int")).alias("positive"),
    )


#: Ranges of values that pooled ranks are counted in, and tasks that the ranges of all horizons are dealt to.
RANGES, TASKS = 64, 256


def _range_of(x, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts are at most x, by halves."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(x) < F.lit(cuts[mid]), within(low, mid)).otherwise(within(mid + 1, high))

    return within(0, len(cuts))


def ic_decay(panel: DataFrame, x: str, value: str, horizons: Sequence[int], key: str = "day") -> DataFrame:
    """Pooled Spearman of x on a day with `value` h days on, for each h; a panel has one row per instrument and day. Pooled ranks are places
    in a range of values, plus the rows in the ranges below: ranges are sorted apart, and sums per pair of ranges make the correlation. A
    value that very many rows share is one range."""
    at = [k / RANGES for k in range(1, RANGES)]
    p = staged(panel.select("instrument", F.col(key).alias("_t"), F.col(x).cast("double").alias("x"), F.col(value).cast("double").alias("label")), "panel")
    ends = p.agg(F.percentile_approx("x", at, 1000), F.percentile_approx("label", at, 1000)).first()
    cuts = [sorted(set(e or [])) for e in ends]
    on = Window.partitionBy("instrument").orderBy("_t")
    later = F.array(*[F.struct(F.lit(h).alias("h"), F.max("label").over(on.rangeBetween(h, h)).alias("label")) for h in horizons])
    pairs = p.select("x", later.alias("_later")).filter("x is not null").select("x", F.explode("_later").alias("_l")).select("_l.h", "x", "_l.label").filter("label is not null")
    pairs = pairs.withColumn("_x", _range_of("x", cuts[0])).withColumn("_label", _range_of("label", cuts[1]))
    for c in ("x", "label"):
        pairs = with_ranks(pairs.repartition(TASKS, "h", f"_{c}"), ["h", f"_{c}"], [c])
    a, b = F.col("r_x"), F.col("r_label")
    g = pairs.groupBy("h", "_x", "_label").agg(
        F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"), *[f(c).alias(f"{k}_{c}") for c in ("x", "label") for k, f in (("min", F.min), ("max", F.max))]
    )  # at most a row per horizon and pair of ranges
    below = lambda c: F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy(c).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) - (F.sum("n").over(Window.partitionBy("h")) + 1) / 2
    g = g.withColumn("i", below("_x")).withColumn("j", below("_label"))  # from the mean rank
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    square = lambda k, s, ss: F.sum(n * k * k + 2 * k * F.col(s) + F.col(ss))
    moves = (F.min("min_x") < F.max("max_x")) & (F.min("min_label") < F.max("max_label"))
    corr = F.sum(n * i * j + i * F.col("b") + j * F.col("a") + F.col("ab")) / F.sqrt(square(i, "a", "aa")) / F.sqrt(square(j, "b", "bb"))
    return g.groupBy("h").agg(F.sum("n").alias("n"), F.when(moves, corr).alias("rank_ic"))


def autocorrelation(series: DataFrame, value: str, lags: Sequence[int], key: str = "day") -> DataFrame:
    """Correlation of a series with itself some days on, on days that have both."""
    a = series.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), F.col(key).alias("_t"), F.col(value).alias("a"))
    b = series.select(F.col(key).alias("_u"), F.col(value).alias("b"))
    j = a.withColumn("_u", F.col("_t") + F.col("lag")).join(b, "_u").filter("a is not null and b is not null")
    return j.groupBy("lag").agg(F.count("*").alias("n"), pearson("a", "b").alias("autocorrelation"))


def half_life(decay: DataFrame) -> DataFrame:
    """First horizon at which |ic| is at most half of its size at the first."""
    first = F.min_by("rank_ic", "h").over(Window.partitionBy())
    return decay.withColumn("_1", first).filter(F.abs("rank_ic") <= 0.5 * F.abs("_1")).agg(F.min("h").alias("half_life"))


def label_coverage(panel: DataFrame, x: str = "x", label: str = "label") -> DataFrame:
    per = panel.groupBy("date").agg(F.count(x).alias("v"), F.count(F.when(F.col(x).isNotNull(), F.col(label))).alias("l")).filter("v > 0")
    return per.agg(F.avg(F.col("l") / F.col("v")).alias("coverage"), F.count("*").alias("n_days"))


def return_summary(returns: DataFrame, by: Sequence[str] = (), r: str = "ret", periods: int = PERIODS, order: str = "date") -> DataFrame:
    """Total and yearly return, volatility, Sharpe, drawdown from a wealth of 1, win rate and profit / loss ratio."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = returns.withColumn("_nav", F.exp(F.sum(F.log1p(r)).over(w))).withColumn("_peak", F.greatest(F.max("_nav").over(w), F.lit(1.0)))
    total, n, sd = F.exp(F.sum(F.log1p(r))), F.count(r), F.stddev_samp(r)
    gain, loss = F.avg(F.when(F.col(r) > 0, F.col(r))), -F.avg(F.when(F.col(r) < 0, F.col(r)))
    return s.groupBy(*by).agg(
        n.alias("n"), (total - 1).alias("total_return"), (F.pow(total, periods / n) - 1).alias("annual_return"), (sd * F.sqrt(F.lit(float(periods)))).alias("volatility"),
        F.when(sd > 1e-12, F.avg(r) / sd * F.sqrt(F.lit(float(periods)))).alias("sharpe"), F.min(F.col("_nav") / F.col("_peak") - 1).alias("max_drawdown"),
        F.avg((F.col(r) > 0).cast("int")).alias("win_rate"), F.try_divide(gain, loss).alias("profit_loss"),
    )


def quarterly(returns: DataFrame, r: str = "ret") -> DataFrame:
    """Each quarter's compounded return, start and end wealth, and whether they agree."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date of one series
    s = returns.withColumn("_nav", F.exp(F.sum(F.log1p(r)).over(w))).withColumn("quarter", F.to_date(F.date_trunc("quarter", "date")))
    q = s.groupBy("quarter").agg(F.count("*").alias("n_days"), (F.exp(F.sum(F.log1p(r))) - 1).alias("quarter_return"), F.max_by("_nav", "date").alias("end_wealth"))
    start = F.coalesce(F.lag("end_wealth").over(Window.orderBy("quarter")), F.lit(1.0))
    q = q.withColumn("start_wealth", start)
    return q.withColumn("reconciles", F.abs(F.col("end_wealth") / F.col("start_wealth") - 1 - F.col("quarter_return")) < 1e-9)


def moments(returns: DataFrame, r: str = "ret", by: Sequence[str] = ()) -> DataFrame:
    """Daily Sharpe, bias-corrected skewness and Pearson kurtosis; null for fewer than four or constant values."""
    n = F.count(r).cast("double")
    ok = (F.count(r) >= 4) & (F.stddev_samp(r) > 1e-12)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6) + 3
    return returns.groupBy(*by).agg(
        F.count(r).alias("n"), F.when(ok, F.avg(r) / F.stddev_samp(r)).alias("sharpe"), F.when(ok, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(ok, kurt).alias("kurtosis")
    )


def group_returns(grouped: DataFrame, group: str = "grp", label: str = "label") -> DataFrame:
    return grouped.filter(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy("date", group).agg(F.count("*").alias("n"), F.avg(label).alias("mean_return"))


def funding_daily(events: DataFrame) -> DataFrame:
    """Per instrument and day: sum, mean, count and last rate; null where a rate of the day is invalid."""
    bad = F.col("rate").isNull() | F.isnan("rate")
    any_bad = F.bool_or(bad)
    return events.groupBy("instrument", "date").agg(
        F.when(~any_bad, F.sum("rate")).alias("rate_sum"), F.when(~any_bad, F.avg("rate")).alias("rate_mean"), F.when(~any_bad, F.max_by("rate", F.struct("ts", "event_id"))).alias("rate_last"),
        F.count("*").alias("event_count"), F.count_if(F.col("rate") <= 0.005).alias("invalid_price_count"),
    )


def cadence(events: DataFrame, low: int = 3, high: int = 24) -> DataFrame:
    """Per instrument: the most frequent daily event count within bounds (ties: the one seen first) and on how many days."""
    per = events.groupBy("instrument", "date").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))
    c = per.groupBy("instrument", "n").agg(F.count("*").alias("days"), F.min("date").alias("first_seen"))
    best = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("days"), "first_seen", "n"))
    return c.withColumn("_b", best).filter("_b = 1").select("instrument", F.col("n").alias("daily_count"), "days", "first_seen")


def top_n_by_date(panel: DataFrame, value: str, n: int) -> DataFrame:
    """The n largest positive values of each date, ties to the smaller instrument."""
    w = Window.partitionBy("date").orderBy(F.desc(value), "instrument")
    return panel.filter(F.col(value) > 0).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def islands(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive days: first, last, length. days: (by..., day), no repeats."""
    start = F.col("day") - F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    return days.withColumn("_i", start).groupBy(*by, "_i").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("_i")


def longest_prefix(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The run that starts at the first day."""
    runs = islands(days, by)
    first = F.min("first_day").over(Window.partitionBy(*by))
    return runs.withColumn("_f", first).filter("first_day = _f").drop("_f")


def checks_bars(bars: DataFrame) -> DataFrame:
    """code, level, n: what is wrong with a bar table, one row per check."""
    c = [
        ("negative_volume", "error", F.count_if(F.col("volume") < 0)),
        ("high_below_low", "error", F.count_if(F.col("high") < F.col("low"))),
        ("close_outside_range", "error", F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low")))),
        ("placeholder", "warning", F.count_if((F.col("volume") == 0) & (F.col("open") == F.col("close")) & (F.col("high") == F.col("low")))),
        ("flat_bar", "warning", F.count_if(F.col("high") == F.col("low"))),
        ("missing_rate", "warning", F.count_if(F.col("rate").isNull())),
    ]
    one = bars.agg(*[e.alias(k) for k, _, e in c])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.lit(lv).alias("level"), F.col(k).alias("n")) for k, lv, _ in c])).alias("r")).select("r.*")
    keys = bars.groupBy("instrument", "date").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_key").alias("code"), F.lit("error").alias("level"), "n")
    return rows.unionByName(keys)


def overlapping(intervals: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of the instrument has ended."""
    w = Window.partitionBy("instrument").orderBy("effective_date").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("effective_end_date", F.to_date(F.lit("9999-12-31")))
    return intervals.withColumn("_before", F.max(end).over(w)).filter("_before >= effective_date").drop("_before")


def missing_reasons(panel: DataFrame, x: str, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Missing cells by the first reason that fits, in the order given."""
    why = F.when(reasons[0][1], reasons[0][0])
    for name, c in reasons[1:]:
        why = why.when(c, name)
    return panel.filter(F.col(x).isNull()).groupBy(why.otherwise("other").alias("reason")).agg(F.count("*").alias("n"))


def overlap_of_tails(panel: DataFrame, a: str, b: str, share: float = 0.2) -> DataFrame:
    """Per date, how much the top shares of two factors overlap (by the smaller count)."""
    top = lambda c: F.percent_rank().over(Window.partitionBy("date").orderBy(c)) >= 1 - share
    p = panel.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_a", top(a)).withColumn("_b", top(b))
    n = lambda c: F.count_if(c)
    return p.groupBy("date").agg(n(F.col("_a")).alias("n_a"), n(F.col("_b")).alias("n_b"), F.try_divide(n(F.col("_a") & F.col("_b")), F.least(n(F.col("_a")), n(F.col("_b")))).alias("overlap"))


def candidate_order(scores: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """Percentiles (rank - 0.5) / n of each metric, weighted, in order; ties to the smaller key."""
    n = F.count("*").over(Window.partitionBy())
    total = F.lit(0.0)
    for m, w in weights.items():
        avg = F.rank().over(Window.orderBy(m)) + (F.count("*").over(Window.partitionBy(m)) - 1) / 2
        total = total + w * (avg - 0.5) / n
    return scores.withColumn("score", total).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that tells tables apart whatever their row order."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("content"))


def pareto_front(df: DataFrame, key: str, objectives: Sequence[str]) -> DataFrame:
    """Rows that no other row beats or equals in all objectives while beating it in one. With two objectives: walk down the
    first and keep what exceeds the best second so far (values are compared, not pairs of rows)."""
    a, b = objectives
    per = df.groupBy(a).agg(F.max(b).alias("_best"))
    before = F.max("_best").over(Window.orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1))
    front = per.withColumn("_before", before).filter((F.col("_before").isNull()) | (F.col("_best") > F.col("_before")))
    return df.join(front.select(a, F.col("_best").alias(b)), [a, b], "left_semi")
