"""Market regime and sizing: betas against a benchmark instrument, its trend score, exposure, hedge and core weight, funding and squeeze
gates, and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import clip, col, fused
from quantloom.operators import rolling as R

PRIOR = 1.3


def with_returns(bars: DataFrame) -> DataFrame:
    """ret: close over the close of the row before, less 1."""
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("day"))
    return bars.withColumn("ret", F.try_divide(F.col("close").cast("double"), before) - 1)


def betas(bars: DataFrame, benchmark, n: int = 60) -> DataFrame:
    """instrument, date, day and beta of every other instrument against the benchmark instrument over full windows of n days; days
    without a beta are left out. The benchmark's series, a row per day, is broadcast by its size or joined by day."""
    r = with_returns(bars).select("instrument", "date", "day", "ret")
    base = r.filter(F.col("instrument") == benchmark).select("day", F.col("ret").alias("base"))
    j = r.filter(F.col("instrument") != benchmark).join(base, "day", "left")
    w = R.window(n)
    both = F.count(F.when(F.col("base").isNotNull(), F.col("ret"))).over(w) == n
    beta = F.when(both, F.try_divide(F.covar_samp("ret", "base").over(w), F.var_samp("base").over(w)))
    return j.select("instrument", "date", "day", beta.alias("beta")).filter("beta is not null")


def portfolio_beta(holdings: DataFrame, betas: DataFrame, prior: float = PRIOR) -> DataFrame:
    """date and beta of holdings (date, instrument, weight): the weighted mean of each one's newest beta up to the date, the prior where
    there is none; the prior for holdings without weight."""
    events = holdings.select("instrument", "date", "weight", F.lit(None).cast("double").alias("beta"), F.lit(1).alias("_at")).unionByName(
        betas.select("instrument", "date", F.lit(None).cast("double").alias("weight"), "beta", F.lit(0).alias("_at"))
    )
    w = Window.partitionBy("instrument").orderBy("date", "_at").rowsBetween(Window.unboundedPreceding, 0)
    known = events.withColumn("_known", F.coalesce(F.last("beta", ignorenulls=True).over(w), F.lit(prior))).filter("_at = 1")
    total = F.sum("weight")
    return known.groupBy("date").agg(F.when(total < 1e-12, prior).otherwise(F.try_divide(F.sum(F.col("weight") * F.col("_known")), total)).alias("beta"))


def _seen(x, n: int) -> Column:
    """Rows so far with a value are n or more."""
    return F.count(col(x)).over(R.past()) >= n


def trend_score(bars: DataFrame, short: int = 50, long: int = 200, spread: int = 120, smooth: int = 5, ratio_scale: float = 0.15, z_scale: float = 2.0) -> DataFrame:
    """instrument, date, day and trend in -1..1: half the tanh of the gap between two recursive means, half that of the close's distance
    from its long mean in spreads, smoothed. Windows and means are of rows, and have a value once they are full."""
    b = bars.select("instrument", "date", "day", F.col("close").cast("double").alias("close"))
    b = R.recursive(b, _s=("close", 2 / (short + 1)), _l=("close", 2 / (long + 1)))
    order = Window.partitionBy("instrument").orderBy("day")
    rows = lambda n: order.rowsBetween(-(n - 1), 0)
    full = lambda n, e: F.when(F.count("close").over(rows(n)) >= n, e)
    ratio = F.when(_seen("close", short) & _seen("close", long), F.try_divide("_s", "_l") - 1)
    z = F.try_divide(F.col("close") - full(long, F.avg("close").over(rows(long))), full(spread, F.stddev_samp("close").over(rows(spread))))
    b = b.withColumn("_raw", 0.5 * F.tanh(ratio / ratio_scale) + 0.5 * F.tanh(z / z_scale))
    b = R.recursive(b, _t=("_raw", 2 / (smooth + 1)))
    return b.select("instrument", "date", "day", clip(F.when(_seen("_raw", smooth), F.col("_t")), -1.0, 1.0).alias("trend"))


def exposure(trend, low: float = 0.5, high: float = 1.0) -> Column:
    """Share held, from low at a trend of -1 to high at 1."""
    return low + (high - low) * (clip(trend, -1.0, 1.0) + 1) / 2


def hedge(trend, beta, low: float = 0.5, high: float = 1.0, most: float = 1.2) -> Column:
    """Hedge ratio: beta times exposure, more the lower the trend; at most `most` times the exposure, never negative."""
    held = exposure(trend, low, high)
    raw = col(beta) * held * (1 - clip(trend, -1.0, 1.0))
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), held * most))


def core_weight(trend, low: float = 0.40, high: float = 0.70) -> Column:
    """Weight of the core holding; low where the trend isn't known."""
    return clip(low + (high - low) * (F.coalesce(col(trend), F.lit(-1.0)) + 1) / 2, low, high)


def smoothed(df: DataFrame, x: str, out: str, weight: float = 0.05) -> DataFrame:
    """A recursive mean from the first value on."""
    return R.recursive(df, **{out: (x, weight)})


def funding_allowed(dates: DataFrame, events: DataFrame, days: int = 30, q: float = 0.8) -> DataFrame:
    """Per instrument with events and date: may it be held short. It may where the mean rate of the date, or else the newest before,
    is below the q quantile of the rates after the start of the day `days` before and up to the end of the date; not with fewer than three.
    Every event counts for the few dates whose window it is in; a window's rates are sorted for their places and then are one aggregate,
    and no date's or instrument's events are gathered. The cut weighs its two neighbours and rounds once, as the SQL's quantile does, so that
    a mean which equals it falls on the same side. A date's rates are added up in the order of the events, wherever they lie; the mean of equal
    rates is that rate, whatever their number."""
    so_far = Window.partitionBy("instrument", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    known = events.filter("rate is not null").select("instrument", "ts", "event_id", "rate", "day", (F.sum("rate").over(so_far) / F.count("*").over(so_far)).alias("_mean"))
    midnight = F.col("ts").cast("timestamp") == F.to_timestamp(F.date_from_unix_date(F.col("day").cast("int")))
    until = F.col("day") + F.lit(days) - midnight.cast("int")
    each = Window.partitionBy("instrument", "_d")
    j = known.withColumn("_d", F.explode(F.sequence("day", until)))
    j = j.withColumn("_k", F.row_number().over(each.orderBy("rate")) - 1).withColumn("_at", (F.count("*").over(each) - 1) * F.lit(q))
    today, at = F.col("day") == F.col("_d"), F.struct("ts", "event_id")
    own = F.when(today, F.col("rate"))
    mean = F.when(F.min(own) == F.max(own), F.max(own)).otherwise(F.max_by("_mean", F.when(today, at)))
    low, high = (F.max(F.when(F.col("_k") == place, F.col("rate"))) for place in (F.floor("_at"), F.ceil("_at")))
    seen = j.groupBy("instrument", F.col("_d").alias("day")).agg(
        F.count("*").alias("n"), low.alias("_low"), high.alias("_high"), F.max(F.col("_at") - F.floor("_at")).alias("_part"), F.coalesce(mean, F.max_by("rate", at)).alias("recent")
    )
    between = fused("_low", 1 - F.col("_part"), F.col("_high") * F.col("_part"))
    seen = seen.withColumn("cut", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between))
    cells = known.select("instrument").distinct().join(dates.select("date", F.unix_date("date").alias("day")).hint("broadcast"))  # a row per date
    met = cells.join(seen, ["instrument", "day"], "left")
    n = F.coalesce("n", F.lit(0))
    enough = lambda c: F.when(n >= 3, F.col(c))
    return met.select("instrument", "date", F.coalesce(enough("recent") < enough("cut"), F.lit(False)).alias("allowed"), enough("cut").alias("cut"), enough("recent").alias("recent"), n.cast("int").alias("n_events"))


def squeeze_flags(bars: DataFrame, threshold: float = 0.15, k: float = 3.0, n: int = 20) -> DataFrame:
    """instrument, date and flag: a return above the threshold on more than k times the mean volume of the n rows before, all of
    them there."""
    before = Window.partitionBy("instrument").orderBy("day").rowsBetween(-n, -1)
    usual = F.when(F.count("volume").over(before) >= n, F.avg("volume").over(before))
    return with_returns(bars).select("instrument", "date", F.coalesce((F.col("ret") > threshold) & (F.col("volume") > k * usual), F.lit(False)).alias("flag"))


def rebalance_fee(turnover, rate: float = 0.001) -> Column:
    """A turnover (sum of absolute weight changes) pays half the round trip's rate."""
    return col(turnover) * rate / 2


def hedge_costs(df: DataFrame, ratio: str, rate: float = 0.0005, funding: float = 0.1095) -> DataFrame:
    """Adds perp_fee, the fee for changing the hedge (from none), and funding_cost, a day's share of the yearly funding; a negative hedge
    is an error."""
    before = F.coalesce(F.lag(ratio).over(Window.partitionBy("instrument").orderBy("day")), F.lit(0.0))
    wrong = F.raise_error(F.lit("a hedge ratio is never negative")).cast("double")
    cost = F.when(F.col(ratio) < 0, wrong).otherwise(F.col(ratio) * funding / 365)
    return df.withColumn("perp_fee", F.abs(F.col(ratio) - before) * rate).withColumn("funding_cost", cost)
