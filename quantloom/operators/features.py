"""Feature builders: indicators of minutes, temporal compositions of any factor, the daily feature set with market-wide series, and
neutral residuals.

TINY is added where a quotient must not blow up. Windows are of days; what a feature needs at least is said beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import clip, col
from quantloom.operators import rolling as R
from quantloom.operators.intraday import in_period, in_time

TINY = 1e-8


def over(a, b) -> Column:
    return col(a) / (col(b) + TINY)


MINUTE = [
    "returns", "log_volume", "spread", "mid", "typical", "body", "upper_shadow", "lower_shadow", "range_pct", "return_abs", "volume_intensity", "up_volume_pressure", "down_volume_pressure",
    "cum_return", "close_position", "money_flow",
]


def minute_indicators(minutes: DataFrame) -> DataFrame:
    """Minutes (instrument, date, ts, seq, open, high, low, close, volume) with MINUTE: a period's first return is 0, returns stay within
    -0.5 and 5, intensity is volume over the period's mean, cum_return what 1 has become since the period began."""
    o, h, lo, c, v = (F.col(x).cast("double") for x in ("open", "high", "low", "close", "volume"))
    first = F.row_number().over(in_time()) == 1
    ret = clip(F.when(first, F.lit(0.0)).otherwise(over(c, F.lag(c).over(in_time())) - 1), -0.5, 5.0)
    m = minutes.withColumn("returns", ret).withColumn("volume_intensity", over(v, F.avg(v).over(in_period())))
    r, typical = F.col("returns"), (h + lo + c) / 3
    grown = F.product(1 + F.coalesce(r, F.lit(0.0))).over(in_time().rowsBetween(Window.unboundedPreceding, 0))
    out = {
        "log_volume": F.log(v + 1), "spread": h - lo, "mid": (h + lo) / 2, "typical": typical, "body": F.abs(c - o), "upper_shadow": h - F.greatest(o, c), "lower_shadow": F.least(o, c) - lo, "range_pct": over(h - lo, o),
        "return_abs": F.abs(r), "up_volume_pressure": F.when(r.isNotNull(), F.greatest(r, F.lit(0.0))) * F.col("volume_intensity"), "down_volume_pressure": F.when(r.isNotNull(), F.greatest(-r, F.lit(0.0))) * F.col("volume_intensity"),
        "cum_return": grown, "close_position": over(c - lo, h - lo), "money_flow": typical * v,
    }
    m = m.select("*", *[e.alias(n) for n, e in out.items()])
    return m.select(*minutes.columns, *MINUTE)


TEMPORAL = ["delta", "pct_change", "zscore", "rank", "accel", "decay", "ewm_residual", "fast_slow_diff", "tstat", "robust_zscore", "persistence_ratio", "event_count", "drawup", "drawdown", "half_life_decay"]


def temporal(panel: DataFrame, x: str, n: int) -> DataFrame:
    """instrument, date and the TEMPORAL compositions of x over n days. Windows begin with the n-th day of an instrument's history and take
    the values there are; rank and tstat ask for three. The recursive ones carry the last mean over missing values."""
    third = max(1, n // 3)
    p = R.recursive(
        panel.select("instrument", "date", "day", F.col(x).cast("double").alias("x")), decay=("x", 2 / (n + 1)), _fast=("x", 2 / (third + 1)), half_life_decay=("x", 1 - 0.5 ** (1 / max(1.0, n)))
    )
    v, w = F.col("x"), R.window(n)
    first = F.min("day").over(Window.partitionBy("instrument"))
    p = p.select("*", (F.col("day") - first).alias("_age"), F.percentile("x", F.lit(0.5)).over(w).alias("_median"), R.values("x", n).alias("_all"))
    whole = lambda e: F.when(F.col("_age") >= n - 1, e)
    count, mean, sd = F.count("x").over(w), F.avg("x").over(w), F.stddev_pop("x").over(w)
    deviations = F.array_sort(F.transform("_all", lambda y: F.abs(y - F.col("_median"))))
    k = F.size(deviations)
    middle = (F.try_element_at(deviations, F.floor((k + 1) / 2).cast("int")) + F.try_element_at(deviations, (F.floor(k / 2) + 1).cast("int"))) / 2 * 1.4826
    share = lambda c: F.when(count > 0, F.size(F.filter("_all", c)) / count)
    before = R.ref("x", n)
    out = {
        "delta": v - before, "pct_change": F.when(F.abs(before) > TINY, v / F.when(F.abs(before) > TINY, before) - 1), "accel": (v - before) - (before - R.ref("x", 2 * n)),
        "zscore": whole((v - mean) / (sd + TINY)), "rank": whole(F.when(count >= 3, F.size(F.filter("_all", lambda y: y <= F.col("x"))) / count)), "ewm_residual": v - F.col("decay"), "fast_slow_diff": F.col("_fast") - F.col("decay"),
        "tstat": whole(F.when(count >= 3, mean / (sd / F.sqrt(count) + TINY))), "robust_zscore": whole((v - F.col("_median")) / F.when(middle < TINY, 1.0).otherwise(middle)),
        "persistence_ratio": whole(F.greatest(share(lambda y: y > 0), share(lambda y: y < 0))), "event_count": whole(share(lambda y: F.abs(y) > 1)),
        "drawup": whole(v - F.min("x").over(w)), "drawdown": whole(F.max("x").over(w) - v),
    }
    p = p.select("*", *[e.alias(name) for name, e in out.items()])
    return p.select("instrument", "date", *TEMPORAL)


DAILY = [
    "returns", "intraday_range", "gap", "close_position", "upper_shadow", "lower_shadow", "volume_ratio", "turnover", "ret_10d", "ret_20d", "vol_ratio_10d", "realized_vol", "vol_regime",
    "mkt_trend_20d", "mkt_vol_20d", "mkt_amt_ratio", "mkt_breadth", "mkt_vol_regime", "beta_20d", "turnover_stability", "trend_strength", "price_acceleration", "downside_vol",
]


def daily_features(bars: DataFrame) -> DataFrame:
    """instrument, date and DAILY of bars (open, high, low, close, volume, amount, turnover). Market-wide series are a row per day, made by one
    aggregate, windowed there and joined back by day; such a window has all days in one task, of which there is a row each."""
    b = bars.select("instrument", "date", "day", *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume", "amount", "turnover")])
    c, h, lo, o = (F.col(x) for x in ("close", "high", "low", "open"))
    b = b.withColumn("returns", R.roc("close", 1)).withColumn("_ret5", R.roc("close", 5)).withColumn("realized_vol", R.ts_std("returns", 20, least=5))
    daily = b.groupBy("day").agg(
        F.avg("returns").alias("_market"), F.avg("realized_vol").alias("mkt_vol_20d"), F.sum("amount").alias("_amount"), (F.count_if(F.col("returns") > 0) / (F.count("returns") + TINY)).alias("_breadth")
    )
    every = daily.withColumn("instrument", F.lit(0))  # one series, for the same windows
    market = every.select(
        "day", "_market", "mkt_vol_20d", R.ts_sum("_market", 20, 5).alias("mkt_trend_20d"), over("_amount", R.ts_mean("_amount", 20, 5)).alias("mkt_amt_ratio"), R.ts_mean("_breadth", 5, 2).alias("mkt_breadth"),
        over("mkt_vol_20d", R.ts_mean("mkt_vol_20d", 60, 20)).alias("mkt_vol_regime"), R.ts_var("_market", 20, 10).alias("_market_var"),
    )
    m = b.join(market, "day")
    high, low = R.ts_max("high", 20, 5), R.ts_min("low", 20, 5)
    out = {
        "intraday_range": over(h - lo, c), "gap": F.try_divide("open", R.ref("close", 1)) - 1, "close_position": over(c - lo, h - lo), "upper_shadow": over(h - F.greatest(o, c), c), "lower_shadow": over(F.least(o, c) - lo, c),
        "volume_ratio": over("volume", R.ts_mean("volume", 20, 5)), "ret_10d": R.roc("close", 10), "ret_20d": R.roc("close", 20), "vol_ratio_10d": over("volume", R.ts_mean("volume", 10, 3)),
        "vol_regime": over("realized_vol", R.ts_mean("realized_vol", 60, 20)), "beta_20d": over(R.ts_cov("returns", "_market", 20, 10), "_market_var"), "turnover_stability": over(R.ts_mean("turnover", 20, 5), R.ts_std("turnover", 20, least=5)),
        "trend_strength": over(c - low, high - low), "price_acceleration": F.col("_ret5") - R.ref("_ret5", 5), "downside_vol": R.ts_std(F.when(F.col("returns").isNotNull(), F.least("returns", F.lit(0.0))), 20, least=5),
    }
    m = m.select("*", *[e.alias(n) for n, e in out.items()])
    return m.select("instrument", "date", *DAILY)


def winsorized_zscore(x, q: float = 0.01, log: bool = False) -> Column:
    """z-scores on the date of values clipped to its q and 1 - q quantiles; of log(1 + x) where `log`."""
    day = Window.partitionBy("date")
    v = F.log1p(col(x)) if log else col(x)
    c = clip_to(v, F.percentile(v, F.lit(q)).over(day), F.percentile(v, F.lit(1 - q)).over(day))
    sd = F.stddev_samp(c).over(day)
    return (c - F.avg(c).over(day)) / (F.when(sd != 0, sd) + 1e-9)


def clip_to(v: Column, low: Column, high: Column) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(v, low), high))


def sector_demeaned(df: DataFrame, x: str, sector: str) -> DataFrame:
    """x less its sector's mean on the date; as it is without a sector."""
    mean = F.avg(x).over(Window.partitionBy("date", sector))
    return df.withColumn(x, F.when(F.col(sector).isNotNull(), F.col(x) - mean).otherwise(F.col(x)))


def regressed(df: DataFrame, x: str, size: str, least: int = 3) -> DataFrame:
    """x less its slope on the log of a size, whose mean stays in it, on dates with at least so many pairs; other cells stay."""
    day = Window.partitionBy("date")
    s = F.log(F.greatest(F.col(size).cast("double"), F.lit(1e-10)))
    both = F.col(x).isNotNull() & F.col(size).isNotNull()
    df = df.withColumn("_s", F.when(both, s)).withColumn("_y", F.when(both, F.col(x)))
    n, spread = F.count("_s").over(day), F.var_pop("_s").over(day)
    slope = F.covar_pop("_s", "_y").over(day) * n / (spread * n + 1e-10)
    return df.withColumn(x, F.when(both & (n >= least), F.col(x) - slope * (F.col("_s") - F.avg("_s").over(day))).otherwise(F.col(x))).drop("_s", "_y")


def neutralized(df: DataFrame, x: str, universe: str, sector: str | None = None, size: str | None = None, amount: str | None = None) -> DataFrame:
    """x inside the universe, less its sector's mean, then less its slopes on log size and on log amount, one after the other."""
    df = df.withColumn(x, F.when(F.col(universe), F.col(x)))
    if sector:
        df = sector_demeaned(df, x, sector)
    for s in (size, amount):
        df = regressed(df, x, s) if s else df
    return df


CROSS = [
    "funding_z20", "funding_ma_diff_3_30", "funding_vol_30d", "funding_persistence_20d", "oi_z20", "oi_change_5d", "oi_change_decay_20d", "funding_oi_joint_5d", "beta_btc_60d", "corr_btc_20d", "resid_return_btc_20d",
    "idio_vol_btc_20d", "relative_strength_btc_5d", "amihud_illiq", "dollar_volume_rank", "volume_zscore_60d", "rv_5d", "rv_20d", "rv_ratio_5_20", "vol_of_vol_20d",
]
SMALL = 1e-12


def cross_period_features(panel: DataFrame, benchmark) -> DataFrame:
    """instrument, date and CROSS of a panel (ret, volume, turnover, funding, oi, oi_start, tradable). Spreads divide by the number of values; a
    window has a value from the number on that stands beside it. The benchmark instrument's returns, a row per day, are joined by
    day; ranks are ordinal among the date's tradable, from 0 to 1, ties by instrument."""
    over_ = lambda a, b: col(a) / (col(b) + SMALL)
    sd = lambda x, n, least: R.ts_std(x, n, 0, least)
    mean = R.ts_mean
    z = lambda x, n, least: (col(x) - mean(x, n, least)) / (sd(x, n, least) + SMALL)
    base = panel.filter(F.col("instrument") == benchmark).select("day", F.col("ret").alias("_base"))
    p = panel.join(base, "day", "left")
    ret, b = F.col("ret"), F.col("_base")
    both = ret.isNotNull() & b.isNotNull()
    positive = lambda x: F.when(F.col(x) > 0, F.col(x))
    p = p.select(
        "*", F.when(both, ret).alias("_x"), F.when(both, b).alias("_y"), F.log(positive("oi")).alias("_log_oi"), F.when(F.col("volume") >= 0, F.log1p("volume")).alias("_log_volume"), R.ref("turnover", 1).alias("_before"),
        F.when(positive("oi").isNotNull() & (R.ref("oi", 5) > 0), clip(F.col("oi") / (R.ref("oi", 5) + SMALL) - 1, -0.95, 10.0)).alias("oi_change_5d"), clip(over_("oi", "oi_start") - 1, -0.95, 10.0).alias("_oi_day"),
        sd("ret", 5, 3).alias("rv_5d"), sd("ret", 20, 8).alias("rv_20d"), F.sign("funding").alias("_side"),
    )
    p = R.recursive(p, oi_change_decay_20d=("_oi_day", 2 / 21))
    n = lambda k: F.count("_x").over(R.window(k))
    cov = lambda k: F.covar_pop("_x", "_y").over(R.window(k))
    var = lambda c, k: F.var_pop(c).over(R.window(k))
    p = p.select(
        "*", F.when(n(60) >= 20, cov(60) / (var("_y", 60) + SMALL)).alias("beta_btc_60d"), F.when(n(20) >= 8, clip(cov(20) / (F.sqrt(var("_x", 20) * var("_y", 20)) + SMALL), -1.0, 1.0)).alias("corr_btc_20d"),
        R.ts_mean("_before", 30, 1).alias("_usual"),
    )
    p = p.withColumn("_left", ret - F.col("beta_btc_60d") * b).withColumn("_dollar", F.log1p(positive("_usual")))
    same = lambda s: F.count_if(F.col("_side") == s).over(R.window(20)) / (F.count("funding").over(R.window(20)) + SMALL)
    ranked = F.col("tradable") & F.col("_dollar").isNotNull()
    day = Window.partitionBy("date", ranked)
    place = F.when(ranked & (F.count("*").over(day) > 1), (F.row_number().over(day.orderBy("_dollar", "instrument")) - 1) / (F.count("*").over(day) - 1))
    out = {
        "funding_z20": z("funding", 20, 8), "funding_ma_diff_3_30": mean("funding", 3, 2) - mean("funding", 30, 10), "funding_vol_30d": sd("funding", 30, 10),
        "funding_persistence_20d": F.when(F.col("_side") > 0, same(1)).when(F.col("_side") < 0, -same(-1)), "oi_z20": z("_log_oi", 20, 8), "funding_oi_joint_5d": F.col("_side") * F.col("oi_change_5d"),
        "resid_return_btc_20d": R.ts_sum("_left", 20, 8), "idio_vol_btc_20d": sd("_left", 20, 8), "relative_strength_btc_5d": R.ts_sum("ret", 5, 3) - R.ts_sum("_base", 5, 3),
        "amihud_illiq": F.abs(ret) / (positive("turnover") + SMALL) * 1e6, "dollar_volume_rank": place, "volume_zscore_60d": z("_log_volume", 60, 20), "rv_ratio_5_20": over_("rv_5d", "rv_20d"), "vol_of_vol_20d": sd("rv_5d", 20, 8),
    }
    return p.select("*", *[e.alias(name) for name, e in out.items()]).select("instrument", "date", *CROSS)
