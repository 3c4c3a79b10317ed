"""Technical states of daily bars and the nineteen signals built of them.

Bars are rows (instrument, day, open, high, low, close); windows are over rows, since a trading day is a row. A window of n has
a value from n // 2 rows on (2 at least). Recursive means start at the first value. No value in, none out: a null stands
for what isn't known yet.

Where a state only depends on which of two bands was crossed last, it is a forward fill of the crossings; a memory that fades from
its last trigger is a power of the days since. Bands that carry themselves (supertrend, parabolic) are folded a row at a
time by `followed`. Signals take all means in passes over sorted rows; states fold them inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from quantloom.functions.scalar import col
from quantloom.operators import rolling as R
from quantloom.operators.intraday import followed

TINY = 1e-8


def in_order() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("day")


def rows(n: int, before: int = 0) -> WindowSpec:
    """The n rows up to `before` rows ago."""
    return in_order().rowsBetween(-(n - 1) - before, -before)


def div(a, b) -> Column:
    return col(a) / (col(b) + TINY)


def enough(x, n: int, e: Column, least: int | None = None, before: int = 0) -> Column:
    return F.when(F.count(col(x)).over(rows(n, before)) >= (max(2, n // 2) if least is None else least), e)


def mean(x, n: int, least: int | None = None) -> Column:
    return enough(x, n, F.avg(col(x)).over(rows(n)), least)


def std(x, n: int) -> Column:
    return enough(x, n, F.stddev_pop(col(x)).over(rows(n)))


def highest(x, n: int, before: int = 0, least: int | None = None) -> Column:
    return enough(x, n, F.max(col(x)).over(rows(n, before)), least, before)


def lowest(x, n: int, before: int = 0) -> Column:
    return enough(x, n, F.min(col(x)).over(rows(n, before)), None, before)


def happened(event: Column, n: int) -> Column:
    """In how many of the last n rows an event holds."""
    return F.count_if(F.coalesce(event, F.lit(False))).over(rows(n))


def lag(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(in_order())


def lag_or_own(x, n: int = 1) -> Column:
    """The value n rows before; in the first n rows the row's own."""
    return F.when(F.row_number().over(in_order()) > n, lag(x, n)).otherwise(col(x))


def change(x) -> Column:
    """Against the row before; 0 in the first row."""
    return F.when(F.row_number().over(in_order()) == 1, F.lit(0.0)).otherwise(col(x) - lag(x))


def weighted(x, n: int) -> Column:
    """Mean of the last n rows with weights 1, 2, ... in order of the row."""
    k = F.row_number().over(in_order())
    start = F.greatest(k - n, F.lit(0))
    total = F.sum(col(x) * F.col("_k")).over(rows(n)) - start * F.sum(col(x)).over(rows(n))
    weights = F.sum(F.when(col(x).isNotNull(), F.col("_k"))).over(rows(n)) - start * F.count(col(x)).over(rows(n))
    return enough(x, n, F.when(weights > TINY, total / weights))


def both(*conditions: Column) -> Column:
    """All hold; what isn't known doesn't."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def positive(x: Column) -> Column:
    """x where positive, else 0; null where x is."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def bounded(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def side_of(above: Column, below: Column) -> Column:
    """1 since the last crossing above, -1 since the last below, 1 before any."""
    crossed = F.when(F.coalesce(above, F.lit(False)), 1).when(F.coalesce(below, F.lit(False)), -1)
    return F.coalesce(F.last(crossed, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))


def memory(trigger: Column, keep: float) -> Column:
    """1 on a trigger, then `keep` to the power of the rows since; 0 before the first."""
    k = F.row_number().over(in_order())
    last = F.max(F.when(F.coalesce(trigger, F.lit(False)), F.col("_k"))).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(last.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(keep), k - last))


def bars_of(bars: DataFrame) -> DataFrame:
    """Bars as doubles, numbered from 1, with true range, typical price, gains and losses."""
    b = bars.select("instrument", "date", "day", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    before, step = lag_or_own("close"), change("close")
    return b.select(
        "*",
        F.row_number().over(in_order()).alias("_k"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)).alias("tr"),
        ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("tp"),
        F.greatest(step, F.lit(0.0)).alias("_gain"),
        F.greatest(-step, F.lit(0.0)).alias("_loss"),
    )


def emas(df: DataFrame, **columns: tuple[str, float]) -> DataFrame:
    """Recursive means: name=(column, span)."""
    return R.recursive_pass(df, **{name: (x, 2 / (n + 1)) for name, (x, n) in columns.items()})


def smoothed(df: DataFrame, **columns: tuple[str, float]) -> DataFrame:
    """Recursive means of weight one in n: name=(column, n)."""
    return R.recursive_pass(df, **{name: (x, 1 / n) for name, (x, n) in columns.items()})


def with_atr(df: DataFrame, periods: Iterable[int]) -> DataFrame:
    return smoothed(df, **{f"atr{n}": ("tr", n) for n in periods})


def with_rsi(df: DataFrame, periods: Iterable[int]) -> DataFrame:
    df = smoothed(df, **{f"_gain{n}": ("_gain", n) for n in periods}, **{f"_loss{n}": ("_loss", n) for n in periods})
    return df.select("*", *[bounded(100 - 100 / (1 + div(f"_gain{n}", f"_loss{n}")), -100.0, 100.0).alias(f"rsi{n}") for n in periods])


def placed(df: DataFrame, periods: Iterable[int]) -> DataFrame:
    """Place of the close in the range of n rows, in per cent."""
    place = {n: bounded(div(F.col("close") - lowest("low", n), highest("high", n) - lowest("low", n)) * 100, 0.0, 100.0) for n in periods if f"_place{n}" not in df.columns}
    return df.select("*", *[p.alias(f"_place{n}") for n, p in place.items()])


def means_of(df: DataFrame, atr: Iterable[int] = (), rsi: Iterable[int] = (), stochastic: Iterable[int] = (), macd: Iterable[int] = (), ema: Iterable[int] = (), by: Callable = R.recursive_pass, **more: tuple[str, float]) -> DataFrame:
    """All recursive means of what `bars_of` gives at once, under the names by which the states below know them; `more` are by span."""
    spans = {**{f"ema{n}": ("close", n) for n in ema}, **dict(zip(("_fast", "_slow"), (("close", n) for n in macd))), **more}
    parts = {**{f"atr{n}": ("tr", n) for n in atr}, **{f"_{x}{n}": (f"_{x}", n) for n in rsi for x in ("gain", "loss")}, **{f"k{n}": (f"_place{n}", 3) for n in stochastic}}
    return by(placed(df, stochastic), **{name: (x, 1 / n) for name, (x, n) in parts.items()}, **{name: (x, 2 / (n + 1)) for name, (x, n) in spans.items()})


def with_stochastic(df: DataFrame, periods: Iterable[int], smooth: int = 3) -> DataFrame:
    """Place of the close in the range of n rows, in per cent, smoothed."""
    return smoothed(placed(df, periods), **{f"k{n}": (f"_place{n}", smooth) for n in periods})


def with_cci(df: DataFrame, periods: Iterable[int]) -> DataFrame:
    df = df.select("*", *[mean("tp", n).alias(f"_tp{n}") for n in periods])
    df = df.select("*", *[F.abs(F.col("tp") - F.col(f"_tp{n}")).alias(f"_off{n}") for n in periods])
    return df.select("*", *[bounded((F.col("tp") - F.col(f"_tp{n}")) / (0.015 * mean(f"_off{n}", n) + TINY), -1e4, 1e4).alias(f"cci{n}") for n in periods])


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = emas(df, _fast=("close", fast), _slow=("close", slow)).withColumn("_macd", F.col("_fast") - F.col("_slow"))
    return emas(df, _signal=("_macd", signal)).withColumn("macd", F.col("_macd") - F.col("_signal"))


def with_hull(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("_hull", 2 * weighted("close", max(2, n // 2)) - weighted("close", n))
    return df.withColumn(f"hma{n}", weighted("_hull", max(2, math.isqrt(n))))


def with_chandelier(df: DataFrame, n: int = 22, k: float = 3.0) -> DataFrame:
    """long_stop, short_stop and ce_side: the side since the close last left the stops of the row before. Needs atr{n}."""
    df = df.withColumn("long_stop", highest("high", n) - k * F.col(f"atr{n}")).withColumn("short_stop", lowest("low", n) + k * F.col(f"atr{n}"))
    return df.withColumn("ce_side", side_of(F.col("close") > lag("short_stop"), F.col("close") < lag("long_stop")))


def with_pmax(df: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    """pmax_side by the bands around the mean close, and pmax_line, the band on the other side; the first line is the lower band.
    Needs atr{n} and ema{n}."""
    df = df.withColumn("_upper", F.col(f"ema{n}") + k * F.col(f"atr{n}")).withColumn("_lower", F.col(f"ema{n}") - k * F.col(f"atr{n}"))
    df = df.withColumn("pmax_side", side_of(F.col("close") > lag("_upper"), F.col("close") < lag("_lower")))
    return df.withColumn("pmax_line", F.when(F.col("pmax_side") > 0, F.col("_lower")).otherwise(F.col("_upper"))).drop("_upper", "_lower")


def with_qqe(df: DataFrame, by: Callable = R.recursive_pass) -> DataFrame:
    """qqe_signal and qqe_hist of the centred RSI, and qqe_progress: sign changes of qqe_hist so far, of three. Needs rsi14."""
    df = by(df.withColumn("_centred", F.col("rsi14") - 50), qqe_signal=("_centred", 2 / 6), _slow_signal=("qqe_signal", 2 / 15)).withColumn("qqe_hist", F.col("qqe_signal") - F.col("_slow_signal"))
    sign = F.when(F.signum("qqe_hist") != 0, F.signum("qqe_hist"))
    before = F.last(sign, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_flip", F.coalesce((sign != before).cast("int"), F.lit(0)))
    flips = F.sum("_flip").over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("qqe_progress", F.least(flips, F.lit(3)) / 3)


def with_days_since_change(df: DataFrame, state: str, out: str) -> DataFrame:
    """Rows since the state changed, or since the first row."""
    k = F.row_number().over(in_order())
    df = df.withColumn("_changed", F.when(F.col(state) != lag(state), F.col("_k")))
    return df.withColumn(out, k - F.coalesce(F.last("_changed", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)))


def _parabolic(step: float = 0.02, most: float = 0.2) -> Callable:
    def fold(state, high, low):
        if state is None:
            return (low, True, step, high, (low,), (high,)), (low,)
        sar, up, speed, best, lows, highs = state
        sar += speed * (best - sar)
        if len(lows) > 1:
            sar = min(sar, *lows) if up else max(sar, *highs)
        turned = low < sar if up else high > sar
        if turned:
            sar, up, best = best, not up, low if up else high
        further = high > best if up else low < best
        if further:
            best = high if up else low
        speed = step if turned else min(speed + step, most) if further else speed
        return (sar, up, speed, best, (*lows[-1:], low), (*highs[-1:], high)), (sar,)

    return fold


def parabolic(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """instrument, date and sar, the parabolic stop: it moves towards the best price by a growing share, never past the last two lows
    (highs when short); when the price crosses it, it jumps to the best price and the side changes."""
    b = bars.select("instrument", "date", "day", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    return followed(b, ["high", "low"], lambda: None, _parabolic(step, most), "sar double")


def _trend(k: float) -> Callable:
    def fold(state, high, low, close, atr):
        upper, lower = (high + low) / 2 + k * atr, (high + low) / 2 - k * atr
        if state is None:
            side = 1
        else:
            up, down, last, side = state
            side = 1 if close > up else -1 if close < down else side
            upper = upper if upper < up or last > up else up
            lower = lower if lower > down or last < down else down
        return (upper, lower, close, side), (side, upper, lower)

    return fold


def supertrend(bars: DataFrame, n: int = 100, k: float = 5.5) -> DataFrame:
    """instrument, date, side and both carried bands: a band only tightens until the close of the row before has passed it; the
    side changes when the close passes a band of the row before."""
    b = with_atr(bars_of(bars), [n]).select("instrument", "date", "day", "high", "low", "close", f"atr{n}")
    return followed(b, ["high", "low", "close", f"atr{n}"], lambda: None, _trend(k), "side int, upper double, lower double")


def with_stops(df: DataFrame, n: int = 100, k: float = 5.5) -> DataFrame:
    """sar of `parabolic` and st_side, the side of `supertrend`, in one pass. Needs atr{n}."""
    stop, trend = _parabolic(), _trend(k)

    def fold(state, high, low, close, atr):
        (a, (sar,)), (b, (side, _, _)) = stop(state[0], high, low), trend(state[1], high, low, close, atr)
        return (a, b), (sar, side)

    return followed(df, ["high", "low", "close", f"atr{n}"], lambda: (None, None), fold, "sar double, st_side int", df.columns)


def states(bars: DataFrame) -> DataFrame:
    """The path-dependent states, but for the two folded ones: chandelier, PMax, memory of a CCI below -200, QQE, and days since the PMax side changed."""
    df = means_of(bars_of(bars), atr=[10, 22], rsi=[14], ema=[10], by=R.recursive)
    df = with_qqe(with_rsi(with_pmax(with_chandelier(df)), [14]), R.recursive)
    df = with_cci(df, [18])
    df = df.withColumn("oversold", memory(F.col("cci18") < -200, 0.95))
    df = with_days_since_change(df, "pmax_side", "pmax_days")
    return df.select("instrument", "date", "long_stop", "short_stop", "ce_side", "pmax_side", "pmax_line", "pmax_days", "oversold", "qqe_signal", "qqe_hist", "qqe_progress")


def technical(bars: DataFrame) -> DataFrame:
    """True range, ATR by both means, RSI, stochastic K, CCI, MACD histogram, weighted and Hull means."""
    df = means_of(bars_of(bars), atr=[14], rsi=[14], stochastic=[25], macd=(12, 26), atr_ema=("tr", 14))
    df = with_macd(with_cci(with_stochastic(with_rsi(df, [14]), [25]), [20]))
    df = with_hull(df, 20).withColumn("wma20", weighted("close", 20))
    return df.select("instrument", "date", "tr", F.col("atr14").alias("atr"), "atr_ema", F.col("rsi14").alias("rsi"), F.col("k25").alias("k"), F.col("cci20").alias("cci"), "macd", "wma20", F.col("hma20").alias("hma"))


SIGNALS = ["S1", "S2", "V1", "V2_base", "V2_opt", "V3_base", "V3_opt", "V4_base", "V5_base", "V6_base", "V7_base", "V8_base", "V9_base", "V9_opt", "V10_base", "V11_base", "V12_base", "V13_base", "V14_base"]


def _inputs(bars: DataFrame) -> DataFrame:
    """All states that the signals share, in two passes: what needs a mean of a mean's function comes in the second."""
    more = {"_tp_ema": ("tp", 20), "_tr20": ("tr", 20), "_tr50": ("tr", 50), "gc_mid": ("_tp_ema", 20), "_gc_width": ("_tr20", 20)}
    df = means_of(bars_of(bars), atr=[6, 9, 10, 14, 22, 50, 100], rsi=[14, 25, 100], stochastic=[25, 40], macd=(12, 26), ema=[10, 20, 50, 200], **more)
    df = with_stops(df)
    df = with_stochastic(with_macd(with_qqe(with_rsi(df, [14, 25, 100]))), [25, 40])
    return with_hull(with_cci(with_pmax(with_chandelier(df)), [18, 20, 54]), 20)


def _bands(df: DataFrame) -> DataFrame:
    c, atr, tr50 = F.col("close"), F.col("atr14"), F.col("_tr50")
    mid, sd = mean("close", 20), std("close", 20)
    df = df.withColumn("_mid", mid).withColumn("_sd", sd).withColumn("_mid25", mean("close", 25)).withColumn("_sd25", std("close", 25))
    df = df.withColumn("_ph", 2 * F.col("tp") - F.col("low")).withColumn("_pl", 2 * F.col("tp") - F.col("high"))
    df = df.select(
        "*",
        ((1 - div(4 * F.col("_sd"), 3 * F.col("_tr20"))) * (bounded(div(c - (F.col("_mid") - 2 * F.col("_sd")), 4 * F.col("_sd")), 0.0, 1.0) - 0.5)).alias("_squeeze"),
        highest("_ph", 23, 1).alias("_ph23"),
        lowest("_pl", 23, 1).alias("_pl23"),
        (F.col("ce_side") * (F.col("rsi25") - F.col("rsi100")) * F.abs((F.col("rsi25") - 50) / 50)).alias("V2_base"),
        div(c - F.col("ema200"), "ema200").alias("_dev200"),
        (div("macd", c) * 1000).alias("_macd_mom"),
        div(c - F.col("sar"), atr).alias("_sar_dist"),
        change("macd").alias("_macd_step"),
        change("cci20").alias("_cci_step"),
        lag_or_own("cci20").alias("_cci_before"),
        (F.col("cci18") - F.col("cci54")).alias("_cci_spread"),
        (c - F.col("open")).alias("_body"),
        div(F.col("hma20") - lag_or_own("hma20"), atr).alias("_hma_slope"),
        div(c - F.col("hma20"), "_sd").alias("_hma_dev"),
        (F.col("ema50") + 2.75 * tr50).alias("_inner_up"),
        (F.col("ema50") - 2.75 * tr50).alias("_inner_dn"),
        (F.col("ema50") + 3.75 * tr50).alias("_outer_up"),
        (F.col("ema50") - 3.75 * tr50).alias("_outer_dn"),
        F.when(mean("close", 2, 1) >= mean("close", 30), 1).otherwise(-1).alias("_ma_side"),
    )
    above, below = c - (F.col("_mid") + 0.8 * F.col("_sd")), F.col("_mid") - 0.8 * F.col("_sd") - c
    df = df.withColumn("_long_entry", positive(div(above, atr)) * positive(F.col("_hma_slope"))).withColumn("_short_entry", positive(div(below, atr)) * positive(-F.col("_hma_slope")))
    df = df.withColumn("_long_break", positive(div(c - F.col("_ph23"), atr))).withColumn("_short_break", positive(div(F.col("_pl23") - c, atr)))
    return with_days_since_change(df, "_ma_side", "_ma_days")


def signals(bars: DataFrame) -> DataFrame:
    """instrument, date and the nineteen SIGNALS, each within a million of 0."""
    df = _bands(_inputs(bars))
    c, atr = F.col("close"), F.col("atr14")
    sign, k25, dev = F.signum, F.col("k25"), F.col("_hma_dev")
    num = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    out: dict[str, Column] = {
        "S1": F.col("_squeeze") * (F.col("k40") - 50),
        "S2": div(c - F.col("_ph23"), "atr9"),
        "V1": F.col("_squeeze") * F.when(k25 > 80, k25 - 80).when(k25 < 20, k25 - 20).otherwise(0.0),
        "V2_base": F.col("V2_base"),
    }
    # pullbacks of the RSI from its extremes
    pull = F.when(F.col("ce_side") > 0, positive(highest("rsi25", 20) - 70) / 30).otherwise(positive(30 - lowest("rsi25", 20)) / 30)
    out["V2_opt"] = F.col("V2_base") * (1 + pull)
    # five zones around the middle; where bands meet, the lower ones count
    up_in, up_out, dn_in, dn_out = (F.col(f"_{x}") for x in ("inner_up", "outer_up", "inner_dn", "outer_dn"))
    zones = (
        F.when(c < dn_out, -2 - bounded(div(dn_out - c, "_tr50"), 0.0, 1.0))
        .when((c <= dn_in) & (c >= dn_out), -2 + div(c - dn_out, dn_in - dn_out))
        .when(c > up_out, 2 + bounded(div(c - up_out, "_tr50"), 0.0, 1.0))
        .when((c >= up_in) & (c <= up_out), 1 + div(c - up_in, up_out - up_in))
        .otherwise(bounded(div(c - F.col("ema50"), 2.75 * F.col("_tr50")), -1.0, 1.0))
    )
    out["V3_base"] = zones
    out["V3_opt"] = zones * div(F.col("ema20") - F.col("ema50"), "_tr50")
    # three trends that agree
    d200, mom, sar = F.col("_dev200"), F.col("_macd_mom"), F.col("_sar_dist")
    agree = (num(sign(mom) == sign(d200)) + num(sign(sar) == sign(d200)) + num(sign(d200) != 0)) / 3
    out["V4_base"] = sign(d200) * (F.abs(d200) + F.abs(mom) + F.abs(sar)) * agree
    # a smooth channel, momentum and extremes left behind
    cci, before = F.col("cci20"), F.col("_cci_before")
    left = happened(((before > 200) & (cci <= 200)) | ((before < -200) & (cci >= -200)), 20)
    force = F.abs(div(c - F.col("gc_mid"), 2 * F.col("_gc_width"))) + F.abs(div("_macd_step", c) * 1000) + F.abs(F.col("_cci_step") / 100)
    out["V5_base"] = sign(change("gc_mid")) * sign("_macd_step") * sign(cci) * force / 3 * (1 + F.least(left, F.lit(3)) * 0.33)
    spread = F.col("_cci_spread")
    fading = memory(F.col("cci18") < -200, 0.95) * positive(spread) - memory(F.col("cci18") > 200, 0.95) * positive(-spread)
    out["V6_base"] = fading * (1 + F.abs(div(c - F.col("_mid"), "atr6")) * 0.3) / 100
    above200, st, hist = c >= F.col("ema200"), F.col("st_side"), F.col("qqe_hist")
    ride = num(above200 & (st > 0)) * positive(hist) - num(~above200 & (st < 0)) * positive(-hist)
    out["V7_base"] = ride * F.abs("qqe_signal") * (1 - F.col("qqe_progress")) * 0.01
    # three bars in a row
    b0, b1, b2 = F.col("_body"), lag_or_own("_body"), lag_or_own("_body", 2)
    c1, c2 = lag_or_own("close"), lag_or_own("close", 2)
    three_up = both(b0 > 0, b1 > 0, b2 > 0, c > c1, c1 > c2, c > F.col("ema200"), F.col("pmax_line") > F.col("ema200"))
    three_down = both(b0 < 0, b1 < 0, b2 < 0, c < c1, c1 < c2, c < F.col("ema200"), F.col("pmax_line") < F.col("ema200"))
    away, occ = div(c - F.col("pmax_line"), atr), F.avg(sign(b0)).over(rows(3))
    push = num(three_up) * positive(away) * positive(occ) - num(three_down) * positive(-away) * positive(-occ)
    out["V8_base"] = push * div(F.abs(b0) + F.abs(b1) + F.abs(b2), atr) * (1 + F.abs(d200))
    # entries that pile up on one side
    net = F.col("_long_entry") - F.col("_short_entry")
    piled = bounded((happened(F.col("_long_entry") > 0, 10) - happened(F.col("_short_entry") > 0, 10)) / 10, -1.0, 1.0)
    v9 = piled * F.abs(net) * positive(sign(net) * sign(piled))
    out["V9_base"] = v9
    out["V9_opt"] = v9 * (1 + 0.5 * sign(v9) * sign(c - F.col("ema200")))
    high_body, low_body, hull, tilt = F.greatest("open", "close"), F.least("open", "close"), F.col("hma20"), F.col("_hma_slope")
    over = F.when(low_body > hull, 1.0).when(high_body > hull, 0.3).otherwise(0.0)
    under = F.when(high_body < hull, 1.0).when(low_body < hull, 0.3).otherwise(0.0)
    rising = positive(tilt) * over * num(c > F.col("ema200")) * positive(k25 - 50) / 50
    out["V10_base"] = rising - positive(-tilt) * under * num(c < F.col("ema200")) * positive(50 - k25) / 50
    # a deviation, trusted by its late hits, the weekday and how far it has come
    hit = num((sign(lag("_hma_dev")) != 0) & (sign(F.when(F.col("_k") > 1, c / (lag("close") + TINY) - 1)) == sign(lag("_hma_dev"))))
    broke = both(dev > 0, c > highest("high", 6, 1)) | both(dev < 0, c < lowest("low", 6, 1))
    weekday = F.weekday("date")
    df = df.withColumn("_hit", hit)
    mode = F.when(F.avg("_hit").over(rows(6)) >= 0.5, 1.0).when(broke, 0.5).otherwise(0.0)
    time = F.when(weekday == 6, 0.0).when(weekday == 0, 0.5).otherwise(1.0)
    ripe = 1 - 0.5 * bounded(div(F.abs(dev), F.max(F.abs(dev)).over(rows(20))), 0.0, 1.0)
    out["V11_base"] = sign(dev) * F.least(F.abs(dev), F.lit(3.0)) * mode * time * ripe
    # breakouts
    e20, e50, e200, long, short = (F.col(x) for x in ("ema20", "ema50", "ema200", "_long_break", "_short_break"))
    wider = positive(div(atr - F.col("atr50"), "atr50"))
    trend = num((e20 > e50) & (e50 > e200)) - num((e20 < e50) & (e50 < e200))
    speed = bounded(1 + div(atr - lag_or_own("atr14"), atr) * 0.5, 0.5, 2.0)
    out["V12_base"] = (long - short) * (0.5 + wider) * positive(sign(long - short) * trend) * speed
    mid, sd = F.col("_mid25"), F.col("_sd25")
    wide, buffer = div(5 * sd, mid) > 0.01, div(c - mid, atr)
    room = lambda x: bounded(div(x, 3 * atr), 0.0, 1.0)
    upper, lower = num((c > mid + 2.5 * sd) & wide), num((c < mid - 2.5 * sd) & wide)
    out["V13_base"] = upper * positive(buffer) * room(mid + 3.75 * sd - c) - lower * positive(-buffer) * room(c - (mid - 3.75 * sd))
    side, kept = F.col("_ma_side"), F.coalesce(F.col("_ma_side") == lag("_ma_side"), F.lit(True))
    aged = F.least(F.col("_ma_days") / 5, F.lit(1.0))
    against_up, against_down = num(both(side < 0, c > highest("high", 16, 1), kept)), num(both(side > 0, c < lowest("low", 16, 1), kept))
    out["V14_base"] = against_up * bounded(long, 0.0, 2.0) * aged - against_down * bounded(short, 0.0, 2.0) * aged
    return df.select("instrument", "date", *[bounded(out[s], -1e6, 1e6).alias(s) for s in SIGNALS])
