"""Gains over a recursive reference price: what holders paid, where a share of them changes every period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.operators import rolling as R
from quantloom.operators.intraday import followed


def reference_price(df: DataFrame, price: str, turnover: str, close: str) -> DataFrame:
    """instrument, date, close and reference: the mean price paid before a row, each period's turnover replaced at its price."""

    def step(state, paid, share, shown):
        before, last, turned = state
        now = paid if last is None else (last if before is None else before) * (1 - turned) + last * turned
        return (now, paid, min(max(share or 0.0, 0.0), 1.0)), (now, shown)

    return followed(df, [price, turnover, close], lambda: (None, None, 0.0), step, "reference double, close double")


def gain(turnover_at_least: float = 0.02, most: float = 0.8, n: int = 10):
    """Unrealised gain over the reference price; turnover follows the volume's place in its recent range."""

    def run(bars: DataFrame) -> DataFrame:
        b = bars.withColumn("_p", (F.col("quote_volume") / F.col("volume")).cast("double")).withColumn("_l", F.log(F.col("volume") + 1)).withColumn("_c", F.col("close").cast("double"))
        low, high = R.ts_min("_l", n, 1), R.ts_max("_l", n, 1)
        place = F.when(high > low, (F.col("_l") - low) / (high - low)).otherwise(0.0)
        b = b.withColumn("_t", F.least(turnover_at_least + place * most * (1 - turnover_at_least), F.lit(0.99)))
        r = reference_price(b, "_p", "_t", "_c")
        return r.select("instrument", "date", ((F.col("close") - F.col("reference")) / F.col("reference")).alias("value"))

    return run


def clipped_gain(bars: DataFrame, share, n: int = 60, least: int = 10) -> DataFrame:
    """Gain over the reference price within -1 and 1; share(ratio) maps volume over its mean to a turnover, smoothed over two
    periods and kept between 0.01 and 0.25."""
    b = bars.withColumn("_c", F.col("close").cast("double")).withColumn("_r", share(F.col("volume") / R.ts_mean("volume", n, least)))
    b = R.recursive(b, _e=("_r", 2 / 3)).withColumn("_t", F.when(F.col("_r").isNotNull(), F.greatest(F.least("_e", F.lit(0.25)), F.lit(0.01))))
    b = b.withColumn("_shown", F.when(F.col("_r").isNotNull(), F.col("_c")))
    r = reference_price(b, "_c", "_t", "_shown")
    gained = F.greatest(F.least((F.col("close") - F.col("reference")) / F.col("reference"), F.lit(1.0)), F.lit(-1.0))
    return r.select("instrument", "date", F.when(F.col("close").isNotNull(), gained).alias("value"))


def by_tanh(ratio: Column) -> Column:
    return 0.03 + 0.08 * F.tanh((ratio - 1) / 2)


def by_two_tanhs(ratio: Column) -> Column:
    t = F.when(ratio >= 1, 0.03 + 0.22 * F.tanh(0.38 * (ratio - 1))).otherwise(0.03 - 0.03 * F.tanh(1.61 * (1 - ratio)))
    return F.when(ratio.isNotNull(), F.greatest(F.least(t, F.lit(0.25)), F.lit(0.01)))
