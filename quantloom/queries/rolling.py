"""Rolling operators over the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import scalar as S
from quantloom.operators import rolling as R
from quantloom.queries.common import PAST, full, over, panel

C, N = "close", 5
UP = "close > open"


def up():
    return F.col("close") > F.col("open")


def w(e: str, n: int = N) -> str:
    return f"{e} OVER {over(n)}"


def back(x: str, n: int) -> str:
    return f"max({x}) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"


ARR = w("list(close)")
MEAN, SD = full(C, N, w("avg(close)")), full(C, N, w("stddev_samp(close)"))
SLOPE = full(C, N, w("regr_slope(close, day)"))
FIRST_MAX = w("max_by(day, (close, -day))")
FIRST_MIN = w("min_by(day, (close, day))")

panel("t01_ref", lambda: R.ref(C, 2), back(C, 2))
panel("t02_diff", lambda: R.diff(C, 2), f"close - {back(C, 2)}")
panel("t03_ts_mean", lambda: R.ts_mean(C, N), MEAN)
panel("t04_ts_sum", lambda: R.ts_sum(C, N), full(C, N, w("sum(close)")))
panel("t05_product", lambda: R.product(F.col(C) / 100, 4), full(C, 4, w("product(close / 100)", 4)))
panel("t06_roc", lambda: R.roc(C, 3), f"close / {back(C, 3)} - 1")
panel("t07_ts_std", lambda: R.ts_std(C, N), SD)
panel("t07_ts_std_population", lambda: R.ts_std(C, N, 0), full(C, N, w("stddev_pop(close)")))
panel("t08_ts_var", lambda: R.ts_var(C, N), full(C, N, w("var_samp(close)")))
panel("t09_ts_max", lambda: R.ts_max(C, N), full(C, N, w("max(close)")))
panel("t09_ts_min", lambda: R.ts_min(C, N), full(C, N, w("min(close)")))
panel("t10_ts_middle", lambda: R.ts_middle(C, N), full(C, N, f"({w('max(close)')} + {w('min(close)')}) / 2"))
panel(
    "t11_ts_mad", lambda: R.ts_mad(C, N), "CASE WHEN n >= 5 THEN list_sum(list_transform(a, lambda x: abs(x - m))) / n END",
    f", s AS (SELECT *, {ARR} AS a, {w('avg(close)')} AS m, {w('count(close)')} AS n FROM bars)", "s",
)
panel(
    "t12_ts_rank", lambda: R.ts_rank(C, N),
    "CASE WHEN len(a) >= 5 THEN (len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close)) + 1) / 2.0) / len(a) END",
    f", s AS (SELECT *, {ARR} AS a FROM bars)", "s",
)
panel("t13_ts_argmax", lambda: R.ts_argmax(C, N), full(C, N, f"5 - (day - {FIRST_MAX})"))
panel("t13_ts_argmin", lambda: R.ts_argmin(C, N), full(C, N, f"5 - (day - {FIRST_MIN})"))
panel("t14_hhvbars", lambda: R.hhvbars(C, N), full(C, N, f"day - {FIRST_MAX}"))
panel("t14_llvbars", lambda: R.llvbars(C, N), full(C, N, f"day - {FIRST_MIN}"))
panel("t15_count", lambda: R.count_true(up(), N), full(C, N, w(f"count_if({UP})")))
panel("t15_every", lambda: R.every(up(), 3).cast("int"), full(C, 3, f"({w(f'count_if({UP})', 3)} = 3)::INT"))
panel("t15_exist", lambda: R.exist(up(), 3).cast("int"), full(C, 3, f"({w(f'count_if({UP})', 3)} > 0)::INT"))
panel("t16_barssincen", lambda: R.barssincen(up(), N), f"day - {w(f'min(CASE WHEN {UP} THEN day END)')}")
panel("t17_barslast", lambda: R.barslast(up()), f"day - max(CASE WHEN {UP} THEN day END) OVER {PAST}")
panel(
    "t18_barslastcount", lambda: F.col("value"), f"CASE WHEN {UP} THEN count(*) OVER (PARTITION BY instrument, run ORDER BY day) - CASE WHEN run > 0 THEN 1 ELSE 0 END ELSE 0 END",
    f", s AS (SELECT *, sum(CASE WHEN {UP} THEN 0 ELSE 1 END) OVER {PAST} AS run FROM bars)", "s", lambda b: R.run_length(b, up()),
)
panel("t19_const", lambda: R.const("rate"), "last_value(rate IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
panel("t20_slope", lambda: R.slope(C, N), SLOPE)
panel("t20_angle", lambda: R.angle(C, N), f"degrees(atan({SLOPE}))")
panel("t20_intercept", lambda: R.intercept(C, N), f"{MEAN} - {SLOPE} * 2")
panel("t20_forecast", lambda: R.forecast(C, N), f"{MEAN} + {SLOPE} * 3")
panel(
    "t21_wma", lambda: R.wma(C, N), "CASE WHEN len(a) >= 5 THEN (a[1] + 2 * a[2] + 3 * a[3] + 4 * a[4] + 5 * a[5]) / 15 END",
    f", s AS (SELECT *, {ARR} AS a FROM bars)", "s",
)
panel("t22_ts_zscore", lambda: R.ts_zscore(C, N), f"(close - {MEAN}) / ({SD} + 1e-12)")
panel("t23_ts_skew", lambda: R.ts_skew(C, 6), full(C, 6, w("skewness(close)", 6)))
panel("t23_ts_kurt", lambda: R.ts_kurt(C, 6), full(C, 6, w("kurtosis(close)", 6)))
panel("t24_ts_median", lambda: R.ts_median(C, N), full(C, N, w("quantile_cont(close, 0.5)")))
_EMA = """, o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS i FROM bars),
  e AS (WITH RECURSIVE f AS (
    SELECT instrument, date, i, {x}::DOUBLE AS v FROM o WHERE i = 1
    UNION ALL SELECT o.instrument, o.date, o.i, coalesce({x} * {a} + f.v * (1 - {a}), {x}, f.v) FROM f JOIN o ON o.instrument = f.instrument AND o.i = f.i + 1
  ) SELECT * FROM f)"""
panel("t25_ema", lambda: F.col("v"), "v", _EMA.format(x=C, a=0.4), "e", lambda b: R.recursive(b, v=(C, 2 / 5)))
panel("t26_dma", lambda: F.col("v"), "v", _EMA.format(x="rate", a=0.3), "e", lambda b: R.recursive(b, v=("rate", 0.3)))
panel("t27_future_return", lambda: R.future_return(C, 2), "max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) / close - 1")
panel("t28_sharpe", lambda: R.sharpe(C, N), f"{MEAN} / ({SD} + 1e-12)")
_CHANGE = f", s AS (SELECT *, abs(close - {back(C, 1)}) AS c FROM bars)"
panel("t29_sum_abs_change", lambda: F.col("value"), full("c", N, w("sum(c)")), _CHANGE, "s", lambda b: R.change_sums(b, C, N))
panel("t29_mean_abs_change", lambda: F.col("value"), full("c", N, w("avg(c)")), _CHANGE, "s", lambda b: R.change_sums(b, C, N, True))
panel(
    "t30_ts_corr", lambda: R.ts_corr(C, "volume", 6),
    full(C, 6, f"CASE WHEN {w('stddev_samp(close)', 6)} * {w('stddev_samp(volume)', 6)} > 1e-12 THEN {w('covar_samp(close, volume)', 6)} / ({w('stddev_samp(close)', 6)} * {w('stddev_samp(volume)', 6)}) END"),
)
panel("t31_ts_cov", lambda: R.ts_cov(C, "volume", N), full(C, N, w("covar_samp(close, volume)")))
panel(
    "t35_elementwise", lambda: S.arcsin((F.col(C) - 200) / 150) + S.arccos((F.col(C) - 200) / 150) + S.signed_power(F.col(C) - F.col("open"), 0.5) + S.safe_log(F.col(C) - F.col("open")) + F.sin(C) + F.cos(C) + F.atan(C) + F.exp(-F.col(C) / 100),
    "asin(greatest(least((close - 200) / 150, 1), -1)) + acos(greatest(least((close - 200) / 150, 1), -1)) + sign(close - open) * sqrt(abs(close - open)) + sign(close - open) * ln(1 + abs(close - open)) + sin(close) + cos(close) + atan(close) + exp(-close / 100)",
)
