"""Intraday operators over events as minutes, tolerant rolling operators, and technical states."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quantloom import views
from quantloom.functions.scalar import divide
from quantloom.operators import intraday as M, portfolio as P, rolling as R
from quantloom.queries.common import add, over, panel, r

K = "instrument, date"
MIN = """m AS (SELECT user_id % 40 AS instrument, ts::DATE AS date, ts, event_id AS seq, value AS a, (event_id % 97)::DOUBLE + 1 AS b FROM events)"""


def minutes(s, d):
    """Events of 40 merged instruments as minutes: a is the value, b a volume."""
    return views.read(s, d, "events").select(
        F.pmod("user_id", F.lit(40)).alias("instrument"), F.to_date("ts").alias("date"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("a"), (F.pmod("event_id", F.lit(97)).cast("double") + 1).alias("b")
    )


def ok(e, n=3, count="count(*)"):
    return f"CASE WHEN {count} >= {n} THEN {e} END"


add("m01_period_resample", lambda s, d: M.resample(minutes(s, d)), f"""WITH {MIN}, g AS (SELECT {K}, arg_min(a, (ts, seq)) AS open, max(a) AS high, min(a) AS low, arg_max(a, (ts, seq)) AS close, sum(b) AS volume, count(*) AS n FROM m GROUP BY ALL)
  SELECT {K}, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}, n, CASE WHEN lag(close) OVER w IS NOT NULL THEN {r('greatest(least(close / lag(close) OVER w - 1, 5.0), -0.5)', 'x').removesuffix(' AS x')} END AS ret FROM g WINDOW w AS (PARTITION BY instrument ORDER BY date)""")
add("m02_last_minutes", lambda s, d: M.last_minutes(minutes(s, d), 3).groupBy("instrument", "date").agg(F.avg("a").alias("mean")), f"WITH {MIN}, l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ts DESC, seq DESC) <= 3) SELECT {K}, {r('avg(a)', 'mean')} FROM l GROUP BY ALL")
add("m03_quantile_mask", lambda s, d: M.quantile_mask(minutes(s, d), "b", 0.7).groupBy("instrument", "date").agg(F.count("*").alias("n"), F.sum("a").alias("total")), f"WITH {MIN}, l AS (SELECT * FROM m QUALIFY percent_rank() OVER (PARTITION BY {K} ORDER BY b, ts, seq) >= 0.7) SELECT {K}, count(*) AS n, {r('sum(a)', 'total')} FROM l GROUP BY ALL")
_LAST, _FIRST = "max_by(a, (ts, seq))", "min_by(a, (ts, seq))"
add("m09_minute_indicators", lambda s, d: M.indicators(minutes(s, d)).select("seq", "ret", "log_b", "intensity", "cum_return", "signed_flow"), f"""WITH {MIN}, l AS (SELECT *, a / lag(a) OVER t - 1 AS ret, first_value(a) OVER t AS f FROM m WINDOW t AS (PARTITION BY {K} ORDER BY ts, seq))
  SELECT seq, {r('ret', 'ret')}, {r('ln(1 + b)', 'log_b')}, {r(f'b / avg(b) OVER (PARTITION BY {K})', 'intensity')}, {r('a / f - 1', 'cum_return')}, {r('sign(coalesce(ret, 0)) * b', 'signed_flow')} FROM l""")
_H = "hour(ts) + minute(ts) / 60.0"
add("m10_day_slot_indicators", lambda s, d: M.day_slots(minutes(s, d)), f"""WITH {MIN}, l AS (SELECT *, abs(a - lag(a) OVER (PARTITION BY {K} ORDER BY ts, seq)) AS step, {_H} AS t FROM m)
  SELECT {K}, {r(f'CASE WHEN sum(step) > 1e-12 THEN abs({_LAST} - {_FIRST}) / sum(step) END', 'path_efficiency')}, {r('max_by(t, (a, -seq)) / 24', 'high_time')}, {r('min_by(t, (a, seq)) / 24', 'low_time')}, (max_by(t, (a, -seq)) < min_by(t, (a, seq)))::INT AS high_first,
  {r('max_by(a, (ts, seq)) FILTER (WHERE hour(ts) < 12) / min_by(a, (ts, seq)) FILTER (WHERE hour(ts) < 12) - 1', 'am_return')}, {r('max_by(a, (ts, seq)) FILTER (WHERE hour(ts) >= 12) / min_by(a, (ts, seq)) FILTER (WHERE hour(ts) >= 12) - 1', 'pm_return')}, {r('sum(CASE WHEN hour(ts) >= 12 THEN b END) / sum(b)', 'late_share')} FROM l GROUP BY ALL""")
add(
    "m11_cross_period_features",
    lambda s, d: (b := views.factor_panel(s, d).withColumn("mkt", F.avg("ret").over(Window.partitionBy("date")))).select("instrument", "date", R.ts_std("ret", 5, least=3).alias("rv_5"), R.ts_std("ret", 20, least=8).alias("rv_20"), R.ts_beta("ret", "mkt", 20, 8).alias("beta"), R.ts_zscore("funding", 20).alias("funding_z")),
    f"""WITH {views.FACTOR_PANEL}, q AS (SELECT *, CASE WHEN ret IS NOT NULL THEN avg(ret) OVER (PARTITION BY date) END AS mkt FROM panel) SELECT instrument, date, {r(f'CASE WHEN count(ret) OVER {over(5)} >= 3 THEN stddev_samp(ret) OVER {over(5)} END', 'rv_5')}, {r(f'CASE WHEN count(ret) OVER {over(20)} >= 8 THEN stddev_samp(ret) OVER {over(20)} END', 'rv_20')},
    {r(f'CASE WHEN count(ret) OVER {over(20)} >= 8 THEN covar_samp(mkt, ret) OVER {over(20)} / var_samp(mkt) OVER {over(20)} END', 'beta')}, {r(f'CASE WHEN count(funding) OVER {over(20)} >= 20 THEN (funding - avg(funding) OVER {over(20)}) / (stddev_samp(funding) OVER {over(20)} + 1e-12) END', 'funding_z')} FROM q""",
)
for _name, _spark, _sql in (
    ("m14_accelerate", lambda: R.diff("close", 1) - (R.ref("close", 1) - R.ref("close", 2)), None),
    ("m14_event_count", lambda: F.count_if(F.abs("close") > 50).over(R.window(5)), f"count(*) FILTER (WHERE abs(close) > 50) OVER {over(5)}"),
    ("m14_drawup", lambda: divide("close", F.min("close").over(R.window(5))) - 1, f"close / min(close) OVER {over(5)} - 1"),
    ("m14_drawdown", lambda: divide("close", F.max("close").over(R.window(5))) - 1, f"close / max(close) OVER {over(5)} - 1"),
    ("m14_fast_slow_diff", lambda: F.avg("close").over(R.window(3)) - F.avg("close").over(R.window(9)), f"avg(close) OVER {over(3)} - avg(close) OVER {over(9)}"),
    ("m14_tstat", lambda: R.full("close", 5, F.avg("close").over(R.window(5)) / (F.stddev_samp("close").over(R.window(5)) / F.sqrt(F.lit(5.0)))), f"CASE WHEN count(close) OVER {over(5)} >= 5 THEN avg(close) OVER {over(5)} / (stddev_samp(close) OVER {over(5)} / sqrt(5)) END"),
):
    _b = "max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {0} PRECEDING AND {0} PRECEDING)"
    panel(_name, _spark, _sql or f"close - 2 * {_b.format(1)} + {_b.format(2)}")


def listed(x, where=""):
    return f"list({x}::DOUBLE) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def folded(a, w):
    return f"list_reduce({a}, lambda s, y: s * {1 - w!r} + y * {w!r})"


_TECH = f"""WITH {views.BARS_MO}, p AS (SELECT *, max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pc, (high + low + close) / 3 AS tp FROM bars),
  t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS dn FROM p),
  l AS (SELECT *, {listed('tr')} AS lt, {listed('up')} AS lu, {listed('dn')} AS ld, {listed('close')} AS lc, list(tp) OVER {over(5)} AS w5 FROM t),
  e AS (SELECT *, {folded('lt', 0.2)} AS atr, {folded('lu', 0.2)} AS ru, {folded('ld', 0.2)} AS rd, {folded('lc', 2 / 6)} - {folded('lc', 2 / 11)} AS macd FROM l), f AS (SELECT *, {listed('macd')} AS lm FROM e)"""
add(
    "m15_technical_states", lambda s, d: M.technical(views.bars_mo(s, d)),
    f"""{_TECH} SELECT instrument, date, {r('tr', 'tr')}, {r('atr', 'atr')}, {r('CASE WHEN ru + rd > 1e-12 THEN 100 * ru / (ru + rd) END', 'rsi')},
    {r(f'CASE WHEN count(close) OVER {over(5)} >= 5 THEN 100 * (close - min(low) OVER {over(5)}) / (max(high) OVER {over(5)} - min(low) OVER {over(5)}) END', 'stochastic')},
    {r('CASE WHEN len(w5) >= 5 THEN (tp - list_avg(w5)) / (0.015 * list_avg(list_transform(w5, lambda x: abs(x - list_avg(w5))))) END', 'cci')}, {r(f"macd - {folded('lm', 0.5)}", 'macd')} FROM f""",
)
add("m16_days_since_change", lambda s, d: M.days_since_change(views.factor_panel(s, d).withColumn("state", F.when(F.col("ret") > 0, 1).otherwise(0)), "state").select("instrument", "date", "since"), f"""WITH {views.FACTOR_PANEL}, t AS (SELECT *, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS st FROM panel), c AS (SELECT *, coalesce(st <> lag(st) OVER w, true)::INT AS ch FROM t WINDOW w AS (PARTITION BY instrument ORDER BY date)), k AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY date) AS run FROM c)
  SELECT instrument, date, row_number() OVER (PARTITION BY instrument, run ORDER BY date) - 1 AS since FROM k""")
add("m17_named_signals", lambda s, d: M.technical(views.bars_mo(s, d)).select("instrument", "date", (F.col("rsi") > 70).cast("int").alias("overbought"), (F.col("rsi") < 30).cast("int").alias("oversold"), F.signum("macd").cast("int").alias("macd_side"), (F.abs("cci") > 100).cast("int").alias("breakout")), f"""{_TECH} SELECT instrument, date, (CASE WHEN ru + rd > 1e-12 THEN 100 * ru / (ru + rd) END > 70)::INT AS overbought, (CASE WHEN ru + rd > 1e-12 THEN 100 * ru / (ru + rd) END < 30)::INT AS oversold, sign(macd - {folded('lm', 0.5)})::INT AS macd_side,
  (abs(CASE WHEN len(w5) >= 5 THEN (tp - list_avg(w5)) / (0.015 * list_avg(list_transform(w5, lambda x: abs(x - list_avg(w5))))) END) > 100)::INT AS breakout FROM f""")
add(
    "m18_lagged_size_features", lambda s, d: M.lagged_size(views.factor_panel(s, d), "w", "volume", "quote_volume"),
    f"""WITH {views.FACTOR_PANEL}, z AS (SELECT instrument, day + 1 AS day, w AS size, volume / quote_volume AS turn, (rank() OVER (PARTITION BY date ORDER BY w) + (count(*) OVER (PARTITION BY date, w) - 1) / 2.0) / count(w) OVER (PARTITION BY date) AS size_rank,
    CASE WHEN count(w) OVER {over(20)} >= 20 AND stddev_samp(w) OVER {over(20)} > 1e-12 THEN (w - avg(w) OVER {over(20)}) / stddev_samp(w) OVER {over(20)} END AS size_z FROM panel)
    SELECT a.instrument, a.date, {r('size', 'size')}, {r('size_rank', 'size_rank')}, {r('size_z', 'size_z')}, {r('turn', 'turn')} FROM panel a LEFT JOIN z USING (instrument, day)""",
)

# tolerant operators: windows may be partial
_W = over(5)
panel("n01_rolling_partial", lambda: F.avg("rate").over(R.window(5)) + F.max("rate").over(R.window(5)) + F.min("rate").over(R.window(5)) + F.sum("rate").over(R.window(5)), f"avg(rate) OVER {_W} + max(rate) OVER {_W} + min(rate) OVER {_W} + sum(rate) OVER {_W}")
panel("n03_rolling_corr_partial", lambda: R.ts_corr("close", "volume", 5, 2), f"CASE WHEN count(close) OVER {_W} >= 2 AND stddev_samp(close) OVER {_W} * stddev_samp(volume) OVER {_W} > 1e-12 THEN covar_samp(close, volume) OVER {_W} / (stddev_samp(close) OVER {_W} * stddev_samp(volume) OVER {_W}) END")
_M = f"avg(close) OVER {_W}"
panel(
    "n04_rolling_skew_sample", lambda: R.full("close", 5, F.when(F.var_samp("close").over(R.window(5)) > 1e-10, (F.avg(F.pow("close", F.lit(3.0))).over(R.window(5)) - 3 * F.avg("close").over(R.window(5)) * F.avg(F.col("close") * F.col("close")).over(R.window(5)) + 2 * F.pow(F.avg("close").over(R.window(5)), F.lit(3.0))) / F.pow(F.stddev_samp("close").over(R.window(5)), F.lit(3.0))), 3),
    f"CASE WHEN count(close) OVER {_W} >= 3 AND var_samp(close) OVER {_W} > 1e-10 THEN (avg(pow(close, 3)) OVER {_W} - 3 * {_M} * avg(close * close) OVER {_W} + 2 * pow({_M}, 3)) / pow(stddev_samp(close) OVER {_W}, 3) END",
)
panel("n05_ts_rank_share_below", lambda: F.when(F.count("close").over(R.window(9)) >= 5, F.size(F.filter(R.values("close", 9), lambda y: y < F.col("close"))) / F.count("close").over(R.window(9))), "CASE WHEN len(a) >= 5 THEN len(list_filter(a, lambda y: y < close))::DOUBLE / len(a) END", f", s AS (SELECT *, list(close) OVER {over(9)} AS a FROM bars)", "s")
panel("n06_ts_ema_carried", lambda: F.col("v"), f"list_reduce(a, lambda s, y: s * {1 - 2 / 6!r} + y * {2 / 6!r})", f", s AS (SELECT *, {listed('rate')} AS a FROM bars)", "s", lambda b: R.recursive(b, v=("rate", 2 / 6)))
panel("n10_protected_division", lambda: F.when(F.abs(F.col("close") - F.col("open")) > 1e-8, F.greatest(F.least(F.col("volume") / F.when(F.abs(F.col("close") - F.col("open")) > 1e-8, F.col("close") - F.col("open")), F.lit(100.0)), F.lit(-100.0))).otherwise(1.0), "CASE WHEN abs(close - open) > 1e-8 THEN greatest(least(volume / (close - open), 100.0), -100.0) ELSE 1.0 END")
panel("n12_scalar_functions", lambda: F.greatest(F.col("close"), F.col("volume")) + F.least(F.col("open"), F.col("high")) + F.greatest(F.col("close") - 100, F.lit(0.0)) + F.tanh(F.col("close") / 100), "greatest(close, volume) + least(open, high) + greatest(close - 100, 0) + tanh(close / 100)")
add(
    "n14_daily_features",
    lambda s, d: (p := views.factor_panel(s, d)).select("instrument", "date", (F.col("open") / R.ref("close", 1) - 1).alias("gap"), F.avg((F.col("ret") > 0).cast("int")).over(Window.partitionBy("date")).alias("breadth"), F.avg("ret").over(Window.partitionBy("date")).alias("market")),
    f"WITH {views.FACTOR_PANEL} SELECT instrument, date, {r('open / max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1', 'gap')}, {r('avg((ret > 0)::INT) OVER (PARTITION BY date)', 'breadth')}, {r('avg(ret) OVER (PARTITION BY date)', 'market')} FROM panel",
)
# projections and filters
def _padded(s, d):
    """Bars on every day of the calendar; a day without trades repeats the last close, without volume."""
    b = views.bars_ev(s, d)
    p = P.calendar_spine(b).join(b.select("instrument", "date", "open", "high", "low", "close", "volume"), ["instrument", "date"], "left")
    last = F.last("close", ignorenulls=True).over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return p.select("instrument", "date", *[F.coalesce(c, last).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


add(
    "p05_placeholder_bars", lambda s, d: M.placeholders(_padded(s, d)).select("instrument", "date"),
    f"""WITH {views.BARS_EV}, spine AS (SELECT instrument, date FROM (SELECT DISTINCT instrument FROM bars), (SELECT unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY))::DATE AS date)),
    f AS (SELECT instrument, date, volume, open = high AND high = low AND low = close AS flat, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM spine LEFT JOIN bars USING (instrument, date))
    SELECT instrument, date FROM f WHERE c IS NOT NULL AND coalesce(volume, 0) = 0 AND coalesce(flat, true)""",
)
add("p08_symbol_exclusion", lambda s, d: views.read(s, d, "part").filter(~F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
add("p11_rebalance_grid", lambda s, d: views.bars_ev(s, d).filter("pmod(day + 1 - 19723, 7) = 0").select("instrument", "date"), f"WITH {views.BARS_EV} SELECT instrument, date FROM bars WHERE (day + 1 - 19723 + 700) % 7 = 0")
add("p12_liquidity_mask", lambda s, d: _liquid(views.bars_ev(s, d)), f"WITH {views.BARS_EV}, v AS (SELECT *, sum(volume) OVER {over(7)} AS v FROM bars) SELECT instrument, date FROM v QUALIFY count(*) OVER (PARTITION BY date) <= 10 OR v > quantile_cont(v, 0.1) OVER (PARTITION BY date)")
add("p09_rank_range", lambda s, d: views.bars_ev(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "instrument"))).filter("rank between 5 and 15").select("instrument", "date", "rank"), f"WITH {views.BARS_EV} SELECT instrument, date, row_number() OVER (PARTITION BY date ORDER BY volume DESC, instrument) AS rank FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, instrument) BETWEEN 5 AND 15")
add("p15_symbol_normalise", lambda s, d: views.read(s, d, "part").select("p_partkey", F.regexp_replace(F.upper(F.trim("p_brand")), "USDT$", "").alias("symbol")), "SELECT p_partkey, regexp_replace(upper(trim(p_brand)), 'USDT$', '') AS symbol FROM part")


def _liquid(bars):
    """Cells above the lowest tenth of the date's trailing week of volume; dates with few names keep all. The cut is the lower neighbour
    and a part of the step to the upper one, as in the SQL: `percentile` weighs both, and of neighbours a last bit apart leaves their range."""
    day = Window.partitionBy("date")
    b = bars.withColumn("v", F.sum("volume").over(R.window(7)))
    b = b.select("instrument", "date", "v", F.row_number().over(day.orderBy(F.asc_nulls_last("v"))).alias("k"), ((F.count("v").over(day) - 1) * 0.1).alias("at"), F.count("*").over(day).alias("n"))
    low, high = (F.max(F.when(F.col("k") - 1 == at, F.col("v"))).over(day) for at in (F.floor("at"), F.ceil("at")))
    b = b.withColumn("low", low).withColumn("high", high)
    return b.filter("n <= 10 or v > low + (high - low) * (at - floor(at))").select("instrument", "date")
