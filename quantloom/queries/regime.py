"""Regime, sizing and tolerant rolling operators, and their SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quantloom import views
from quantloom.operators import regime as G, tolerant as T
from quantloom.queries.common import add, over, panel, r
from quantloom.queries.daily import recursive

WK, BE, FL = views.BARS_WK, views.BARS_EV, views.FLOWS_EV


def wk(s, d):
    return views.bars_wk(s, d)


_RET = f"{WK}, x AS (SELECT *, close::DOUBLE / lag(close) OVER (PARTITION BY instrument ORDER BY day) - 1 AS ret, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM bars)"
_BETA = f"""{_RET}, base AS (SELECT day, ret AS b FROM x WHERE instrument = 0), j AS (SELECT x.instrument, x.date, x.day, CASE WHEN b IS NOT NULL THEN ret END AS a, CASE WHEN ret IS NOT NULL THEN b END AS b FROM x LEFT JOIN base USING (day) WHERE instrument <> 0),
  betas AS (SELECT * FROM (SELECT instrument, date, day, CASE WHEN count(a) OVER {over(60)} = 60 THEN covar_samp(a, b) OVER {over(60)} / var_samp(b) OVER {over(60)} END AS beta FROM j) WHERE beta IS NOT NULL)"""
add("b08_coin_betas", lambda s, d: G.betas(wk(s, d), 0).select("instrument", "date", "beta"), f"WITH {_BETA} SELECT instrument, date, {r('beta', 'beta')} FROM betas")


def _holdings(s, d):
    """Each week the instruments weighed by their traded volume, some not held."""
    b = wk(s, d).filter("(instrument + day) % 3 > 0")
    return b.select("date", "instrument", (F.col("quote_volume") / F.sum("quote_volume").over(Window.partitionBy("date"))).alias("weight"))


add(
    "b08_portfolio_beta",
    lambda s, d: G.portfolio_beta(_holdings(s, d), G.betas(wk(s, d), 0)),
    f"""WITH {_BETA}, h AS (SELECT date, instrument, quote_volume / sum(quote_volume) OVER (PARTITION BY date) AS weight FROM bars WHERE (instrument + day) % 3 > 0),
    k AS (SELECT h.date, h.weight, coalesce(b.beta, 1.3) AS beta FROM h ASOF LEFT JOIN betas b ON h.instrument = b.instrument AND h.date >= b.date)
    SELECT date, {r('CASE WHEN sum(weight) < 1e-12 THEN 1.3 ELSE sum(weight * beta) / sum(weight) END', 'beta')} FROM k GROUP BY date""",
)
_ROWS = "(PARTITION BY instrument ORDER BY k ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
_FULL = "CASE WHEN count(*) OVER {1} >= {2} THEN {0}(c) OVER {1} END"
_MEAN, _SD = _FULL.format("avg", _ROWS.format(199), 200), _FULL.format("stddev_samp", _ROWS.format(119), 120)
_TREND = f"""WITH RECURSIVE {WK}, t AS (SELECT instrument, date, day, close::DOUBLE AS c, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM bars),
  {recursive('e', 't', {'s': ('c', 2 / 51), 'l': ('c', 2 / 201)})},
  u AS (SELECT instrument, date, day, k, 0.5 * tanh(CASE WHEN k >= 200 THEN s / l - 1 END / 0.15) + 0.5 * tanh((c - {_MEAN}) / ({_SD}) / 2) AS raw FROM t JOIN e USING (instrument, k)),
  {recursive('f', 'u', {'m': ('raw', 2 / 6)})},
  trends AS (SELECT instrument, date, day, k, CASE WHEN count(raw) OVER {_ROWS.format('UNBOUNDED')} >= 5 THEN greatest(least(m, 1), -1) END AS trend FROM u JOIN f USING (instrument, k))"""
add("b09_trend_score", lambda s, d: G.trend_score(wk(s, d)).select("instrument", "date", "trend"), f"{_TREND} SELECT instrument, date, {r('trend', 'trend')} FROM trends")


def _sized(s, d):
    t = G.trend_score(wk(s, d)).withColumn("beta", 0.5 + F.col("instrument") / 10).withColumn("exposure", G.exposure("trend")).withColumn("hedge", G.hedge("trend", "beta")).withColumn("core", G.core_weight("trend"))
    return G.smoothed(t, "exposure", "smooth")


_EXP, _T = "(0.5 + 0.5 * (trend + 1) / 2)", "trend"
_SIZED = f"""{_TREND}, z AS (SELECT *, {_EXP} AS exposure, CASE WHEN trend IS NOT NULL THEN least(greatest((0.5 + instrument / 10.0) * {_EXP} * (1 - trend), 0), {_EXP} * 1.2) END AS hedge, greatest(least(0.4 + 0.3 * (coalesce(trend, -1) + 1) / 2, 0.7), 0.4) AS core FROM trends),
  {recursive('g', 'z', {'smooth': ('exposure', 0.05)})}"""
add(
    "b10_exposure_hedge_core",
    lambda s, d: _sized(s, d).select("instrument", "date", "exposure", "hedge", "core", "smooth"),
    f"{_SIZED} SELECT instrument, date, {r('exposure', 'exposure')}, {r('hedge', 'hedge')}, {r('core', 'core')}, {r('smooth', 'smooth')} FROM z JOIN g USING (instrument, k)",
)
add(
    "b13_hedge_costs",
    lambda s, d: G.hedge_costs(_sized(s, d).filter("hedge is not null"), "hedge").select("instrument", "date", (F.col("perp_fee") * 1000).alias("perp_fee"), (F.col("funding_cost") * 1000).alias("funding_cost")),
    f"""{_SIZED} SELECT instrument, date, {r('abs(hedge - coalesce(lag(hedge) OVER (PARTITION BY instrument ORDER BY k), 0)) * 0.0005 * 1000', 'perp_fee')}, {r('hedge * 0.1095 / 365 * 1000', 'funding_cost')}
    FROM z WHERE hedge IS NOT NULL""",
)
add(
    "b11_funding_allowed",
    lambda s, d: G.funding_allowed(views.bars_ev(s, d).select("date").distinct(), views.flows_ev(s, d).filter("kind = 'error'"), 10, 0.8),
    f"""WITH {BE}, {FL}, e AS (SELECT * FROM flows WHERE kind = 'error'), c AS (SELECT * FROM (SELECT DISTINCT instrument FROM e), (SELECT DISTINCT date FROM bars)),
    w AS (SELECT c.instrument, c.date, count(rate) AS n, quantile_cont(rate, 0.8) AS p, avg(rate) FILTER (WHERE e.date = c.date) AS own, arg_max(rate, (ts, event_id)) AS newest
          FROM c LEFT JOIN e ON e.instrument = c.instrument AND e.ts > c.date - INTERVAL 10 DAY AND e.ts < c.date + INTERVAL 1 DAY GROUP BY c.instrument, c.date)
    SELECT instrument, date, n >= 3 AND coalesce(own, newest) < p AS allowed, {r('CASE WHEN n >= 3 THEN p END', 'cut')}, {r('CASE WHEN n >= 3 THEN coalesce(own, newest) END', 'recent')}, n::INT AS n_events FROM w""",
)
add(
    "b12_squeeze_flags",
    lambda s, d: G.squeeze_flags(wk(s, d), 0.15, 1.5, 20),
    f"""WITH {_RET}, p AS (SELECT *, lag(volume) OVER (PARTITION BY instrument ORDER BY k) AS before FROM x),
    m AS (SELECT *, CASE WHEN count(before) OVER {_ROWS.format(19)} = 20 THEN avg(before) OVER {_ROWS.format(19)} END AS usual FROM p) SELECT instrument, date, coalesce(ret > 0.15 AND volume > 1.5 * usual, false) AS flag FROM m""",
)

# tolerant operators
_W, _N, _C = over(5), over(9), "count(close)"
panel("n01_rolling_std_partial", lambda: T.std("rate", 5), f"CASE WHEN count(rate) OVER {_W} >= 2 THEN stddev_samp(rate) OVER {_W} END")
_Z = f"((close - avg(close) OVER {_W}) / stddev_pop(close) OVER {_W})"
panel(
    "n02_rolling_rank_gaussian",
    lambda: T.gaussian_rank("close", 5),
    f"CASE WHEN var_pop(close) OVER {_W} <= 1e-12 THEN 1 ELSE 0.5 * (1 + tanh(0.7978845608028654 * ({_Z} + 0.044715 * pow({_Z}, 3)))) * (count(close) OVER {_W} - 1) + 1 END",
)
_P = "CASE WHEN rate IS NOT NULL THEN close END"
panel("n03_rolling_cov_partial", lambda: T.cov("close", "rate", 9), f"CASE WHEN count(rate) OVER {_N} >= 2 THEN covar_samp({_P}, rate) OVER {_N} END")
_VA, _VB = f"(var_pop({_P}) OVER {_N} * count(rate) OVER {_N})", f"(var_pop(rate) OVER {_N} * count(rate) OVER {_N})"
panel("n03_rolling_corr_pairs", lambda: T.corr("close", "rate", 9), f"CASE WHEN count(rate) OVER {_N} >= 2 AND {_VA} > 1e-10 AND {_VB} > 1e-10 THEN covar_pop({_P}, rate) OVER {_N} * count(rate) OVER {_N} / sqrt({_VA} * {_VB}) END")
_S5 = f", s AS (SELECT *, list(close) OVER {over(9)} AS a FROM bars), q AS (SELECT *, list_avg(a) AS mu, list_stddev_samp(a) AS sd FROM s)"
_MOMENT = "list_avg(list_transform(a, lambda y: pow(y - mu, {0})))"
panel("n04_rolling_skew_partial", lambda: T.skew("close", 9), f"CASE WHEN len(a) >= 3 AND sd > 1e-10 THEN {_MOMENT.format(3)} / pow(sd, 3) END", _S5, "q")
panel("n04_rolling_kurt_partial", lambda: T.kurt("close", 9), f"CASE WHEN len(a) >= 4 AND sd * sd > 1e-10 THEN {_MOMENT.format(4)} / pow(sd, 4) - 3 END", _S5, "q")
panel("n07_ts_information_ratio", lambda: T.information_ratio("close", 5), f"CASE WHEN stddev_samp(close) OVER {_W} > 1e-10 THEN greatest(least(avg(close) OVER {_W} / stddev_samp(close) OVER {_W}, 20), -20) END")
_BACK = "max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING)"
panel("n08_ts_return_clipped", lambda: T.change_ratio("close", 2), f"CASE WHEN abs({_BACK}) > 0.001 THEN greatest(least((close - {_BACK}) / (abs({_BACK}) + 0.001), 10), -10) ELSE 0 END")
panel("n08_ts_range", lambda: T.extent("rate", 5), f"max(rate) OVER {_W} - min(rate) OVER {_W}")
panel("n09_ordinal_rank", lambda: T.ordinal_rank("rate"), "CASE WHEN rate IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY rate NULLS LAST, instrument) / count(rate) OVER (PARTITION BY date) END")
panel("n09_scaled_to_total", lambda: T.scaled("rate", 2.0), "2 * rate / CASE WHEN sum(abs(rate)) OVER (PARTITION BY date) < 1e-10 THEN 1 ELSE sum(abs(rate)) OVER (PARTITION BY date) END")
