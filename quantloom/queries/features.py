"""Feature builders and their SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quantloom import views
from quantloom.operators import features as X
from quantloom.queries.common import add, over, r
from quantloom.queries.daily import recursive
from quantloom.queries.evaluation import FP, fp

EPS = "1e-8"


def div(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + {EPS}))"


def columns(e: dict[str, str]) -> str:
    return ",\n    ".join(r(x, n) for n, x in e.items())


# minutes: prices around each event's value
def _minutes(s, d):
    e = views.read(s, d, "events")
    k = F.col("event_id")
    m = e.select(F.pmod("user_id", F.lit(40)).alias("instrument"), F.to_date("ts").alias("date"), "ts", k.alias("seq"), F.col("value").alias("open"), (F.col("value") * (1 + (k % 7 - 3) / 100)).alias("close"), (k % 97 + 1).cast("double").alias("volume"), k)
    hi, lo = F.greatest("open", "close") * (1 + k % 5 / 100), F.least("open", "close") * (1 - k % 3 / 100)
    return m.select("instrument", "date", "ts", "seq", "open", hi.alias("high"), lo.alias("low"), "close", "volume")


_P, _T = "PARTITION BY instrument, date", "(PARTITION BY instrument, date ORDER BY ts, seq)"
_MIN = {
    "returns": "ret",
    "log_volume": "ln(volume + 1)",
    "spread": "high - low",
    "mid": "(high + low) / 2",
    "typical": "(high + low + close) / 3",
    "body": "abs(close - open)",
    "upper_shadow": "high - greatest(open, close)",
    "lower_shadow": "least(open, close) - low",
    "range_pct": div("high - low", "open"),
    "return_abs": "abs(ret)",
    "volume_intensity": "intensity",
    "up_volume_pressure": "greatest(ret, 0) * intensity",
    "down_volume_pressure": "greatest(-ret, 0) * intensity",
    "cum_return": f"product(1 + ret) OVER {_T}",
    "close_position": div("close - low", "high - low"),
    "money_flow": "(high + low + close) / 3 * volume",
}
add(
    "m09_minute_indicator_set",
    lambda s, d: X.minute_indicators(_minutes(s, d)).select("seq", *X.MINUTE),
    f"""WITH m AS (SELECT user_id % 40 AS instrument, ts::DATE AS date, ts, event_id AS seq, value AS open, value * (1 + (event_id % 7 - 3) / 100.0::DOUBLE) AS close, (event_id % 97 + 1)::DOUBLE AS volume FROM events),
    n AS (SELECT *, greatest(open, close) * (1 + seq % 5 / 100.0::DOUBLE) AS high, least(open, close) * (1 - seq % 3 / 100.0::DOUBLE) AS low FROM m),
    q AS (SELECT *, greatest(least(CASE WHEN row_number() OVER {_T} = 1 THEN 0 ELSE {div('close', f'lag(close) OVER {_T}')} - 1 END, 5), -0.5) AS ret, {div('volume', f'avg(volume) OVER ({_P})')} AS intensity FROM n)
    SELECT seq, {columns(_MIN)} FROM q""",
)

# temporal compositions of funding over twelve weeks
N = 12
_W = over(N)
_BACK = "max(x) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {0} PRECEDING AND {0} PRECEDING)"
_B, _BB = _BACK.format(N), _BACK.format(2 * N)


def whole(e: str, test: str = "true") -> str:
    return f"CASE WHEN age >= {N - 1} AND {test} THEN {e} END"


_MAD = f"(1.4826 * list_median(list_transform(xs, lambda y: abs(y - list_median(xs)))))"
_TEMPORAL = {
    "delta": f"x - {_B}",
    "pct_change": f"CASE WHEN abs({_B}) > {EPS} THEN x / {_B} - 1 END",
    "zscore": whole(f"(x - avg(x) OVER {_W}) / (stddev_pop(x) OVER {_W} + {EPS})"),
    "rank": whole("len(list_filter(xs, lambda y: y <= x)) / len(xs)", "len(xs) >= 3"),
    "accel": f"(x - {_B}) - ({_B} - {_BB})",
    "decay": "decay",
    "ewm_residual": "x - decay",
    "fast_slow_diff": "fast - decay",
    "tstat": whole(f"avg(x) OVER {_W} / (stddev_pop(x) OVER {_W} / sqrt(len(xs)) + {EPS})", "len(xs) >= 3"),
    "robust_zscore": whole(f"(x - list_median(xs)) / CASE WHEN {_MAD} < {EPS} THEN 1 ELSE {_MAD} END"),
    "persistence_ratio": whole("greatest(len(list_filter(xs, lambda y: y > 0)), len(list_filter(xs, lambda y: y < 0))) / len(xs)"),
    "event_count": whole("len(list_filter(xs, lambda y: abs(y) > 1)) / len(xs)"),
    "drawup": whole(f"x - min(x) OVER {_W}"),
    "drawdown": whole(f"max(x) OVER {_W} - x"),
    "half_life_decay": "half",
}
add(
    "m14_temporal_compositions",
    lambda s, d: X.temporal(views.bars_wk(s, d).withColumn("v", F.col("funding") * 100), "v", N),
    f"""WITH RECURSIVE {views.BARS_WK}, t AS (SELECT instrument, date, day, funding * 100 AS x, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k, day - min(day) OVER (PARTITION BY instrument) AS age FROM bars),
    {recursive('e', 't', {'decay': ('x', 2 / (N + 1)), 'fast': ('x', 2 / 5), 'half': ('x', 1 - 0.5 ** (1 / N))})}, u AS (SELECT *, list(x) OVER {_W} AS xs FROM t JOIN e USING (instrument, k))
    SELECT instrument, date, {columns(_TEMPORAL)} FROM u""",
)

# the daily feature set, over weeks
def _featured(s, d):
    b = views.bars_wk(s, d)
    return X.daily_features(b.withColumn("amount", F.col("quote_volume")).withColumn("turnover", F.col("volume") / F.col("trade_count")))


def part(f: str, x: str, n: int, least: int) -> str:
    return f"(CASE WHEN count({x}) OVER {over(n)} >= {least} THEN {f}({x}) OVER {over(n)} END)"


def roc(x: str, n: int) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN {x} / max({x}) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING) - 1 END)"


def wide(f: str, x: str, n: int, least: int) -> str:
    """A window over the market's days."""
    w = f"(ORDER BY day RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {w} >= {least} THEN {f}({x}) OVER {w} END)"


_DAILY = {
    "returns": "ret",
    "intraday_range": div("high - low", "close"),
    "gap": "open / max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1",
    "close_position": div("close - low", "high - low"),
    "upper_shadow": div("high - greatest(open, close)", "close"),
    "lower_shadow": div("least(open, close) - low", "close"),
    "volume_ratio": div("volume", part("avg", "volume", 20, 5)),
    "turnover": "turnover",
    "ret_10d": roc("close", 10),
    "ret_20d": roc("close", 20),
    "vol_ratio_10d": div("volume", part("avg", "volume", 10, 3)),
    "realized_vol": "rv",
    "vol_regime": div("rv", part("avg", "rv", 60, 20)),
    "mkt_trend_20d": "mt",
    "mkt_vol_20d": "mv",
    "mkt_amt_ratio": "ma",
    "mkt_breadth": "mb",
    "mkt_vol_regime": "mr",
    "beta_20d": f"CASE WHEN count(ret) OVER {over(20)} >= 10 THEN covar_samp(ret, CASE WHEN ret IS NOT NULL THEN mkt END) OVER {over(20)} END / (var + {EPS})",
    "turnover_stability": div(part("avg", "turnover", 20, 5), part("stddev_samp", "turnover", 20, 5)),
    "trend_strength": div(f"close - {part('min', 'low', 20, 5)}", f"{part('max', 'high', 20, 5)} - {part('min', 'low', 20, 5)}"),
    "price_acceleration": "r5 - max(r5) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING)",
    "downside_vol": part("stddev_samp", "down", 20, 5),
}
add(
    "n14_daily_feature_set",
    _featured,
    f"""WITH {views.BARS_WK}, t AS (SELECT instrument, date, day, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume::DOUBLE AS volume, quote_volume AS amount, volume / trade_count AS turnover FROM bars),
    a AS (SELECT *, {roc('close', 1)} AS ret, {roc('close', 5)} AS r5 FROM t), b AS (SELECT *, {part('stddev_samp', 'ret', 20, 5)} AS rv, CASE WHEN ret IS NOT NULL THEN least(ret, 0) END AS down FROM a),
    d AS (SELECT day, avg(ret) AS mkt, avg(rv) AS mv, sum(amount) AS amt, count(*) FILTER (WHERE ret > 0) / (count(ret) + {EPS}) AS br FROM b GROUP BY day),
    e AS (SELECT *, {wide('sum', 'mkt', 20, 5)} AS mt, {div('amt', wide('avg', 'amt', 20, 5))} AS ma, {wide('avg', 'br', 5, 2)} AS mb, {div('mv', wide('avg', 'mv', 60, 20))} AS mr, {wide('var_samp', 'mkt', 20, 10)} AS var FROM d), m AS (SELECT * FROM b JOIN e USING (day))
    SELECT instrument, date, {columns(_DAILY)} FROM m""",
)

# neutral residuals
_SLOPE = "covar_pop(s, held) OVER d * count(s) OVER d / (var_pop(s) OVER d * count(s) OVER d + 1e-10)"


def _regressed(name: str, source: str, size: str) -> str:
    return f"""{name}_a AS (SELECT *, CASE WHEN v IS NOT NULL AND {size} IS NOT NULL THEN ln(greatest({size}::DOUBLE, 1e-10)) END AS s, CASE WHEN {size} IS NOT NULL THEN v END AS held FROM {source}),
    {name} AS (SELECT * EXCLUDE (s, held, v), CASE WHEN s IS NOT NULL AND count(s) OVER d >= 3 THEN v - {_SLOPE} * (s - avg(s) OVER d) ELSE v END AS v FROM {name}_a WINDOW d AS (PARTITION BY date))"""


add(
    "n15_neutral_residual",
    lambda s, d: X.neutralized(fp(s, d).withColumn("v", F.col("x").cast("double")), "v", "eligible", "sector", "volume", "quote_volume").select("instrument", "date", "v"),
    f"""WITH {FP}, u AS (SELECT *, CASE WHEN eligible THEN x END AS v0 FROM panel), z AS (SELECT * EXCLUDE (v0), v0 - avg(v0) OVER (PARTITION BY date, sector) AS v FROM u), {_regressed('one', 'z', 'volume')}, {_regressed('two', 'one', 'quote_volume')}
    SELECT instrument, date, {r('v', 'v')} FROM two""",
)
add(
    "n15_winsorized_inputs",
    lambda s, d: fp(s, d).select("instrument", "date", X.winsorized_zscore("quote_volume", 0.05, True).alias("v")),
    f"""WITH {FP}, l AS (SELECT *, ln(1 + quote_volume) AS q FROM panel), c AS (SELECT instrument, date, least(greatest(q, quantile_cont(q, 0.05) OVER d), quantile_cont(q, 0.95) OVER d) AS c FROM l WINDOW d AS (PARTITION BY date))
    SELECT instrument, date, {r('(c - avg(c) OVER d) / (nullif(stddev_samp(c) OVER d, 0) + 1e-9)', 'v')} FROM c WINDOW d AS (PARTITION BY date)""",
)

# cross-period features, over weeks
def _crossed(s, d):
    b = views.bars_wk(s, d)
    ret = F.col("close") / F.max("close").over(_day_before()) - 1
    p = b.select("instrument", "date", "day", ret.alias("ret"), F.col("volume").cast("double").alias("volume"), F.col("quote_volume").alias("turnover"), "funding", F.col("open_interest").alias("oi"), (F.col("open_interest") * (1 + F.pmod("instrument", F.lit(5)) / 100)).alias("oi_start"), (F.col("trade_count") >= 5).alias("tradable"))
    return X.cross_period_features(p, 0)


def _day_before():
    return Window.partitionBy("instrument").orderBy("day").rangeBetween(-1, -1)


def z(x: str, n: int, least: int) -> str:
    return f"({x} - {part('avg', x, n, least)}) / ({part('stddev_pop', x, n, least)} + 1e-12)"


_REF = "max({0}) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {1} PRECEDING AND {1} PRECEDING)"
_SHARE = f"count(*) FILTER (WHERE side = {{0}}) OVER {over(20)} / (count(funding) OVER {over(20)} + 1e-12)"
_N60, _N20 = over(60), over(20)
_CROSS = {
    "funding_z20": z("funding", 20, 8),
    "funding_ma_diff_3_30": f"{part('avg', 'funding', 3, 2)} - {part('avg', 'funding', 30, 10)}",
    "funding_vol_30d": part("stddev_pop", "funding", 30, 10),
    "funding_persistence_20d": f"CASE WHEN side > 0 THEN {_SHARE.format(1)} WHEN side < 0 THEN -({_SHARE.format(-1)}) END",
    "oi_z20": z("loi", 20, 8),
    "oi_change_5d": "oc5",
    "oi_change_decay_20d": "decay",
    "funding_oi_joint_5d": "side * oc5",
    "beta_btc_60d": "beta",
    "corr_btc_20d": "cor",
    "resid_return_btc_20d": part("sum", "lft", 20, 8),
    "idio_vol_btc_20d": part("stddev_pop", "lft", 20, 8),
    "relative_strength_btc_5d": f"{part('sum', 'ret', 5, 3)} - {part('sum', 'base', 5, 3)}",
    "amihud_illiq": "abs(ret) / (CASE WHEN turnover > 0 THEN turnover END + 1e-12) * 1e6",
    "dollar_volume_rank": "CASE WHEN ok AND count(*) OVER (PARTITION BY date, ok) > 1 THEN (row_number() OVER (PARTITION BY date, ok ORDER BY dollar, instrument) - 1) / (count(*) OVER (PARTITION BY date, ok) - 1) END",
    "volume_zscore_60d": z("lv", 60, 20),
    "rv_5d": "rv5",
    "rv_20d": "rv20",
    "rv_ratio_5_20": "rv5 / (rv20 + 1e-12)",
    "vol_of_vol_20d": part("stddev_pop", "rv5", 20, 8),
}
add(
    "m11_cross_period_feature_set",
    _crossed,
    f"""WITH RECURSIVE {views.BARS_WK}, t AS (SELECT instrument, date, day, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k, close / {_REF.format('close', 1)} - 1 AS ret, volume, quote_volume AS turnover, funding, open_interest AS oi,
      open_interest * (1 + instrument % 5 / 100.0::DOUBLE) AS os, trade_count >= 5 AS tradable, sign(funding) AS side FROM bars),
    a AS (SELECT t.*, b.ret AS base, least(greatest(oi / (os + 1e-12) - 1, -0.95), 10) AS od, ln(CASE WHEN oi > 0 THEN oi END) AS loi, ln(1 + volume) AS lv FROM t LEFT JOIN (SELECT day, ret FROM t WHERE instrument = 0) b USING (day)),
    {recursive('e', 'a', {'decay': ('od', 2 / 21)})},
    c AS (SELECT *, CASE WHEN base IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN base END AS y, CASE WHEN oi > 0 AND {_REF.format('oi', 5)} > 0 THEN least(greatest(oi / ({_REF.format('oi', 5)} + 1e-12) - 1, -0.95), 10) END AS oc5,
      {part('stddev_pop', 'ret', 5, 3)} AS rv5, {part('stddev_pop', 'ret', 20, 8)} AS rv20, {_REF.format('turnover', 1)} AS tb FROM a JOIN e USING (instrument, k)),
    g AS (SELECT *, CASE WHEN count(x) OVER {_N60} >= 20 THEN covar_pop(x, y) OVER {_N60} / (var_pop(y) OVER {_N60} + 1e-12) END AS beta,
      CASE WHEN count(x) OVER {_N20} >= 8 THEN greatest(least(covar_pop(x, y) OVER {_N20} / (sqrt(var_pop(x) OVER {_N20} * var_pop(y) OVER {_N20}) + 1e-12), 1), -1) END AS cor, {part('avg', 'tb', 30, 1)} AS usual FROM c),
    h AS (SELECT *, ret - beta * base AS lft, ln(1 + CASE WHEN usual > 0 THEN usual END) AS dollar, tradable AND coalesce(usual > 0, false) AS ok FROM g)
    SELECT instrument, date, {columns(_CROSS)} FROM h""",
)
