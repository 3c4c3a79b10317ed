"""Technical states and the nineteen daily signals over weekly bars, checked against SQL that is written row by row: recursive
means, the parabolic stop and the supertrend are recursive queries there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import views
from quantloom.operators import daily_signals as D
from quantloom.queries.common import add, r

IN = "PARTITION BY instrument ORDER BY k"
EPS = "1e-8"


def wk(s, d):
    """Weekly bars with prices in thousands."""
    return views.bars_wk(s, d).select("instrument", "date", "day", *[(F.col(c) / 1000).alias(c) for c in ("open", "high", "low", "close")])


def win(n: int, before: int = 0) -> str:
    return f"({IN} ROWS BETWEEN {n - 1 + before} PRECEDING AND {before or 'CURRENT'} {'PRECEDING' if before else 'ROW'})"


def agg(f: str, x: str, n: int, least: int | None = None, before: int = 0) -> str:
    return f"(CASE WHEN count({x}) OVER {win(n, before)} >= {max(2, n // 2) if least is None else least} THEN {f}({x}) OVER {win(n, before)} END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + {EPS}))"


def pos(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, 0) END)"


def clip(x: str, a: float, b: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {a}), {b}) END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({IN})"


def lag_own(x: str, n: int = 1) -> str:
    return f"(CASE WHEN k > {n} THEN {lag(x, n)} ELSE {x} END)"


def step(x: str) -> str:
    return f"(CASE WHEN k = 1 THEN 0 ELSE {x} - {lag(x)} END)"


def recursive(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """Recursive means of columns of `source`, row after row: name -> (column, weight)."""
    first = ", ".join(f"{x} AS {c}" for c, (x, _) in columns.items())
    rest = ", ".join(f"CASE WHEN m.{c} IS NULL THEN s.{x} ELSE coalesce(s.{x} * {w!r} + m.{c} * {1 - w!r}, m.{c}) END" for c, (x, w) in columns.items())
    return f"""{name} AS (SELECT instrument, k, {first} FROM {source} WHERE k = 1
      UNION ALL SELECT s.instrument, s.k, {rest} FROM {name} m JOIN {source} s ON s.instrument = m.instrument AND s.k = m.k + 1)"""


def span(x: str, n: int) -> tuple[str, float]:
    return x, 2 / (n + 1)


def rma(x: str, n: int) -> tuple[str, float]:
    return x, 1 / n


def wma(x: str, n: int) -> str:
    """Weights 1, 2, ... over the rows of the window."""
    start = f"greatest(k - {n}, 0)"
    top = f"(sum({x} * k) OVER {win(n)} - {start} * sum({x}) OVER {win(n)})"
    low = f"(sum(CASE WHEN {x} IS NOT NULL THEN k END) OVER {win(n)} - {start} * count({x}) OVER {win(n)})"
    return f"(CASE WHEN count({x}) OVER {win(n)} >= {max(2, n // 2)} AND {low} > {EPS} THEN {top} / {low} END)"


def side(above: str, below: str) -> str:
    return f"coalesce(last_value(CASE WHEN {above} THEN 1 WHEN {below} THEN -1 END IGNORE NULLS) OVER ({IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)"


def memory(trigger: str, keep: float) -> str:
    last = f"max(CASE WHEN {trigger} THEN k END) OVER ({IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"coalesce(pow({keep}, k - {last}), 0)"


def since(state: str) -> str:
    """Rows since a change that is marked in `state` by the row's number, or since the first row."""
    return f"(k - coalesce(max({state}) OVER ({IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1))"


BARS = f"""{views.BARS_WK}, n AS (
    SELECT instrument, date, day, open / 1000.0::DOUBLE AS open, high / 1000.0::DOUBLE AS high, low / 1000.0::DOUBLE AS low, close / 1000.0::DOUBLE AS close, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM bars
  ), t AS (
    SELECT *, greatest(high - low, abs(high - {lag_own('close')}), abs(low - {lag_own('close')})) AS tr, (high + low + close) / 3 AS tp,
           greatest({step('close')}, 0) AS gain, greatest(-{step('close')}, 0) AS loss
    FROM n
  )"""


def rsi(n: int) -> str:
    return clip(f"100 - 100 / (1 + {div(f'gain{n}', f'loss{n}')})", -100, 100)


def place(n: int) -> str:
    low, high = agg("min", "low", n), agg("max", "high", n)
    return clip(f"{div(f'close - {low}', f'{high} - {low}')} * 100", 0, 100)


def cci(n: int) -> str:
    return clip(f"(tp - tp{n}) / (0.015 * {agg('avg', f'off{n}', n)} + {EPS})", -1e4, 1e4)


# technical states (M15)
_TECHNICAL = f"""WITH RECURSIVE {BARS},
  {recursive('e', 't', {'atr': rma('tr', 14), 'atr_ema': span('tr', 14), 'gain14': rma('gain', 14), 'loss14': rma('loss', 14), 'fast': span('close', 12), 'slow': span('close', 26)})},
  u AS (SELECT *, fast - slow AS line, {place(25)} AS place25, {agg('avg', 'tp', 20)} AS tp20, 2 * {wma('close', 10)} - {wma('close', 20)} AS hull, {wma('close', 20)} AS wma20 FROM t JOIN e USING (instrument, k)),
  {recursive('f', 'u', {'signal': span('line', 9), 'k25': rma('place25', 3)})},
  v AS (SELECT *, abs(tp - tp20) AS off20 FROM u JOIN f USING (instrument, k))
  SELECT instrument, date, {r('tr', 'tr')}, {r('atr', 'atr')}, {r('atr_ema', 'atr_ema')}, {r(rsi(14), 'rsi')}, {r('k25', 'k')}, {r(cci(20), 'cci')}, {r('line - signal', 'macd')},
         {r('wma20', 'wma20')}, {r(wma('hull', 4), 'hma')} FROM v"""
add("m15_technical_weekly", lambda s, d: D.technical(wk(s, d)), _TECHNICAL)

# path-dependent states (M16)
_QQE = f"""c AS (SELECT *, {rsi(14)} - 50 AS centred FROM {{0}}),
  {recursive('q1', 'c', {'qqe_signal': span('centred', 5)})},
  {recursive('q2', 'q1', {'qqe_slow': span('qqe_signal', 14)})},
  qq AS (SELECT instrument, k, qqe_signal, qqe_signal - qqe_slow AS qqe_hist, CASE WHEN qqe_signal - qqe_slow <> 0 THEN sign(qqe_signal - qqe_slow) END AS s FROM q1 JOIN q2 USING (instrument, k)),
  qb AS (SELECT *, last_value(s IGNORE NULLS) OVER ({IN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM qq),
  qqe AS (SELECT instrument, k, qqe_signal, qqe_hist, least(count(*) FILTER (WHERE s <> b) OVER ({IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) / 3.0 AS qqe_progress FROM qb)"""
_STATES = f"""WITH RECURSIVE {BARS},
  {recursive('e', 't', {'atr10': rma('tr', 10), 'atr22': rma('tr', 22), 'ema10': span('close', 10), 'gain14': rma('gain', 14), 'loss14': rma('loss', 14)})},
  u AS (SELECT *, {agg('max', 'high', 22)} - 3 * atr22 AS long_stop, {agg('min', 'low', 22)} + 3 * atr22 AS short_stop, ema10 + 3 * atr10 AS up, ema10 - 3 * atr10 AS down, {agg('avg', 'tp', 18)} AS tp18 FROM t JOIN e USING (instrument, k)),
  {_QQE.format('u')},
  v AS (SELECT *, abs(tp - tp18) AS off18, lag(long_stop) OVER w AS l1, lag(short_stop) OVER w AS s1, lag(up) OVER w AS u1, lag(down) OVER w AS d1 FROM u JOIN qqe USING (instrument, k) WINDOW w AS ({IN})),
  x AS (SELECT *, {side('close > s1', 'close < l1')} AS ce_side, {side('close > u1', 'close < d1')} AS pmax_side, {cci(18)} AS cci18 FROM v),
  y AS (SELECT *, CASE WHEN pmax_side <> lag(pmax_side) OVER ({IN}) THEN k END AS turned FROM x)
  SELECT instrument, date, {r('long_stop', 'long_stop')}, {r('short_stop', 'short_stop')}, ce_side, pmax_side, {r('CASE WHEN pmax_side > 0 THEN down ELSE up END', 'pmax_line')}, {since('turned')} AS pmax_days,
         {r(memory('cci18 < -200', 0.95), 'oversold')}, {r('qqe_signal', 'qqe_signal')}, {r('qqe_hist', 'qqe_hist')}, {r('qqe_progress', 'qqe_progress')} FROM y"""
add("m16_states", lambda s, d: D.states(wk(s, d)), _STATES)
add("m16_chandelier", lambda s, d: D.states(wk(s, d)).select("instrument", "date", "long_stop", "short_stop", "ce_side"), f"SELECT instrument, date, long_stop, short_stop, ce_side FROM ({_STATES})")

#: The stop moves, is clamped, and is met or not by the row's prices.
_SAR = """sar AS (
    SELECT instrument, k, low AS sar, true AS up, 0.02::DOUBLE AS af, high AS ep, low AS l1, NULL::DOUBLE AS l2, high AS h1, NULL::DOUBLE AS h2 FROM t WHERE k = 1
    UNION ALL
    SELECT instrument, k, CASE WHEN turned THEN ep ELSE moved END, up <> turned,
           CASE WHEN turned THEN 0.02 WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END,
           CASE WHEN turned AND up THEN low WHEN turned THEN high WHEN up THEN greatest(high, ep) ELSE least(low, ep) END, low, l1, high, h1
    FROM (SELECT *, CASE WHEN up THEN low < moved ELSE high > moved END AS turned
          FROM (SELECT t.instrument, t.k, t.high, t.low, s.up, s.af, s.ep, s.l1, s.h1,
                       CASE WHEN s.l2 IS NULL THEN s.sar + s.af * (s.ep - s.sar) WHEN s.up THEN least(s.sar + s.af * (s.ep - s.sar), s.l1, s.l2)
                            ELSE greatest(s.sar + s.af * (s.ep - s.sar), s.h1, s.h2) END AS moved
                FROM sar s JOIN t ON t.instrument = s.instrument AND t.k = s.k + 1) m) z
  )"""
add("m16_parabolic_stop", lambda s, d: D.parabolic(wk(s, d)), f"WITH RECURSIVE {BARS}, {_SAR} SELECT instrument, date, {r('sar', 'sar')} FROM t JOIN sar USING (instrument, k)")


def _trend(atr: str, k: float) -> str:
    return f"""st AS (
    SELECT instrument, k, close, (high + low) / 2 + {k} * {atr} AS upper, (high + low) / 2 - {k} * {atr} AS lower, 1 AS side FROM e JOIN t USING (instrument, k) WHERE k = 1
    UNION ALL
    SELECT b.instrument, b.k, b.close, CASE WHEN b.mid + {k} * b.{atr} < s.upper OR s.close > s.upper THEN b.mid + {k} * b.{atr} ELSE s.upper END,
           CASE WHEN b.mid - {k} * b.{atr} > s.lower OR s.close < s.lower THEN b.mid - {k} * b.{atr} ELSE s.lower END,
           CASE WHEN b.close > s.upper THEN 1 WHEN b.close < s.lower THEN -1 ELSE s.side END
    FROM st s JOIN mids b ON b.instrument = s.instrument AND b.k = s.k + 1
  )"""


def _mids(atr: str) -> str:
    return f"mids AS (SELECT instrument, k, close, (high + low) / 2 AS mid, {atr} FROM t JOIN e USING (instrument, k))"


for _name, _n, _k in (("m16_supertrend", 10, 2.0), ("m16_supertrend_wide", 100, 5.5)):
    add(
        _name,
        lambda s, d, n=_n, k=_k: D.supertrend(wk(s, d), n, k),
        f"WITH RECURSIVE {BARS}, {recursive('e', 't', {'atr': rma('tr', _n)})}, {_mids('atr')}, {_trend('atr', _k)} SELECT instrument, date, side, {r('upper', 'upper')}, {r('lower', 'lower')} FROM t JOIN st USING (instrument, k)",
    )

# the nineteen signals (M17)
_E1 = {
    **{f"atr{n}": rma("tr", n) for n in (6, 9, 10, 14, 22, 50, 100)},
    **{f"gain{n}": rma("gain", n) for n in (14, 25, 100)},
    **{f"loss{n}": rma("loss", n) for n in (14, 25, 100)},
    **{f"ema{n}": span("close", n) for n in (10, 12, 20, 26, 50, 200)},
    "tpe": span("tp", 20),
    "tr20": span("tr", 20),
    "tr50": span("tr", 50),
}
_OFF = ", ".join(f"abs(tp - tp{n}) AS off{n}" for n in (18, 20, 54))
_STAGES = f"""WITH RECURSIVE {BARS},
  {recursive('e', 't', _E1)},
  u AS (SELECT *, ema12 - ema26 AS line, {place(25)} AS place25, {place(40)} AS place40, {agg('avg', 'tp', 18)} AS tp18, {agg('avg', 'tp', 20)} AS tp20, {agg('avg', 'tp', 54)} AS tp54,
               2 * {wma('close', 10)} - {wma('close', 20)} AS hull, {agg('avg', 'close', 20)} AS mid, {agg('stddev_pop', 'close', 20)} AS sd, {agg('avg', 'close', 25)} AS mid25, {agg('stddev_pop', 'close', 25)} AS sd25,
               {rsi(25)} AS rsi25, {rsi(100)} AS rsi100, {agg('max', 'high', 22)} - 3 * atr22 AS long_stop, {agg('min', 'low', 22)} + 3 * atr22 AS short_stop, ema10 + 3 * atr10 AS up, ema10 - 3 * atr10 AS down,
               2 * tp - low AS ph, 2 * tp - high AS pl, CASE WHEN {agg('avg', 'close', 2, 1)} >= {agg('avg', 'close', 30)} THEN 1 ELSE -1 END AS ma_side, {div('close - ema200', 'ema200')} AS dev200
        FROM t JOIN e USING (instrument, k)),
  {recursive('f', 'u', {'signal': span('line', 9), 'k25': rma('place25', 3), 'k40': rma('place40', 3), 'gc': span('tpe', 20), 'gcw': span('tr20', 20)})},
  {_QQE.format('u')}, {_SAR}, {_mids('atr100')}, {_trend('atr100', 5.5)},
  v AS (SELECT u.*, f.* EXCLUDE (instrument, k), qqe.* EXCLUDE (instrument, k), sar.sar, st.side AS st_side, line - signal AS macd, {_OFF}
        FROM u JOIN f USING (instrument, k) JOIN qqe USING (instrument, k) JOIN sar USING (instrument, k) JOIN st USING (instrument, k)),
  w1 AS (SELECT *, {wma('hull', 4)} AS hma, {cci(18)} AS cci18, {cci(20)} AS cci20, {cci(54)} AS cci54, lag(long_stop) OVER g AS l1, lag(short_stop) OVER g AS s1, lag(up) OVER g AS u1, lag(down) OVER g AS d1 FROM v WINDOW g AS ({IN})),
  w2 AS (SELECT *, {side('close > s1', 'close < l1')} AS ce, {side('close > u1', 'close < d1')} AS pm, {div(f'hma - {lag_own("hma")}', 'atr14')} AS slope, {div('close - hma', 'sd')} AS dev,
               (lag_cci > 200 AND cci20 <= 200) OR (lag_cci < -200 AND cci20 >= -200) AS regress, {step('macd')} AS macd_step, {step('cci20')} AS cci_step, {step('gc')} AS gc_step,
               CASE WHEN ma_side <> lag(ma_side) OVER ({IN}) THEN k END AS ma_turn, close - open AS body, {agg('max', 'ph', 23, None, 1)} AS ph23, {agg('min', 'pl', 23, None, 1)} AS pl23
         FROM (SELECT *, {lag_own('cci20')} AS lag_cci FROM w1)),
  w3 AS (SELECT *, CASE WHEN pm > 0 THEN down ELSE up END AS pmax_line, {pos(div('close - (mid + 0.8 * sd)', 'atr14'))} * {pos('slope')} AS le, {pos(div('(mid - 0.8 * sd) - close', 'atr14'))} * {pos('-slope')} AS se,
               {pos(div('close - ph23', 'atr14'))} AS lb, {pos(div('pl23 - close', 'atr14'))} AS sb, sign({lag('dev')}) AS before, CASE WHEN k > 1 THEN {div('close', lag('close'))} - 1 END AS ret, {since('ma_turn')} AS ma_days
         FROM w2),
  w4 AS (SELECT *, le - se AS net, {clip(f"(count(*) FILTER (WHERE le > 0) OVER {win(10)} - count(*) FILTER (WHERE se > 0) OVER {win(10)}) / 10.0", -1, 1)} AS piled, coalesce(before <> 0 AND sign(ret) = before, false)::INT AS hit FROM w3)"""
_SQUEEZE = f"((1 - {div('4 * sd', '3 * tr20')}) * ({clip(div('close - (mid - 2 * sd)', '4 * sd'), 0, 1)} - 0.5))"
_V2 = "(ce * (rsi25 - rsi100) * abs((rsi25 - 50) / 50.0))"
_IU, _ID, _OU, _OD = ("(ema50 + 2.75 * tr50)", "(ema50 - 2.75 * tr50)", "(ema50 + 3.75 * tr50)", "(ema50 - 3.75 * tr50)")
_V3 = f"""(CASE WHEN close < {_OD} THEN -2 - {clip(div(f'{_OD} - close', 'tr50'), 0, 1)} WHEN close <= {_ID} AND close >= {_OD} THEN -2 + {div(f'close - {_OD}', f'{_ID} - {_OD}')}
  WHEN close > {_OU} THEN 2 + {clip(div(f'close - {_OU}', 'tr50'), 0, 1)} WHEN close >= {_IU} AND close <= {_OU} THEN 1 + {div(f'close - {_IU}', f'{_OU} - {_IU}')}
  ELSE {clip(div('close - ema50', '2.75 * tr50'), -1, 1)} END)"""
_MOM, _FAR = f"({div('macd', 'close')} * 1000)", div("close - sar", "atr14")
_AGREE = f"(((sign({_MOM}) = sign(dev200))::INT + (sign({_FAR}) = sign(dev200))::INT + (sign(dev200) <> 0)::INT) / 3.0)"
_V9 = f"(piled * abs(net) * {pos('sign(net) * sign(piled)')})"
_B1, _B2, _C1, _C2 = lag_own("body"), lag_own("body", 2), lag_own("close"), lag_own("close", 2)
_FORCE = f"(abs({div('close - gc', '2 * gcw')}) + abs({div('macd_step', 'close')} * 1000) + abs(cci_step / 100))"
_AWAY = div("close - pmax_line", "atr14")
_OCC = f"avg(sign(body)) OVER {win(3)}"
_SOLDIERS = div(f"abs(body) + abs({_B1}) + abs({_B2})", "atr14")
_SQL = {
    "S1": f"{_SQUEEZE} * (k40 - 50)",
    "S2": div("close - ph23", "atr9"),
    "V1": f"{_SQUEEZE} * CASE WHEN k25 > 80 THEN k25 - 80 WHEN k25 < 20 THEN k25 - 20 ELSE 0 END",
    "V2_base": _V2,
    "V2_opt": f"{_V2} * (1 + CASE WHEN ce > 0 THEN {pos(agg('max', 'rsi25', 20) + ' - 70')} / 30.0 ELSE {pos('30 - ' + agg('min', 'rsi25', 20))} / 30.0 END)",
    "V3_base": _V3,
    "V3_opt": f"{_V3} * {div('ema20 - ema50', 'tr50')}",
    "V4_base": f"sign(dev200) * (abs(dev200) + abs({_MOM}) + abs({_FAR})) * {_AGREE}",
    "V5_base": f"sign(gc_step) * sign(macd_step) * sign(cci20) * {_FORCE} / 3.0 * (1 + least(count(*) FILTER (WHERE regress) OVER {win(20)}, 3) * 0.33)",
    "V6_base": f"({memory('cci18 < -200', 0.95)} * {pos('cci18 - cci54')} - {memory('cci18 > 200', 0.95)} * {pos('cci54 - cci18')}) * (1 + abs({div('close - mid', 'atr6')}) * 0.3) / 100.0",
    "V7_base": f"((close >= ema200 AND st_side > 0)::INT * {pos('qqe_hist')} - (close < ema200 AND st_side < 0)::INT * {pos('-qqe_hist')}) * abs(qqe_signal) * (1 - qqe_progress) * 0.01",
    "V8_base": f"""((body > 0 AND {_B1} > 0 AND {_B2} > 0 AND close > {_C1} AND {_C1} > {_C2} AND close > ema200 AND pmax_line > ema200)::INT * {pos(_AWAY)} * {pos(_OCC)}
      - (body < 0 AND {_B1} < 0 AND {_B2} < 0 AND close < {_C1} AND {_C1} < {_C2} AND close < ema200 AND pmax_line < ema200)::INT * {pos(f'-{_AWAY}')} * {pos(f'-({_OCC})')}) * {_SOLDIERS} * (1 + abs(dev200))""",
    "V9_base": _V9,
    "V9_opt": f"{_V9} * (1 + 0.5 * sign({_V9}) * sign(close - ema200))",
    "V10_base": f"""{pos('slope')} * CASE WHEN least(open, close) > hma THEN 1 WHEN greatest(open, close) > hma THEN 0.3 ELSE 0 END * (close > ema200)::INT * {pos('k25 - 50')} / 50.0
      - {pos('-slope')} * CASE WHEN greatest(open, close) < hma THEN 1 WHEN least(open, close) < hma THEN 0.3 ELSE 0 END * (close < ema200)::INT * {pos('50 - k25')} / 50.0""",
    "V11_base": f"""sign(dev) * least(abs(dev), 3) * CASE WHEN avg(hit) OVER {win(6)} >= 0.5 THEN 1 WHEN (dev > 0 AND close > {agg('max', 'high', 6, None, 1)}) OR (dev < 0 AND close < {agg('min', 'low', 6, None, 1)}) THEN 0.5 ELSE 0 END
      * CASE isodow(date) WHEN 7 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END * (1 - 0.5 * {clip(div('abs(dev)', f'max(abs(dev)) OVER {win(20)}'), 0, 1)})""",
    "V12_base": f"""(lb - sb) * (0.5 + {pos(div('atr14 - atr50', 'atr50'))}) * {pos('sign(lb - sb) * ((ema20 > ema50 AND ema50 > ema200)::INT - (ema20 < ema50 AND ema50 < ema200)::INT)')}
      * {clip(f"1 + {div(f'atr14 - {lag_own("atr14")}', 'atr14')} * 0.5", 0.5, 2)}""",
    "V13_base": f"""coalesce(close > mid25 + 2.5 * sd25 AND {div('5 * sd25', 'mid25')} > 0.01, false)::INT * {pos(div('close - mid25', 'atr14'))} * {clip(div('mid25 + 3.75 * sd25 - close', '3 * atr14'), 0, 1)}
      - coalesce(close < mid25 - 2.5 * sd25 AND {div('5 * sd25', 'mid25')} > 0.01, false)::INT * {pos('-' + div('close - mid25', 'atr14'))} * {clip(div('close - mid25 + 3.75 * sd25', '3 * atr14'), 0, 1)}""",
    "V14_base": f"""coalesce(ma_side < 0 AND close > {agg('max', 'high', 16, None, 1)} AND ma_turn IS NULL, false)::INT * {clip('lb', 0, 2)} * least(ma_days / 5.0, 1)
      - coalesce(ma_side > 0 AND close < {agg('min', 'low', 16, None, 1)} AND ma_turn IS NULL, false)::INT * {clip('sb', 0, 2)} * least(ma_days / 5.0, 1)""",
}
add("m17_daily_signals", lambda s, d: D.signals(_traded(s, d)), f"{_STAGES} SELECT instrument, date, {', '.join(r(clip(e, -1e6, 1e6), name) for name, e in _SQL.items())} FROM w4".replace("SELECT instrument, date, day, open /", "SELECT instrument, date + (day % 7)::INT AS date, day, open /"))


def _traded(s, d):
    """Weekly bars, dated within their week, so that weekdays differ."""
    return wk(s, d).withColumn("date", F.date_add("date", F.pmod("day", F.lit(7)).cast("int")))
