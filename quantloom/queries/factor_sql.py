"""SQL of some factors written by hand from their definitions; it replaces the SQL that comes from the formula's own tree."""

from __future__ import annotations

import math

from quantloom import views
from quantloom.queries import factors  # noqa: F401  (whose SQL is replaced)
from quantloom.queries.common import SQL, counted, over, r
from quantloom.queries.daily import recursive

PAST = "(PARTITION BY instrument ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BARS = f"{views.BARS_WK}, b AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM bars)"


def back(x: str, n: int) -> str:
    return f"max({x}) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"


def full(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) OVER {over(n)} >= {n if least is None else least} THEN {f}({x}) OVER {over(n)} END)"


def rank(x: str) -> str:
    v = f"round({x}, 9)"
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {v}) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END)"


def by_hand(name: str, stages: str, value: str, table: str) -> None:
    SQL[f"factor_{name}"] = counted(f"WITH RECURSIVE {BARS}, {stages} SELECT instrument, date, {r(value)} FROM {table}")


_NC = f"n AS (SELECT *, close / (avg(close) OVER {over(20)}) AS nc, low / (avg(close) OVER {over(20)}) AS nl FROM b), m AS (SELECT *, nc / {back('nc', 1)} - 1 AS nret FROM n)"
_DECAY = f"(CASE WHEN count(q) OVER {over(10)} >= 10 THEN (sum(q * day) OVER {over(10)} - (day - 10) * sum(q) OVER {over(10)}) / 55.0 END)"
by_hand(
    "alpha_039",
    f"""{_NC}, o AS (SELECT *, volume / {full('avg', 'volume', 10)} AS q, nc - {back('nc', 10)} AS moved, {full('sum', 'nret', 90)} AS gone FROM m), p AS (SELECT *, {_DECAY} AS decayed FROM o),
    s AS (SELECT *, moved * (1 - {rank('decayed')}) AS inside, {rank('gone')} AS far FROM p), t AS (SELECT *, {rank('inside')} AS near FROM s)""",
    "-near * (1 + far)",
    "t",
)
_LIST = f"list(volume) OVER {over(14)}"
by_hand(
    "alpha_052",
    f"""{_NC}, o AS (SELECT *, {full('min', 'nl', 7)} AS low7, {full('sum', 'nret', 140)} - {full('sum', 'nret', 21)} AS far, {_LIST} AS vs FROM m),
    p AS (SELECT *, {back('low7', 7)} - low7 AS turned, CASE WHEN len(vs) = 14 THEN (len(list_filter(vs, lambda y: y < volume)) + (len(list_filter(vs, lambda y: y = volume)) + 1) / 2.0) / 14 END AS place FROM o)""",
    "turned * far / 119 * place",
    "p",
)
by_hand(
    "lib_acceleration_reversal",
    f"""n AS (SELECT *, ln(close) AS lc, qv / {full('avg', 'qv', 45, 11)} AS liquid FROM (SELECT *, quote_volume AS qv FROM b)), m AS (SELECT *, lc - {back('lc', 1)} AS r1, lc - {back('lc', 3)} AS r3 FROM n),
    o AS (SELECT *, CASE WHEN liquid BETWEEN 0.2 AND 5 THEN -(r3 - {back('r3', 3)}) / {full('stddev_samp', 'r1', 45, 11)} END AS raw FROM m), p AS (SELECT *, {full('avg', 'raw', 5, 2)} AS smooth FROM o),
    {recursive('e', 'p', {'m': ('smooth', 2 / 11)})}, q AS (SELECT p.*, CASE WHEN count(smooth) OVER {PAST} >= 5 THEN m END AS value FROM p JOIN e USING (instrument, k))""",
    "value",
    "q",
)
_PARTS = (20, 40, 60, 90, 120)


def _bias(weights: list[float]) -> None:
    mean = " + ".join(f"{w / math.fsum(weights)!r} * {full('avg', 'close', n)}" for w, n in zip(weights, _PARTS))
    by_hand(
        "lib_bias_zscore",
        f"""n AS (SELECT *, -(close - ({mean})) / nullif({full('stddev_samp', 'close', 120)}, 0) AS z, ln(1 + quote_volume) AS x FROM b),
        m AS (SELECT *, x - avg(x) OVER d AS dx, z - avg(z) OVER d AS dz FROM n WINDOW d AS (PARTITION BY date)), o AS (SELECT *, avg(dx * dz) OVER d / nullif(avg(dx * dx) OVER d, 0) AS beta FROM m WINDOW d AS (PARTITION BY date))""",
        "-(dz - dx * beta)",
        "o",
    )


def _oscillator(name: str, series: str, fast: int, slow: int, signal: int, value: str) -> None:
    by_hand(
        name,
        f"""n AS (SELECT *, {series} AS x FROM b), {recursive('e', 'n', {'f': ('x', 2 / (fast + 1)), 's': ('x', 2 / (slow + 1))})},
        u AS (SELECT n.*, CASE WHEN count(x) OVER {PAST} >= {max(fast, slow)} THEN f - s END AS d FROM n JOIN e USING (instrument, k)),
        {recursive('g', 'u', {'m': ('d', 2 / (signal + 1))})}, v AS (SELECT u.*, CASE WHEN count(d) OVER {PAST} >= {signal} THEN m END AS sig FROM u JOIN g USING (instrument, k))""",
        value,
        "v",
    )


_TYPICAL = "((close + high + low) / 3)"
_oscillator("lib_klinger_oscillator", f"volume * sign({_TYPICAL} - {back(_TYPICAL, 1)})", 5, 20, 3, "sig")
_oscillator("lib_volume_macd", "volume", 5, 60, 5, "d - sig")
by_hand(
    "lib_venue_share_shift",
    f"""n AS (SELECT *, CASE WHEN quote_volume > 0 AND venue_quote_volume > 0 THEN quote_volume / (quote_volume + venue_quote_volume) END AS share FROM b),
    m AS (SELECT *, {full('avg', 'share', 20)} / {full('avg', 'share', 120)} AS shift FROM n), o AS (SELECT *, -({rank('shift')} - 0.5) AS v FROM m)""",
    back("v", 1),
    "o",
)
_bias([math.exp(-0.3 * i) for i in range(5)])
