"""One query per factor of the catalogue, over the weekly bars, and one job that computes many at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import views
from quantloom.plans import catalogue, formula
from quantloom.operators import cost_basis
from quantloom.queries.common import add, over, r

for _name, _f in catalogue.FACTORS.items():
    add(
        f"factor_{_name}",
        lambda spark, d, f=_f: formula.evaluate(views.bars_wk(spark, d), {"value": f.formula}),
        formula.sql(views.BARS_WK, {"value": _f.formula}),
    )

#: Formula operators, each on its own.
_c, _v = formula.field("close"), formula.field("volume")
_r = _c / formula.call("lag", _c, params=(1,)) - 1
_TREES = {
    "g01_safe_div": (_c - _v) / (_v + _c) + formula.call("abs", _c - _v) / _c,
    "g02_delta": formula.call("delta", _c, params=(3,)),
    "g03_rolling_median": formula.call("rolling_median", _c, params=(7,)),
    "g04_rolling_corr": formula.call("rolling_corr", _c, _v, params=(8,)),
    "g05_rank": formula.call("rank", _c),
    "g06_cross_section_zscore": formula.call("cs_zscore", _c),
    "g07_rolling_mad": formula.call("rolling_mad", _c, params=(7,)),
    "g08_rolling_iqr": formula.call("rolling_iqr", _c, params=(8,)),
    "g09_rolling_skew": formula.call("rolling_skew", _c, params=(20,)),
    "g09_rolling_kurt": formula.call("rolling_kurt", _c, params=(20,)),
    "g10_rolling_downside_std": formula.call("rolling_downside_std", _r, params=(10,)),
    "g11_ts_rank": formula.call("ts_rank_ordinal", _c, params=(10,)),
    "g12_ts_zscore": formula.call("ts_zscore", _c, params=(10,)),
    "g13_ts_argmax": formula.call("ts_argmax", _c, params=(10,)) - formula.call("ts_argmin", _c, params=(10,)),
    "g14_rolling_slope_norm": formula.call("rolling_slope_norm", _c, params=(10,)),
    "g15_rolling_r2": formula.call("rolling_r2", _c, params=(10,)),
    "g16_efficiency_ratio": formula.call("efficiency_ratio", _c, params=(10,)),
    "g17_rolling_hit_rate": formula.call("rolling_hit_rate", _r, params=(10,)),
    "g18_rolling_autocorr": formula.call("rolling_autocorr", _c, params=(20,)),
    "g19_rolling_max_drawdown": formula.call("rolling_max_drawdown", _c, params=(10,)),
    "g20_rolling_cv": formula.call("rolling_cv", _c, params=(10,)),
    "g21_signed_transforms": formula.call("signed_sqrt", _r) + formula.call("safe_log", _c - _v),
}
for _name, _tree in _TREES.items():
    add(_name, lambda spark, d, t=_tree: formula.evaluate(views.bars_mo(spark, d), {"value": t}), formula.sql(views.BARS_MO, {"value": _tree}))

_TERMINALS = {
    n: getattr(catalogue, n)
    for n in ("return_1d", "range_relative", "body_relative", "volume_relative_20", "quote_volume_relative_20", "taker_base_ratio", "taker_quote_ratio", "quote_per_trade")
}
add("g22_terminals", lambda spark, d: formula.evaluate(views.bars_mo(spark, d), _TERMINALS), formula.sql(views.BARS_MO, _TERMINALS))


def _masked(spark, d):
    bars = views.bars_mo(spark, d).withColumn("eligible", F.col("trade_count") >= 5)
    return formula.evaluate(bars, {"value": catalogue.FACTORS["tree_08"].formula}, "eligible")


_SQL = formula.sql(views.BARS_MO, {"value": catalogue.FACTORS["tree_08"].formula})
add(
    "g23_tree_with_eligibility", _masked,
    f"SELECT t.instrument, t.date, CASE WHEN e.ok THEN t.value END AS value FROM ({_SQL}) t JOIN (SELECT l_suppkey AS instrument, date_trunc('month', l_shipdate)::DATE AS date, count(*) >= 5 AS ok FROM lineitem GROUP BY ALL) e USING (instrument, date)",
)

#: U7: many formulas in one job; G27: neighbours of one formula in one job.
_MANY = {n: catalogue.FACTORS[n].formula for n in ("apb", "volatility_efficiency", "alpha_002", "alpha_020", "alpha_033", "lib_clv_delta", "net_order_flow", "tree_18", "retail_fomo_ratio", "volume_stability")}
add("u07_many_factors_one_job", lambda spark, d: formula.evaluate(views.bars_mo(spark, d), _MANY), formula.sql(views.BARS_MO, _MANY))
_NEAR = {f"variant_{i}": n for i, n in enumerate(formula.neighbours(catalogue.FACTORS["tree_08"].formula))}
add("g27_neighbouring_trees", lambda spark, d: formula.evaluate(views.bars_mo(spark, d), _NEAR), formula.sql(views.BARS_MO, _NEAR))

_PAST = "(PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _reference_sql(stages: str, value: str) -> str:
    """Rows (instrument, date, k, price, turn, close) of `t`, with the reference price carried from row to row."""
    return f"""WITH RECURSIVE {views.BARS_WK}, {stages}, s AS (SELECT instrument, date, k, price, turn, close, price AS ref FROM t WHERE k = 1
      UNION ALL SELECT t.instrument, t.date, t.k, t.price, t.turn, t.close, s.ref * (1 - s.turn) + s.price * s.turn FROM s JOIN t ON t.instrument = s.instrument AND t.k = s.k + 1)
    SELECT instrument, date, {r(value)} FROM s"""


def _clipped_sql(share: str) -> str:
    keep = "list_reduce(a, lambda s, y: s * (1 - 2 / 3.0::DOUBLE) + y * (2 / 3.0::DOUBLE))"
    return _reference_sql(
        f"""m AS (SELECT *, CASE WHEN count(volume) OVER {over(60)} >= 10 THEN volume / avg(volume) OVER {over(60)} END AS x, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM bars),
        q AS (SELECT *, ({share})::DOUBLE AS raw FROM m), l AS (SELECT *, list(raw) FILTER (WHERE raw IS NOT NULL) OVER {_PAST} AS a FROM q),
        t AS (SELECT instrument, date, k, close::DOUBLE AS price, CASE WHEN raw IS NOT NULL THEN greatest(least({keep}, 0.25), 0.01) ELSE 0 END AS turn, CASE WHEN raw IS NOT NULL THEN close::DOUBLE END AS close FROM l)""",
        "CASE WHEN close IS NOT NULL THEN greatest(least((close - ref) / ref, 1), -1) END",
    )


add(
    "factor_cgo", lambda spark, d: cost_basis.gain()(views.bars_wk(spark, d)),
    _reference_sql(
        f"""l AS (SELECT *, ln(volume + 1) AS lv, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM bars), m AS (SELECT *, min(lv) OVER {over(10)} AS lo, max(lv) OVER {over(10)} AS hi FROM l),
        t AS (SELECT instrument, date, k, quote_volume / volume AS price, least(0.02 + CASE WHEN hi > lo THEN (lv - lo) / (hi - lo) ELSE 0 END * 0.8 * 0.98, 0.99) AS turn, close::DOUBLE AS close FROM m)""",
        "(close - ref) / ref",
    ),
)
add("factor_lib_cgo_tail_split", lambda spark, d: cost_basis.clipped_gain(views.bars_wk(spark, d), cost_basis.by_tanh), _clipped_sql("0.03 + 0.08 * tanh((x - 1) / 2)"))
add(
    "factor_lib_cgo_conservative", lambda spark, d: cost_basis.clipped_gain(views.bars_wk(spark, d), cost_basis.by_two_tanhs),
    _clipped_sql("CASE WHEN x IS NOT NULL THEN greatest(least(CASE WHEN x >= 1 THEN 0.03 + 0.22 * tanh(0.38 * (x - 1)) WHEN x < 1 THEN 0.03 - 0.03 * tanh(1.61 * (1 - x)) END, 0.25), 0.01) END"),
)
