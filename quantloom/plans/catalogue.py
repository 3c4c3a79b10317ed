"""The factor catalogue: named formulas over the fields of a panel.

An entry holds the formula, its direction and whether it is turned to scaled ranks (`mad_rank`) before use. Warm-up and
fields follow from the formula. Windows are in rows of the panel's calendar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from quantloom.plans.formula import Node, call, const, field, history_days, required_fields

EPS, TINY = 1e-8, 1e-12


@dataclass(frozen=True)
class Factor:
    name: str
    formula: Node
    direction: int = 1
    preprocessing: str = "mad_rank"

    @property
    def warmup(self) -> int:
        return history_days(self.formula)

    @property
    def fields(self) -> set[str]:
        return required_fields(self.formula)


FACTORS: dict[str, Factor] = {}


def factor(name: str, formula: Node, direction: int = 1, preprocessing: str = "mad_rank") -> None:
    FACTORS[name] = Factor(name, formula, direction, preprocessing)


o, h, lo, c, v = field("open"), field("high"), field("low"), field("close"), field("volume")
qv, tc, tb, tq, fund = field("quote_volume"), field("trade_count"), field("taker_volume"), field("taker_quote_volume"), field("funding")
oi, mark, index, venue, standard = field("open_interest"), field("mark_close"), field("index_close"), field("venue_quote_volume"), field("standard")


def ts(op):
    return lambda x, n, *more: call(op, x, params=(n, *more))


lag, delta, mean, total, std = ts("lag"), ts("delta"), ts("rolling_mean"), ts("rolling_sum"), ts("rolling_std")
hi, low, median, mad, iqr = ts("rolling_max"), ts("rolling_min"), ts("rolling_median"), ts("rolling_mad"), ts("rolling_iqr")
skew, kurt, downside, tsrank, zscore = ts("rolling_skew"), ts("rolling_kurt"), ts("rolling_downside_std"), ts("ts_rank"), ts("ts_zscore")
argmax, wma, ema, ewm, var = ts("ts_argmax"), ts("decay_linear"), ts("ema"), ts("ewm"), ts("rolling_var")
ema_from = ts("ema_from")


def rank(x):
    return call("rank", x)


def z(x):
    return call("cs_zscore", x)


def scale(x):
    return call("cs_scale", x)


def corr(x, y, n):
    return call("rolling_corr", x, y, params=(n,))


def cov(x, y, n):
    return call("rolling_cov", x, y, params=(n,))


def top(x, key, n, k):
    return call("top_sum", x, key, params=(n, k))


def bottom(x, key, n, k):
    return call("bottom_sum", x, key, params=(n, k))


def where(cond, a, b):
    return call("where", cond, a, b)


def absolute(x):
    return call("abs", x)


def sgn(x):
    return call("sign", x)


def log(x):
    return call("log", x)


def log1p(x):
    return call("log1p", x)


def tanh(x):
    return call("tanh", x)


def larger(a, b):
    return call("max2", a, b)


def smaller(a, b):
    return call("min2", a, b)


def clip(x, a, b):
    return larger(smaller(x, const(b)), const(a))


def power(x, p):
    return call("power", x, params=(float(p),))


def roc(x, n):
    return x / lag(x, n) - 1


def gauge(x):
    return rank(x) - 0.5


def carry(x):
    return call("carry", x)


def fill(x, value):
    return call("fill", x, params=(float(value),))


def residual(y, *xs):
    """Residual of y on xs with an intercept, by date, where all have a value: one regressor after the other, each cleared of
    those before it."""
    known = sum((x * 0 for x in xs), y * 0)
    held = lambda e: call("column", e)
    y, cleared = held((y + known) - call("cs_mean", y + known)), []
    for x in xs:
        x = held((x + known) - call("cs_mean", x + known))
        for z_ in cleared:
            x = held(x - z_ * (call("cs_mean", x * z_) / call("cs_mean", z_ * z_)))
        y = held(y - x * (call("cs_mean", x * y) / call("cs_mean", x * x)))
        cleared.append(x)
    return y


def own_residual(y, x):
    """Residual of y on x by date, each centred by the mean of all its own values; the slope divides their mean product where both are
    known by the mean square of all of x."""
    held = lambda e: call("column", e)
    dx, dy = held(x - call("cs_mean", x)), held(y - call("cs_mean", y))
    return dy - dx * (call("cs_mean", dx * dy) / call("cs_mean", dx * dx))


ret = roc(c, 1)
logret = log(c / lag(c, 1))
vwap = qv / v
market = call("cs_mean", ret)
range_pct = mean((h - lo) / lag(c, 1), 20)
vol_eff = roc(c, 20) / (range_pct + EPS)
base = mean(c, 20, 1)
nc, no, nh, nl = c / base, o / base, h / base, lo / base
nret = roc(nc, 1)
nv = v / mean(v, 20, 1)
tick = qv / (tc + EPS)
buy_price = tq / tb
sell_quote = qv - tq
typical = (h + lo + c) / 3
clv = ((c - lo) - (h - c)) / (h - lo)
true_range = larger(larger(h - lo, absolute(h - lag(c, 1))), absolute(lo - lag(c, 1)))

# terminals of the formula trees
return_1d, range_relative, body_relative = ret, (h - lo) / c, (c - o) / o
quote_per_trade, taker_quote_ratio, taker_base_ratio = qv / tc, tq / qv, tb / v
volume_relative_20, quote_volume_relative_20 = v / mean(v, 20), qv / mean(qv, 20)

# rolling library
factor("apb", log(mean(vwap, 3) / (total(v * vwap, 3) / total(v, 3))))
factor("ats_price_divergence", roc(tick, 20) - roc(c, 20))
factor("accumulated_buy_sell_ratio", total(tq * (ret > 0), 30) / (total(sell_quote * (ret < 0), 30) + EPS))
_density = tc / (qv + EPS)
_buy = tq / (sell_quote + EPS) * (power(_density / (mean(_density, 20) + 1e-12), 2) + EPS)
factor("buy_stability", mean(_buy, 20) / (std(_buy, 20) + EPS))
factor("directional_momentum", total(larger(const(0), ret), 20) / (total(larger(const(0), -ret), 20) + 1e-10))
factor(
    "directional_volatility",
    (h - lag(o, 20)) / lag(o, 20) / mean((h - o) / o + 1e-10, 20) - (lag(o, 20) - lo) / lag(o, 20) / mean((o - lo) / o + 1e-10, 20),
)
factor("high_volatility_momentum", roc(c, 20) / ((h - lo) / c))
factor("high_volatility_momentum_product", roc(c, 20) * mean(true_range, 14))
_amplitude = h / (lo + EPS) - 1
factor("ideal_amplitude", top(_amplitude, c, 20, 4) / 4 - bottom(_amplitude, c, 20, 4) / 4, -1)
_idio = var(ret, 60) - power(cov(ret, market, 60), 2) / var(market, 60)
factor("idio_vol", call("sqrt", larger(_idio, const(0))), -1)
factor("intraday_accumulation_distribution", total(clv * qv, 20) / (total(qv, 20) + EPS))
factor("ma_cross_trend", mean(c, 20) / mean(c, 60) - 1)
_mom20 = roc(c, 20)
factor("momentum_taker_quote_extreme", top(_mom20, tq, 20, 10) / bottom(_mom20, tq, 20, 10))
factor("momentum_volume_extreme", top(_mom20, v, 20, 10) / bottom(_mom20, v, 20, 10))
factor("n_day_momentum", log(c / lag(c, 1)))
factor("net_order_flow", total(2 * tq - qv, 20) / total(qv, 20))
factor("price_momentum_60", log(c / lag(c, 60)))
factor("price_momentum_120", log(c / lag(c, 120)))
factor("price_path_efficiency", roc(c, 10) / (total(absolute(ret), 10) + EPS))
factor("price_retail_correlation_divergence", corr(ret, roc(tc, 1), 20) - corr(ret, roc(qv, 1), 20), -1)
_gain, _loss = mean(larger(delta(c, 1), const(0)), 14), mean(larger(-delta(c, 1), const(0)), 14)
factor("rsi_quote", clip(100 - 100 / (1 + _gain / (_loss + EPS)), 0, 100), -1)
_volstab = mean(tick, 20) / (std(tick, 20) + EPS)
factor("rank_multiply", 0.5 * rank(-_volstab) + 0.5 * rank(vol_eff))
factor("retail_activity_divergence", rank(mean(tc, 20)) - rank(mean(qv, 20)), -1)
factor("retail_fomo_ratio", total(where(delta(c, 1) > 0, tc, const(0)), 20) / (total(tc, 20) + EPS), -1)
factor("retail_friction_illiquidity", log1p(mean(absolute(ret) / (qv + EPS) * tc, 60)), -1)
factor("return_skew_reversal", -skew(ret, 20))
_share = tq / (qv + EPS)
factor("return_taker_ratio_diff", top(logret, _share, 10, 5) - bottom(logret, _share, 10, 5))
factor("rolling_corr_buy_quote", corr(logret, mean(tq, 20), 20) * log1p(mean(v, 20)))
factor("smart_money_accum_divergence", rank(roc(tick, 20)) - rank(roc(c, 20)))
_eff10 = roc(c, 10) / (mean((h - lo) / (lag(c, 1) + EPS), 10) + EPS)
factor("taker_buy_accumulation", rank(total(clip(_share, 0, 1), 10)) * rank(_eff10))
factor("taker_buy_extreme_efficiency", top(vol_eff, tq, 20, 10) / bottom(vol_eff, tq, 20, 10))
_ratio = tq / (sell_quote + EPS)
factor("top_bottom_trades_ratio", top(_ratio, tc, 20, 10) / (bottom(_ratio, tc, 20, 10) + EPS))
factor("lower_shadow_strength", z((c - lo) / (mean(c - lo, 30) + EPS)))
factor("vwap_vol_mom_cap", rank(c / vwap - 1) + rank(vol_eff) + rank(mean(qv, 20)))
factor("volatility_efficiency", vol_eff)
_order_flow = tc / (mean(tc, 20) + EPS) / (tick / (mean(tick, 20) + EPS) + EPS)
factor("volatility_order_flow", vol_eff * _order_flow)
factor("volume_stability", mean(tick, 20) / std(tick, 20), -1)
factor("volume_taker_base_extreme", top(total(tb, 10), v, 20, 10) / bottom(total(tb, 10), v, 20, 10))
factor("example_momentum", log(c / lag(c, 20)))

# formula trees found by search
_none = "none"
factor("tree_01", mean(hi(low(hi(return_1d, 5), 20), 60), 60), -1, _none)
factor("tree_02", mean(mean(std(hi(range_relative, 40), 60), 10), 10), -1, _none)
factor("tree_03", mean(std(hi(range_relative, 5), 10), 60), -1, _none)
factor("tree_04", mean(mean(taker_quote_ratio, 40), 20), 1, _none)
factor("tree_05", mean(median(call("rolling_max_drawdown", tc, params=(40,)), 60), 10), -1, _none)
factor("tree_06", low(hi(low(hi(body_relative, 10), 60), 60), 40), -1, _none)
factor("tree_07", low(range_relative, 40) * std(range_relative, 40), -1, _none)
factor("tree_08", -mean(body_relative + hi(range_relative, 20), 3), 1, _none)
factor("tree_09", std(delta(hi(low(quote_per_trade, 10), 60), 3), 60), 1, _none)
factor("tree_10", low(low(tc, 60) / quote_per_trade, 10), -1, _none)
factor("tree_11", low(lag(std(quote_per_trade, 5), 1), 40), 1, _none)
factor("tree_12", std(std(quote_per_trade, 60), 40), 1, _none)
factor("tree_13", mean(std(body_relative, 60), 40), -1, _none)
factor("tree_14", low(low(mean(taker_quote_ratio, 20), 20), 5), 1, _none)
factor("tree_15", mean(range_relative, 60) * mean(mean(range_relative, 5), 20), -1, _none)
factor("tree_16", mean(mean(std(range_relative, 60), 5), 20), -1, _none)
factor("tree_17", lag(hi(corr(lo, lo, 10), 40), 3), -1, _none)
factor("tree_18", hi(hi(range_relative, 20), 3), -1, _none)
factor("tree_19", hi(range_relative, 60) * mean(hi(range_relative, 3), 60), -1, _none)

# formulaic alphas
A = "alpha_{:03d}".format
factor(A(1), rank(1 - argmax(call("signed_sqrt", where(ret < 0, std(ret, 20), c)), 5)) - 0.5)
factor(A(2), -corr(rank(delta(log(v), 3)), rank((c - o) / o), 7))
factor(A(3), -corr(rank(o / mean(o, 20)), rank(v), 20))
factor(A(4), -tsrank(rank(lo / mean(lo, 20)), 9))
factor(A(5), (o - mean(buy_price, 20)) * (c - buy_price))
factor(A(6), -corr(h - c, tq, 20))
factor(A(7), where(tq - mean(tq, 14) > 0, -tsrank(absolute(delta(c, 7)), 49) * sgn(delta(c, 7)), const(-1)))
_signal8 = total(o / mean(c, 20), 3) * total(ret, 3)
factor(A(8), -rank(_signal8 - lag(_signal8, 7)))
factor(A(9), where(low(delta(c, 1), 10) > 0, delta(c, 1), where(hi(delta(c, 1), 10) < 0, delta(c, 1), -delta(c, 1))))
factor(A(10), rank(where(low(ret, 7) > 0, ret, where(hi(ret, 7) < 0, ret, -ret))))
factor(A(11), (rank(hi(typical - c, 20)) + rank(low(typical - c, 20))) * rank(delta(v, 20)))
factor(A(12), sgn(delta(tq, 30)) * -delta(c, 30))
factor(A(13), -rank(cov(nc, nv, 20)))
factor(A(14), -rank(delta(logret, 5)) * corr(no, nv, 10))
factor(A(15), -rank(total(delta(nc, 1), 10)) * rank(corr(nv, nc, 10)))
factor(A(16), -rank(cov(h * nv, nv, 10)))
factor(A(17), -rank(tsrank(c, 15)) * rank(delta(delta(c, 2), 2)) * rank(tsrank(v / mean(v, 30), 7)))
factor(A(18), -rank(std(absolute(c - o), 5) + (c - o) + corr(c, o, 5)))
factor(A(19), -sgn(2 * delta(c, 5)) * (1 + rank(1 + total(ret, 60))))
factor(A(20), -rank(o - lag(h, 7)) * rank(o - lag(lo, 7)))
_m8, _s8, _m2 = mean(c, 8), std(c, 8), mean(c, 2)
_signal21 = where(_m2 - (_m8 + _s8) > 0, const(-1), where((_m8 - _s8) - _m2 > 0, const(1), where(v / mean(v, 20) > 1, const(1), const(-1))))
factor(A(21), clip(_signal21 * (0.5 + absolute((c - (_m8 - _s8)) / (2 * _s8) - 0.5) + absolute((_m2 - _m8) / _m8)), -2, 2))
factor(A(22), -delta(corr(h, v, 10), 10) * rank(std(c, 10)))
factor(A(23), where(h - mean(h, 20) > 0, -delta(h, 2), const(0)))
factor(A(24), where(delta(mean(c, 30), 30) / lag(c, 30) > 0.05, -delta(c, 3), -(c - low(c, 30))))
factor(A(25), -ret * mean(tq, 7) * (vwap / c) * ((h - c) / c))
factor(A(26), -hi(corr(tsrank(v, 10), tsrank(h, 10), 10), 5))
factor(A(27), where(rank(mean(corr(rank(v), rank(vwap), 20), 10)) > 0.5, const(-1), const(1)))
factor(A(28), corr(mean(v, 20), lo, 10) + (h + lo) / 2 / c - 1)
factor(A(29), low(rank(zscore(log1p(low(rank(rank(-rank(delta(c, 5)))), 2)), 20)), 5) + tsrank(lag(-ret, 6), 5))
_steps = sgn(delta(c, 1)) + sgn(lag(delta(c, 1), 1)) + sgn(lag(delta(c, 1), 2))
factor(A(30), (1 - rank(_steps)) * total(v, 10) / total(v, 60))
factor(A(31), rank(rank(rank(wma(-rank(rank(delta(c, 20))), 20)))) + rank(-delta(c, 5)) + sgn(scale(corr(mean(v, 20), lo, 18))))
factor(A(32), scale(mean(c, 7) - c) + 20 * scale(corr(buy_price, lag(c, 8), 30)))
factor(A(33), (o - c) / c)
factor(A(34), rank((1 - rank(std(ret, 5) / std(ret, 10))) + (1 - rank(delta(c, 5)))))
factor(A(35), tsrank(tq, 30) * (1 - tsrank((c + h - lo) / c, 10)) * (1 - tsrank(ret, 10)))
_turmoil = std(c, 20) / mean(c, 20)


def _by_turmoil(short, medium, long):
    """The short base in turmoil, the long one in calm, the medium one otherwise."""
    return call("fill", where(_turmoil > 0.1, short, where(_turmoil < 0.05, long, medium)), params=(0.0,)) + where(call("fill", _turmoil * 0 + 1, params=(0.0,)), const(0), medium)


_base36 = _by_turmoil(mean(c, 20, 1), mean(c, 60, 1), mean(c, 120, 1))
_c36, _v36 = c / _base36, v / _by_turmoil(mean(v, 10, 1), mean(v, 30, 1), mean(v, 60, 1))
_move36 = log(_c36 / (o / _base36))
factor(
    A(36),
    2.21 * rank(corr(_move36, lag(_v36, 1), 10)) + 0.7 * rank(-_move36) + 0.73 * rank(tsrank(lag(-log(_c36 / lag(_c36, 1)), 5), 5))
    + rank(absolute(corr(typical / _base36, mean(_v36, 20), 5))) + 0.6 * rank((mean(_c36, 50) - o / _base36) * (_c36 - o / _base36)),
)
factor(A(37), rank(corr(lag(nc - no, 5), nc, 50)) + rank(nc - no))
factor(A(38), -rank(tsrank(nc, 10)) * rank(nc / no))
factor(A(39), -rank(delta(nc, 10) * (1 - rank(wma(v / mean(v, 10), 10)))) * (1 + rank(total(nret, 90))))
factor(A(40), -rank(std(nh, 10)) * corr(nh, nv, 20))
factor(A(41), call("sqrt", nh * nl) - mean(buy_price, 20, 1) / base)
_vw42 = total(c * v, 20) / total(v, 20) / base
factor(A(42), rank(_vw42 - nc) / (rank(_vw42 + nc) + EPS))
factor(A(43), tsrank(v / mean(v, 20), 20) * tsrank(-delta(nc, 7), 8))
factor(A(44), -corr(nh, tsrank(v, 20), 20))
factor(A(45), -rank(mean(lag(nc, 5), 20)) * corr(nc, nv, 2) * rank(corr(total(nc, 5), total(nc, 20), 2)))
_turn46 = (lag(nc, 20) - lag(nc, 10)) / 10 - (lag(nc, 10) - nc) / 10
factor(A(46), where(_turn46 > 0.25, const(-1), where(_turn46 < 0, const(1), -delta(nc, 1))))
factor(A(47), rank(1 / nc) * nv * (nh * rank(nh - nc)) / (total(nh, 5) / 5) - rank(vwap / base - lag(vwap / base, 5)))
factor(A(48), corr(delta(nc, 1), delta(lag(nc, 1), 1), 20) * delta(nc, 1) / nc / total(power(delta(nc, 1) / lag(nc, 1), 2), 20))
factor(A(50), -hi(rank(corr(rank(v), rank(vwap / base), 10)), 10))
factor(A(52), (-low(nl, 7) + lag(low(nl, 7), 7)) * ((total(nret, 140) - total(nret, 21)) / 119) * tsrank(v, 14))
factor(A(53), -delta(((nc - nl) - (nh - nc)) / ((nc - nl) + EPS), 9))
factor(A(54), -(lo - c) * power(o, 3) / ((lo - h) * power(c, 3) + EPS))
factor(A(55), -corr(rank((c - low(lo, 12)) / (hi(h, 12) - low(lo, 12) + EPS)), rank(v), 6))
factor(A(56), -(rank(total(ret, 21) / (total(total(ret, 3), 7) + EPS)) * rank(ret * tq)))
factor(A(57), -((c - buy_price) / (wma(rank(1 - argmax(c, 14)), 2) + EPS)))
factor(A(60), -(2 * 2 * gauge(clv * tq) - 2 * gauge(1 - argmax(c, 49))))

# wider library
W = "lib_{}".format
NONE = const(0) / const(0)
_mid = (h + lo) / 2
factor(W("volume_body_corr"), -corr(rank(delta(log(v), 1)), rank((c - o) / o), 6))
factor(W("clv_delta"), -delta(clv, 1))
_pc = lag(c, 1)
factor(W("true_move_sum"), total(where(c - _pc > 0, c - smaller(lo, _pc), where(_pc - c > 0, c - larger(h, _pc), const(0))), 6), -1)
factor(W("band_state"), where(_m2 - (_m8 + _s8) > 0, const(-1), where((_m8 - _s8) - _m2 > 0, const(1), where(mean(v, 20) - v > 0, const(-1), const(1)))))
factor(W("volume_high_rank_corr"), -hi(corr(tsrank(v, 5), tsrank(h, 5), 5), 3))
factor(W("open_high_turn"), -rank(sgn(delta(o * 0.85 + h * 0.15, 4))))
factor(W("vwap_gap_volume"), (rank(hi(vwap - c, 3)) + rank(low(vwap - c, 3))) * rank(delta(v, 3)))
factor(W("mid_vwap_delta"), rank(-delta(_mid * 0.2 + vwap * 0.8, 4)))
factor(W("mid_move_ewm"), ema((_mid - lag(_mid, 1)) * (h - lo) / v, 6))
factor(W("down_vol_or_close"), rank(hi(power(where(ret < 0, std(ret, 20) * (19 / 20) ** 0.5, c), 2), 5)))
_accel = (log(c / lag(c, 3)) - lag(log(c / lag(c, 3)), 3)) / std(logret, 45, 11)
_liquid = qv / mean(qv, 45, 11)
factor(W("acceleration_reversal"), ema_from(mean(-where(0.2 - _liquid, NONE, where(_liquid - 5, NONE, _accel)), 5, 2), 10, 5))
factor(W("accumulation_distribution_dif"), -total(where(c - _pc > 0, c - smaller(lo, _pc), where(_pc - c > 0, c - larger(h, _pc), const(0))), 20) / 20)
factor(W("activity_burst"), -gauge(std(tc, 20) / mean(tc, 20)))
factor(W("ad_volume_momentum"), total(clv * v, 5))
_amp = (h - lo) / c
factor(W("amplitude_sorted_momentum"), top(ret, _amp, 20, 10) / bottom(ret, _amp, 20, 10))
benchmark = call("exp", total(log1p(market), 20)) - 1  # of the equally weighted market
factor(W("basis_reversion"), lag(-gauge(mark / index - 1), 1))
_weights = [math.exp(-0.3 * i) for i in range(5)]
_multi_ma = sum((w * mean(c, n) for w, n in zip(_weights[1:], (40, 60, 90, 120))), _weights[0] * mean(c, 20)) / sum(_weights)
factor(W("bias_zscore"), -own_residual(-(c - _multi_ma) / std(c, 120), log1p(qv)))
_place = 2 * (c - low(c, 20)) / (hi(c, 20) - low(c, 20) + EPS) - 1
_kaufman = clip(absolute(delta(c, 20)) / (total(absolute(ret), 20) * lag(c, 20) + EPS), 0, 1)
_confirm = clip(mean(qv, 5) / (mean(qv, 20) + EPS), 0, 2) / 2
_breakout = _place * _kaufman * _confirm
factor(W("breakout_quality"), _breakout)


def _crowded(side):
    return 1 + 0.5 * sgn(side) * (2 * rank(mean(fund, 5)) - 1)


_score = _breakout * _crowded(_place)
_smooth = ema(_score, 5)
factor(W("breakout_funding"), _smooth)
factor(W("breakout_funding_market_gate"), where(fill(benchmark < 0, 0), NONE, _smooth))
_open = fill(carry(where(benchmark > 0.02, const(1), where(benchmark < -0.03, const(0), NONE))), 1)
factor(W("breakout_funding_market_hysteresis"), where(_open, _smooth, NONE))
factor(W("breakout_funding_market_hysteresis_long"), where((1 - _open) * (_smooth > 0), NONE, _smooth))
factor(W("breakout_funding_market_damp"), where(_open, _smooth, 0.2 * _smooth))
_turned = _place * where(0.6 - absolute(_place), const(-1), const(1))
factor(W("breakout_funding_split"), ema(_turned * _kaufman * _confirm * _crowded(_turned), 5))
_beta = call("rolling_beta", ret, market, params=(60,))
_beta_c, _score_c = _beta - call("cs_mean", _beta), _score - call("cs_mean", _score)
factor(W("breakout_funding_residual"), ema(_score - _beta * (call("cs_mean", _score_c * _beta_c) / call("cs_mean", _beta_c * _beta_c)), 5))
_vol20 = std(ret, 20)
_squeeze = (_vol20 - low(_vol20, 120)) / (hi(_vol20, 120) - low(_vol20, 120))
factor(W("breakout_funding_squeeze_filter"), ema(_score * (1 - 0.5 * absolute(2 * _squeeze - 1)), 5))


def _fading(event, days=5, half=2.0):
    """The last days' events, older ones weighted down."""
    return sum((math.exp(-k / half) * fill(lag(event, k), 0) for k in range(1, days)), fill(event, 0))


_level = mean((h - lo) / (lag(c, 1) + TINY), 20)
_tight = clip(1 - _level / (median(_level, 120, 60) + TINY), 0, 1)
_out = larger(c / (lag(hi(c, 20), 1) + TINY) - 1, const(0)) - larger(lag(low(c, 20), 1) / (c + TINY) - 1, const(0))
factor(W("breakout_squeeze_release"), _fading(_out * _tight * (0.5 + 0.5 * clip(qv / (mean(qv, 20) + TINY) / 2, 0, 1))))
_heat = mean(qv, 20) / (mean(qv, 120) + EPS)
factor(W("heat_premium"), -gauge(_heat))
factor(W("heat_standard_tier"), lag(-gauge(where(standard - 0.5, _heat, NONE)), 1))
factor(W("close_location_extreme_short"), -absolute(gauge(mean((2 * c - h - lo) / (h - lo), 20))))
factor(W("close_location_premium"), gauge(mean((2 * c - h - lo) / (h - lo), 20)))
_attention_ratio = mean(tq, 20) / (mean(tq, 120) + EPS)
_attention, _burst = -gauge(_attention_ratio), -gauge(std(tc, 20) / mean(tc, 20))
factor(W("attention_burst"), 0.5 * _attention + 0.5 * _burst)
_buildup = mean(oi, 20) / mean(oi, 120)
factor(W("attention_oi_buildup"), lag(0.5 * _attention + 0.5 * -gauge(_buildup), 1))
factor(W("attention_burst_oi"), lag((_attention + _burst - gauge(_buildup)) / 3, 1))
factor(W("breakout_tail_squeeze"), (power(gauge(_breakout), 3) + clip(gauge(-_squeeze), -0.4, 0.4)) / 2)
_confirmed = sgn(mean(mark / c - 1, 5)) * sgn(roc(c, 5)) > 0
_chase = larger(roc(oi, 5), const(0)) * _confirmed
factor(W("oi_buildup_chase"), lag(-((rank(_buildup) + rank(_chase)) / 2 - 0.5), 1))
_cum = call("exp", call("cumsum", fill(log1p(ret), 0)))
factor(W("cum_return_ratio"), -total(_cum, 40) / total(total(_cum, 5), 10))
factor(W("funding_carry"), ewm(mean(fund, 24), 5) + 0 * mean(fund, 28))
factor(W("funding_deviation_revert"), -(mean(fund, 20) - median(fund, 60)))
factor(W("high_amplitude_momentum"), top(ret, h / lo - 1, 60, 18))
_sound = where((0.9 - absolute(logret)) * (qv > 0), const(0), NONE)  # 0 where a day counts
_excess = logret - call("cs_mean", (logret + _sound) * qv) / call("cs_mean", qv + _sound + 0 * logret)
factor(W("high_amplitude_excess_momentum"), -residual(top(_excess + _sound, (h - lo) / lag(c, 1) + _sound, 60, 18), -log(c / lag(c, 10)) + _sound))
factor(W("illiquidity_premium"), gauge(mean(absolute(ret) / qv, 20)))
factor(W("klinger_oscillator"), ema_from(ema_from(v * sgn(delta(typical, 1)), 5, 5) - ema_from(v * sgn(delta(typical, 1)), 20, 20), 3, 3))
_large = clip(ret / (_vol20 + TINY), -3, 3) * (0.5 + rank(mean(absolute(ret) / (qv + TINY), 20)))
factor(W("large_move_illiquid"), ema(_large, 5))
factor(W("large_move_illiquid_reversal"), ema(gauge(-_large), 10))
_flow, _turn = typical * qv, delta(typical, 1)
_mfi = 100 * total(where(_turn > 0, _flow, const(0)), 120) / (total(where(_turn > 0, _flow, const(0)), 120) + total(where(_turn < 0, _flow, const(0)), 120))
factor(W("money_flow_quote"), _mfi)
factor(W("oi_buildup_premium"), lag(-gauge(_buildup), 1))
factor(W("oi_buildup_premium_tail"), lag(-gauge(where(0.1 - rank(_buildup), NONE, _buildup)), 1))
factor(W("oi_chase_intensity"), lag(-gauge(_chase), 1))
factor(W("oi_chase_reversal"), lag(-gauge(sgn(roc(c, 5)) * _chase), 1))


def _from_top(x, n):
    """Share of the window's values at or above the last, ties counted half."""
    return (n + 1) / n - tsrank(x, n)


# fixed values: the ensemble's weights
factor(
    W("search_ensemble"),
    -0.0032305300149235933 * mean(sgn(h), 10) + 0.0009442490772445488 * _from_top(vwap, 20) + 0.006190342932286082 * call("window_ema", sgn(o), params=(40,))
    + 0.00046536619582840356 * _from_top(total(o, 5), 5) - 0.0006257742215931986 * var(sgn(fund), 10) - 0.001671611565855515 * _from_top(total(lo, 5), 40) - 0.00037885012546794996 * _from_top(c, 40),
)
factor(W("cum_path_dispersion"), 0.3333 * absolute(std(_cum, 5)))
_own, _ref = clip(ret, -0.5, 5), clip(market, -0.5, 5)
_moved = _own - total(_own * _ref, 20, 8) / (total(_ref * _ref + 0 * _own, 20, 8) + TINY) * _ref
factor(W("residual_momentum"), call("window_ema", total(_moved, 20, 8), params=(10,)))
factor(W("quote_volume_rank"), -rank(log1p(mean(qv, 30, 1))))


def _spread(x, windows):
    means = [mean(x, n) for n in windows]
    middle = sum(means[1:], means[0]) / len(means)
    return call("sqrt", sum((power(m - middle, 2) for m in means[1:]), power(means[0] - middle, 2)) / (len(means) - 1))


factor(W("price_convergence"), -log1p(_spread(c, (1, 5, 10, 20, 60))))
factor(W("price_volume_convergence"), z(-log1p(_spread(c, (1, 2, 3, 5, 8, 13)))) + z(-log1p(_spread(v, (1, 2, 3, 5, 8, 13)))))
factor(W("volume_convergence"), -log1p(_spread(v, (1, 5, 10, 20, 30, 60))))
_pv = corr(c, log1p(qv), 10)
factor(W("pv_corr_premium"), -gauge(_pv))
factor(W("pv_corr_split"), where(rank(_pv) > 0.9, const(0.5), -gauge(_pv)))
_dry = larger(1 - mean(qv, 5) / (mean(qv, 20) + TINY), const(0))
_tr5, _tr20 = total(tq, 5) / (mean(qv, 5) * 5 + TINY), total(tq, 20) / (mean(qv, 20) * 20 + TINY)
_fade = larger(-sgn(roc(c, 10)) * (_tr5 - _tr20) / (absolute(_tr20) + TINY), const(0))
factor(W("pv_exhaustion"), -(roc(c, 10) * 0.5 * (_dry + _fade)))
factor(W("range_level_premium"), -gauge(mean(_amp, 20)))


def _signed(a, b):
    return (b - a) * absolute(b - a)


def _route(*points):
    """Net signed squares of a path over its squares."""
    steps = list(zip(points, points[1:]))
    return sum((_signed(a, b) for a, b in steps[1:]), _signed(*steps[0])) / sum((power(b - a, 2) for a, b in steps[1:]), power(steps[0][1] - steps[0][0], 2))


_lo, _lh, _ll, _lc = log(o), log(h), log(lo), log(c)
_middle = call("sqrt", h * lo)
_low_first = larger(_middle > o, (0.5 - absolute(sgn(o - _middle)) > 0) * (0.5 - (o > c) > 0))
_delta_flow = v * fill(where(_low_first, _route(_lo, _ll, _lh, _lc), _route(_lo, _lh, _ll, _lc)), 0)
_change = delta(mean(call("cumsum", _delta_flow), 50, 20), 20)
factor(W("cumulative_delta_flow"), 0.5 - (call("cs_quantile", _change, params=(0.7,)) > _change) > 0)
factor(W("retail_activity_divergence"), rank(mean(tc, 20)) - rank(mean(qv, 20)))
_rv5, _rv20 = std(ret, 5, 3), std(ret, 20, 8)
_rv_ratio, _size = _rv5 / (_rv20 + TINY), rank(log1p(mean(lag(qv, 1), 30, 1)))
factor(W("rv_style_residual_rank"), tsrank(wma(residual(_rv20, _size, _rv_ratio), 10), 10))
_beta60 = call("rolling_beta", ret, market, params=(60, 20))
_style = residual(_rv_ratio, _size, absolute(ret) / (qv + TINY) * 1e6, _beta60, call("rolling_corr", ret, market, params=(20, 8)), _rv20)
_steady, _big = tsrank(mean(_style, 10), 40), absolute(tsrank(_size, 10))
factor(W("rv_liquidity_ensemble"), -0.5 * _steady + var(_cum, 5) + var(_cum, 10) + 0.168 * _big)
_apart = total(ret - _beta60 * market, 20, 8)
factor(W("rv_residual_ensemble"), 0.5 * _steady - wma(tsrank(_apart, 10), 20) + 0.5 * mad(_cum, 10) + 0.167 * _big)
factor(W("taker_attention_premium"), _attention)
_ra, _rr = rank(_attention_ratio), rank(_mom20)
_ra_c, _rr_c = _ra - call("cs_mean", _ra), _rr - call("cs_mean", _rr)
factor(W("taker_attention_neutral"), -gauge(_ra - _rr * (call("cs_mean", _ra_c * _rr_c) / call("cs_mean", _rr_c * _rr_c))))
factor(W("taker_ratio_persistence"), mean(_share, 10))
factor(W("taker_fomo_reversal"), -tanh(clip((_share - mean(_share, 20)) / (std(_share, 20) + TINY), -5, 5) * (c / hi(c, 20)) * clip(qv / (mean(qv, 20) + TINY), 0, 2) / 2))
_ticket = mean(tq / tc, 20) / mean(tq / tc, 120)
factor(W("ticket_shift_premium"), gauge(_ticket), -1)
factor(W("ticket_shift_reversed"), -gauge(_ticket))
_venue = where(smaller(qv, venue), qv / (qv + venue), NONE)  # where both venues traded
factor(W("venue_share_shift"), lag(-gauge(mean(_venue, 20) / mean(_venue, 120)), 1))
_dif = ema_from(v, 5, 5) - ema_from(v, 60, 60)
factor(W("volume_macd"), _dif - ema_from(_dif, 5, 5))
_spike = larger(mean(absolute(ret), 5) / (mean(absolute(ret), 60) + TINY) - 1, const(0))
_deep = 0.5 + 0.5 * clip((rank(mean(log1p(qv), 20)) - 0.4) / 0.6, 0, 1)
factor(W("vol_spike_reversal"), _fading(-ret * _spike * _deep))
factor(W("vol_squeeze_position"), -_squeeze)
factor(W("vol_squeeze_liquid"), where(rank(mean(qv, 20)) - 0.2 > 0, -_squeeze, NONE))
factor(W("vol_squeeze_tail"), where(rank(_squeeze) - 0.95 > 0, NONE, -_squeeze))
_strength = absolute(benchmark) / (std(market, 20) * 20**0.5 + TINY)
factor(W("volatility_efficiency_market"), vol_eff * (0.5 + 0.5 * clip(_strength / 2, 0, 1)))
factor(W("volatility_efficiency_downside"), _mom20 / (call("sqrt", mean(power(smaller(ret, const(0)), 2), 20)) + EPS))
factor(W("volatility_efficiency_funding"), vol_eff * (1 - 0.5 * clip(absolute((fund - mean(fund, 20)) / (std(fund, 20) + TINY)) / 3, 0, 1)))
factor(W("volatility_efficiency_liquid"), vol_eff * (0.5 + 0.5 * rank(mean(log1p(qv), 20))))
factor(W("volatility_efficiency_money_flow"), z(_mfi - 50) * (0.5 + 0.5 * rank(z(_mfi - 50) * z(vol_eff))))
factor(W("volatility_efficiency_path"), vol_eff * (0.5 + 0.5 * clip(absolute(_mom20) / (total(absolute(ret), 20) + TINY), 0, 1)))
factor(W("volatility_efficiency_taker"), vol_eff * (1 + 0.5 * clip(mean(2 * tq / qv - 1, 20) * sgn(_mom20), -1, 1)))
factor(W("volatility_order_flow_efficiency"), vol_eff * _order_flow)
factor(W("volume_amplitude_divergence"), -corr(log1p(v), _amp, 10))
factor(W("volume_short_anomaly"), log1p(v) - log1p(mean(lag(v, 1), 3)))
_efficient = ret / ((h - lo) / (lag(c, 1) + TINY) + TINY)
factor(W("volume_sorted_efficiency"), top(_efficient, v, 20, 10) / bottom(_efficient, v, 20, 10))
_surge = mean(qv, 5) / (mean(qv, 60) + TINY)
_votes = (sgn(roc(c, 5)) + sgn(roc(c, 20)) + sgn(roc(c, 60))) / 3
_tide = fill(sgn(roc(call("cs_mean", c), 20)), 0)
_aligned = where(0.5 - absolute(sgn(_votes) - _tide), const(1), const(0.3))
_event = _votes * _aligned * (0.5 + 0.5 * clip(log(_surge / 1.3), 0, 1))
factor(W("volume_surge_trend"), call("hold", where(_surge > 1.3, _event, NONE), params=(10,)))
factor(W("volume_surge_full_vote"), call("hold", where((_surge > 1.3) * (absolute(_votes) > 0.99), _event, NONE), params=(10,)))
factor(W("volume_roc"), 100 * roc(qv, 20))
