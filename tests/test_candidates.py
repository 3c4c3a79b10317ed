"""Ledgers of variants, stability, behaviour and deduplication on small tables worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import candidates as C, regime as G, tolerant as T

D = [dt.date(2024, 1, k) for k in (1, 2, 3, 4)]


def test_ledger_of_variants(spark):
    w = spark.createDataFrame([("a", D[0], 1, 1.0), ("a", D[1], 1, 0.5), ("a", D[1], 2, -0.5), ("b", D[2], 2, 1.0)], "variant string, date date, instrument int, weight double")
    r = spark.createDataFrame([(d, i, x) for d, xs in zip(D, [(0.9, 0.9), (0.1, 0.0), (0.2, -0.2), (-0.1, 0.3)]) for i, x in enumerate(xs, 1)], "date date, instrument int, ret double")
    got = {(x.variant, x.date): (round(x.gross, 9), round(x.turnover, 9), round(x.net, 9)) for x in C.ledgers(w, r, 0.1).collect()}
    assert got == {
        ("a", D[0]): (0.0, 1.0, -0.1), ("a", D[1]): (0.1, 1.0, 0.0), ("a", D[2]): (0.2, 1.0, 0.1), ("a", D[3]): (0.0, 0.0, 0.0),
        ("b", D[0]): (0.0, 0.0, 0.0), ("b", D[1]): (0.0, 0.0, 0.0), ("b", D[2]): (0.0, 1.0, -0.1), ("b", D[3]): (0.3, 1.0, 0.2),
    }
    told = {x.variant: x.total_return for x in C.results(C.ledgers(w, r, 0.1)).collect()}
    assert math.isclose(told["a"], 0.9 * 1.1 - 1) and math.isclose(told["b"], 0.9 * 1.2 - 1)


def test_stability(spark):
    told = spark.createDataFrame([("base", 0.5, 1.0), ("v1", 0.2, 0.5), ("v2", -0.1, -0.2), ("v3", 0.4, None)], "variant string, total_return double, sharpe double")
    r = C.stability(told, "base", 0.5).first()
    assert (r.variant_count, round(r.positive_fraction, 6), r.median_return) == (3, 0.333333, 0.2)
    assert math.isclose(r.return_degradation, 0.3) and math.isclose(r.sharpe_degradation, 1.0 - 0.15) and math.isclose(r.penalty, 0.3 + 0.85 + 0.5 - 1 / 3)
    alone = C.stability(told.filter("variant = 'base'"), "base").first()
    assert (alone.variant_count, alone.penalty) == (0, 0.0)
    better = C.stability(told.filter("variant in ('base', 'v1')").withColumn("total_return", F.lit(0.5)).withColumn("sharpe", F.lit(1.0)), "base").first()
    assert better.penalty == 0.0


def test_market_is_of_the_day_before(spark):
    rows = [(1, D[0], 0, 10.0, True), (1, D[1], 1, 11.0, False), (1, D[2], 2, 22.0, True), (2, D[0], 0, 10.0, False), (2, D[1], 1, 30.0, True), (2, D[2], 2, 15.0, True)]
    panel = spark.createDataFrame(rows, "instrument int, date date, day int, open double, eligible boolean")
    assert {r.date: round(r.market, 9) for r in C.market_proxy(panel).collect()} == {D[1]: 0.1, D[2]: -0.5}


def test_deduplicate(spark):
    pairs = spark.createDataFrame([("a", "b", 200, 0.95), ("a", "c", 200, 0.5), ("b", "c", 200, 0.1), ("a", "d", 10, 0.1), ("c", "e", 200, 0.2), ("a", "e", 200, None)], "f string, g string, common_days long, similarity double")
    told = C.deduplicate(["a", "b", "c", "d", "e", "f"], pairs, 120, 0.9, 20)
    assert [(c, ok, why) for c, ok, why in told] == [("a", True, []), ("b", False, ["duplicate of a"]), ("c", True, []), ("d", False, ["overlap with a", "overlap with c"]), ("e", True, []), ("f", False, ["overlap with a", "overlap with c", "overlap with e"])]
    assert [x[1] for x in C.deduplicate(["a", "c", "e"], pairs, 120, 0.9, 2)] == [True, True, False]
    family = C.deduplicate(["a", "c", "e"], pairs, 120, 0.9, 4, {"a": ["trend"], "c": ["trend"], "e": ["volume"]})
    assert [(x[1], x[2]) for x in family] == [(True, []), (False, ["family trend"]), (True, [])]


@pytest.fixture()
def series(spark):
    return lambda values: spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "instrument int, day int, v double")


def values(df, c):
    return [r[0] for r in df.withColumn("_r", c).orderBy("day").select("_r").collect()]


def test_tolerant_operators(series):
    df = series([1.0, None, 3.0, 3.0, 3.0, 0.0])
    z = (3 - 2) / 1.0  # of 1 and 3
    phi = lambda x: 0.5 * (1 + math.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))
    got = values(df, T.gaussian_rank("v", 3))
    assert got[:2] == [1.0, None] and math.isclose(got[2], phi(z) + 1) and got[4] == 1.0
    assert values(df, T.information_ratio("v", 3))[:5] == [None, None, pytest.approx(2 / math.sqrt(2)), None, None]
    assert values(df, T.change_ratio("v", 1)) == [0.0, None, 0.0, 0.0, 0.0, pytest.approx(-3 / 3.001)]
    assert values(df, T.extent("v", 3)) == [0.0, 0.0, 2.0, 0.0, 0.0, 3.0]
    assert values(series([0.0, 1.0, 2.0, 7.0]), T.skew("v", 4))[2] == pytest.approx(0.0) and values(series([0.0, 1.0]), T.skew("v", 4)) == [None, None]


def test_regime_maps(spark):
    df = spark.createDataFrame([(1.0, 1.5), (-1.0, 1.5), (0.0, 0.4), (3.0, 1.0), (0.0, -1.0), (None, 1.0)], "t double, b double")
    rows = df.select(G.exposure("t").alias("e"), G.hedge("t", "b").alias("h"), G.core_weight("t").alias("c")).collect()
    assert [r.e for r in rows] == [1.0, 0.5, 0.75, 1.0, 0.75, None] and [r.h for r in rows] == [0.0, 0.6, pytest.approx(0.3), 0.0, 0.0, None]
    assert [round(r.c, 9) for r in rows] == [0.7, 0.4, 0.55, 0.7, 0.55, 0.4]


def test_portfolio_beta_falls_back_to_the_prior(spark):
    held = spark.createDataFrame([(1, D[1], 0.5), (2, D[1], 0.5), (1, D[3], 1.0), (3, D[2], 0.0)], "instrument int, date date, weight double")
    betas = spark.createDataFrame([(1, D[0], 2.0), (1, D[1], 1.0), (1, D[3], 0.5), (2, D[2], 9.0)], "instrument int, date date, beta double")
    assert {r.date: r.beta for r in G.portfolio_beta(held, betas).collect()} == {D[1]: pytest.approx(0.5 * 1.0 + 0.5 * 1.3), D[2]: 1.3, D[3]: 0.5}


def test_funding_gate(spark):
    ts = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, ts(1, 0), 1, 0.1), (1, ts(1, 8), 2, 0.2), (1, ts(2, 0), 3, 0.3), (1, ts(3, 8), 4, 0.1), (2, ts(1, 1), 5, 0.2), (2, ts(2, 1), 6, 0.2), (2, ts(3, 1), 7, 0.2)]
    events = spark.createDataFrame(rows, "instrument int, ts timestamp, event_id int, rate double").withColumn("day", F.unix_date(F.to_date("ts")))
    dates = spark.createDataFrame([(d,) for d in D], "date date")
    got = {(r.instrument, r.date.day): (r.allowed, r.n_events) for r in G.funding_allowed(dates, events, 2, 0.8).collect()}
    # the midnight of the first day is out of the window of the third; equal rates are never below their own quantile
    assert got == {(1, 1): (False, 2), (1, 2): (False, 3), (1, 3): (True, 3), (1, 4): (False, 1), (2, 1): (False, 1), (2, 2): (False, 2), (2, 3): (False, 3), (2, 4): (False, 2)}


def test_net_stability_score_and_gates(spark):
    days = [dt.date(2024, m, 1) for m in (1, 2, 4, 5, 7, 8, 10, 11)]
    net = [0.1, 0.0, 0.2, -0.1, -0.05, 0.02, 0.03, 0.01]
    led = spark.createDataFrame([("a", d, x) for d, x in zip(days, net)] + [("flat", d, 0.0) for d in days], "variant string, date date, net double")
    got = {r.variant: r for r in C.net_stability(led, 4).collect()}
    a, wealth = got["a"], [1.0]
    for x in net:
        wealth.append(wealth[-1] * (1 + x))
    gains = [wealth[2 * k + 2] - wealth[2 * k] for k in range(4)]
    assert math.isclose(a.total_return, wealth[-1] - 1) and a.best_quarter == "2024Q1" and a.positive_quarters == 3 and a.n_quarters == 4
    assert math.isclose(a.concentration, gains[0] / sum(g for g in gains if g > 0)) and math.isclose(a.worst_quarter_return, 0.95 * 1.02 - 1)
    assert math.isclose(a.worst_drawdown, 0.1) and math.isclose(a.remaining_return, wealth[-1] / 1.1 - 1)
    flat = got["flat"]
    assert (flat.concentration, flat.sharpe, flat.best_quarter, flat.remaining_return) == (None, None, "2024Q4", 0.0)
    stable = C.net_stability(led, 4)
    score = {r.variant: r for r in C.cost_score(stable, {"a": 3, "flat": 1}).collect()}
    expected = a.median_sharpe - 0.5 * a.sd_sharpe - max(-a.worst_sharpe, 0) - a.worst_drawdown - 0.003 - 0.5 * max(a.concentration - 0.6, 0) - 0.5 * max(-a.remaining_sharpe, 0)
    assert math.isclose(score["a"].score, expected) and score["flat"].score is None and "return is not positive" in score["flat"].reasons
    gates = {r.variant: (r.passed, r.reasons) for r in C.cost_gates(stable, stable).collect()}
    assert gates["a"] == (True, "") and gates["flat"][1].startswith("too few quarters with a gain; little return")
