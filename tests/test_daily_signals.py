"""Daily states against loops that follow their definitions, on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import daily_signals as D, rolling as R


def prices(n, seed):
    rnd, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = c
        c = max(1.0, c * (1 + rnd.gauss(0, 0.05)))
        out.append((o, max(o, c) * (1 + rnd.random() / 30), min(o, c) * (1 - rnd.random() / 30), c))
    return out


BARS = {1: prices(60, 1), 2: prices(45, 2), 3: [(5.0, 5.0, 5.0, 5.0)] * 4, 4: prices(1, 3)}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(i, f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}", 10 + k + (k // 7), *p) for i, ps in BARS.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "instrument long, date string, day int, open double, high double, low double, close double")
    return df.withColumn("date", F.to_date("date"))


def by_instrument(df, *columns):
    out = {}
    for r in df.orderBy("instrument", "date").collect():
        out.setdefault(r["instrument"], []).append(tuple(r[c] for c in columns))
    return out


def true_ranges(p):
    return [max(h - low, abs(h - p[max(k - 1, 0)][3]), abs(low - p[max(k - 1, 0)][3])) for k, (_, h, low, _) in enumerate(p)]


def recursive(xs, w):
    out = []
    for x in xs:
        out.append(x if not out else out[-1] * (1 - w) + x * w)
    return out


def close(a, b):
    assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (a, b)


def test_parabolic(bars):
    got = by_instrument(D.parabolic(bars), "sar")
    for i, p in BARS.items():
        sar, up, af, ep = [p[0][2]], True, 0.02, p[0][1]
        for t in range(1, len(p)):
            s = sar[-1] + af * (ep - sar[-1])
            if t >= 2:
                s = min(s, p[t - 1][2], p[t - 2][2]) if up else max(s, p[t - 1][1], p[t - 2][1])
            flip = p[t][2] < s if up else p[t][1] > s
            if flip:
                s, up, af = ep, not up, 0.02
                ep = p[t][1] if up else p[t][2]
            elif (p[t][1] > ep) if up else (p[t][2] < ep):
                ep, af = (p[t][1] if up else p[t][2]), min(af + 0.02, 0.2)
            sar.append(s)
        for a, b in zip(got[i], sar):
            close(a[0], b)


def test_supertrend_carries_both_bands(bars):
    got = by_instrument(D.supertrend(bars, 5, 1.0), "side", "upper", "lower")
    for i, p in BARS.items():
        atr = recursive(true_ranges(p), 1 / 5)
        up, down = [(h + low) / 2 + a for (_, h, low, _), a in zip(p, atr)], [(h + low) / 2 - a for (_, h, low, _), a in zip(p, atr)]
        fu, fl, side = [up[0]], [down[0]], [1]
        for t in range(1, len(p)):
            fu.append(up[t] if up[t] < fu[-1] or p[t - 1][3] > fu[-1] else fu[-1])
            fl.append(down[t] if down[t] > fl[-1] or p[t - 1][3] < fl[-1] else fl[-1])
            side.append(1 if p[t][3] > fu[t - 1] else -1 if p[t][3] < fl[t - 1] else side[-1])
        assert [x[0] for x in got[i]] == side
        for x, a, b in zip(got[i], fu, fl):
            close(x[1], a), close(x[2], b)


def test_states(bars):
    got = by_instrument(D.states(bars), "ce_side", "long_stop", "pmax_side", "pmax_line", "pmax_days", "qqe_progress", "oversold")
    for i, p in BARS.items():
        tr, c = true_ranges(p), [x[3] for x in p]
        a22, a10, e10 = recursive(tr, 1 / 22), recursive(tr, 1 / 10), recursive(c, 2 / 11)
        window = lambda xs, t, n: xs[max(0, t - n + 1) : t + 1]
        long_stop = [max(x[1] for x in window(p, t, 22)) - 3 * a22[t] if t >= 10 else None for t in range(len(p))]
        short_stop = [min(x[2] for x in window(p, t, 22)) + 3 * a22[t] if t >= 10 else None for t in range(len(p))]
        ce, pm, days = [1], [1], [0]
        for t in range(1, len(p)):
            ce.append(1 if short_stop[t - 1] is not None and c[t] > short_stop[t - 1] else -1 if long_stop[t - 1] is not None and c[t] < long_stop[t - 1] else ce[-1])
            pm.append(1 if c[t] > e10[t - 1] + 3 * a10[t - 1] else -1 if c[t] < e10[t - 1] - 3 * a10[t - 1] else pm[-1])
            days.append(0 if pm[t] != pm[t - 1] else days[-1] + 1)
        diff = [0.0] + [y - x for x, y in zip(c, c[1:])]
        gain, loss = recursive([max(x, 0.0) for x in diff], 1 / 14), recursive([max(-x, 0.0) for x in diff], 1 / 14)
        rsi = [100 - 100 / (1 + g / (x + 1e-8)) - 50 for g, x in zip(gain, loss)]
        signal = recursive(rsi, 2 / 6)
        hist = [a - b for a, b in zip(signal, recursive(signal, 2 / 15))]
        sign = [(x > 0) - (x < 0) for x in hist]
        count, last, progress = 0, sign[0], [0.0]
        for s in sign[1:]:
            count = min(count + 1, 3) if s and last and s != last else count
            last = s or last
            progress.append(count / 3)
        for t, x in enumerate(got[i]):
            assert (x[0], x[2], x[4]) == (ce[t], pm[t], days[t])
            close(x[1], long_stop[t]), close(x[3], (e10[t] - 3 * a10[t]) if pm[t] > 0 else (e10[t] + 3 * a10[t])), close(x[5], progress[t])


def test_memory_fades_from_the_last_trigger(spark):
    df = spark.createDataFrame([(1, k, k, t) for k, t in enumerate([False, True, None, False, True], 1)], "instrument long, day int, _k int, hit boolean")
    assert [round(r.m, 6) for r in df.select("day", D.memory(F.col("hit"), 0.9).alias("m")).orderBy("day").collect()] == [0.0, 1.0, 0.9, 0.81, 1.0]


def test_states_stay_in_the_jvm(bars):
    plan = D.states(bars)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_signals_have_all_names_and_bounds(bars):
    out = D.signals(bars)
    assert out.columns == ["instrument", "date", *D.SIGNALS] and len(D.SIGNALS) == 19
    rows = out.collect()
    assert len(rows) == sum(map(len, BARS.values()))
    assert all(v is None or abs(v) <= 1e6 for r in rows for v in r[2:])
    # flat prices have no trend, no push and no entries
    flat = [r for r in rows if r.instrument == 3]
    assert {r.V8_base for r in flat} == {0.0} and {r.V2_base for r in flat} <= {0.0}


def test_recursive_means_go_along_in_one_pass(spark):
    """A mean of a mean in the same pass, nulls and a history longer than a batch; no row carries its history as an array."""
    rng = random.Random(5)
    rows = [(i, k, None if (k < 3 and i == 1) or rng.random() < 0.1 else rng.random()) for i in (1, 2, 3) for k in range(700)]
    df = spark.createDataFrame(rows, "instrument long, day int, x double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = R.recursive_pass(df, m=("x", 0.01), mm=("m", 0.3))
        got = {(r["instrument"], r["day"]): (r["m"], r["mm"]) for r in out.collect()}
        folded = {(r["instrument"], r["day"]): (r["m"], r["mm"]) for r in R.recursive(df, m=("x", 0.01), mm=("m", 0.3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    for i in (1, 2, 3):
        m = mm = None
        for _, k, x in sorted(r for r in rows if r[0] == i):
            m = x if m is None else m if x is None else 0.01 * x + 0.99 * m
            mm = m if mm is None else 0.3 * m + 0.7 * mm
            assert (m is None) == (got[i, k][0] is None)
            assert folded[i, k] == (None, None) if m is None else all(abs(x - y) < 1e-12 for x, y in zip(folded[i, k], (m, mm)))
            assert m is None or (abs(m - got[i, k][0]) < 1e-12 and abs(mm - got[i, k][1]) < 1e-12)
