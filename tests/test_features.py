"""Feature builders on small tables: first and last rows, missing values, neutral residuals."""

import math

import numpy as np
import pytest

from quantloom.operators import features as X


def test_minutes(spark):
    rows = [(1, "d", 0, 0, 10.0, 12.0, 9.0, 11.0, 1.0), (1, "d", 1, 1, 11.0, 11.0, 11.0, 0.0, 3.0), (1, "d", 2, 2, 5.0, 6.0, 4.0, 5.5, None), (2, "d", 0, 0, 1.0, 1.0, 1.0, 1.0, 0.0)]
    m = spark.createDataFrame(rows, "instrument int, date string, ts int, seq int, open double, high double, low double, close double, volume double")
    got = {(r.instrument, r.seq): r for r in X.minute_indicators(m).collect()}
    a, b, c, d = got[1, 0], got[1, 1], got[1, 2], got[2, 0]
    assert (a.returns, a.spread, a.mid, a.body, a.upper_shadow, a.lower_shadow, a.cum_return) == (0.0, 3.0, 10.5, 1.0, 1.0, 1.0, 1.0)
    assert (b.returns, b.cum_return, c.returns) == (-0.5, 0.5, 5.0)  # clipped
    assert math.isclose(b.down_volume_pressure, 0.5 * 3 / 2, rel_tol=1e-6) and b.up_volume_pressure == 0.0 and c.volume_intensity is None
    assert d.close_position == 0.0 and d.volume_intensity == 0.0


@pytest.fixture(scope="module")
def weeks(spark):
    xs = [1.0, 3.0, None, -2.0, 5.0, 5.0, 0.5]
    return xs, spark.createDataFrame([(1, f"2024-01-0{k + 1}", k + 100, x) for k, x in enumerate(xs)], "instrument int, date string, day int, v double")


def test_temporal(weeks):
    xs, panel = weeks
    got = X.temporal(panel, "v", 3).orderBy("date").collect()
    assert [r.drawup for r in got] == [None, None, None, 0.0, 7.0, 7.0, 0.0] and [r.drawdown for r in got][3:] == [5.0, 0.0, 0.0, 4.5]
    assert [r["rank"] for r in got] == [None, None, None, None, None, 1.0, pytest.approx(1 / 3)]
    assert [r.accel for r in got][6] == pytest.approx((0.5 - -2.0) - (-2.0 - 1.0)) and got[5].accel is None
    ema, out = None, []
    for x in xs:
        ema = x if ema is None else ema if x is None else 0.5 * x + 0.5 * ema
        out.append(ema)
    assert [r.decay for r in got] == pytest.approx(out)
    last = np.array(xs[-3:])
    assert got[6].tstat == pytest.approx(last.mean() / (last.std() / math.sqrt(3))) and got[6].robust_zscore == -4.5  # no spread around the median
    assert got[3].persistence_ratio == 0.5 and got[3].event_count == 1.0


def test_daily_features_of_a_lone_instrument(spark):
    rows = [(1, f"2024-01-{k + 1:02d}", k, 10.0, 12.0, 9.0, 10.0 + k, 5.0, 50.0, 2.0) for k in range(12)]
    b = spark.createDataFrame(rows, "instrument int, date string, day int, open double, high double, low double, close double, volume double, amount double, turnover double")
    out = X.daily_features(b).orderBy("date").collect()
    assert list(out[0].asDict())[2:] == X.DAILY and len(X.DAILY) == 23
    assert out[0].returns is None and out[11].ret_10d == pytest.approx(21 / 11 - 1) and out[11].ret_20d is None and out[11].mkt_breadth == pytest.approx(1.0)
    assert out[3].volume_ratio is None and out[4].volume_ratio == pytest.approx(1.0) and out[11].price_acceleration == pytest.approx((21 / 16 - 1) - (16 / 11 - 1)) and out[5].beta_20d is None
    assert out[10].beta_20d == pytest.approx(1.0, rel=1e-2) and out[11].downside_vol == 0.0


def test_neutral_residuals(spark):
    rows = [("d", i, float(i * i), i % 2 == 0 and "a" or "b", float(i + 1), i != 9) for i in range(10)] + [("e", 0, 5.0, "a", 2.0, True), ("e", 1, 7.0, None, 3.0, True)]
    df = spark.createDataFrame(rows, "date string, instrument int, v double, sector string, size double, inside boolean")
    got = {(r.date, r.instrument): r.v for r in X.neutralized(df, "v", "inside", "sector", "size").collect()}
    y = np.array([i * i for i in range(9)], float)
    for parity in (0, 1):
        y[parity::2] -= y[parity::2].mean()
    s = np.log(np.arange(1, 10))
    d = s - s.mean()
    assert np.allclose([got["d", i] for i in range(9)], y - (d @ y) / (d @ d) * d) and got["d", 9] is None
    assert (got["e", 0], got["e", 1]) == (0.0, 7.0)  # two pairs are too few for a slope; no sector, no mean
