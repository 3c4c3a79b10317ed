"""Queries against their SQL on rows that the given small tables lack: zero prices, instruments of five digits, halves, long products."""

import datetime as dt
import math
import random

import duckdb
import pytest

from quantloom.functions import scalar as S
from quantloom.operators import regime, rolling as R
from quantloom.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with events and lines, and DuckDB views of them."""
    at, rng, rows = str(tmp_path_factory.mktemp("odd")), random.Random(3), []
    for user in (7, 1234, 12340, 12345):
        for day in range(12):
            for k in range(3):
                value = 0.0 if (user + day) % 3 == 0 else rng.randrange(1, 9) / 100
                rows.append((len(rows), dt.datetime(2024, 1, 2) + dt.timedelta(days=day, minutes=len(rows)), user, ("error", "click", "view")[k], value, "{}"))
    for k in range(2500):  # one instrument's day that passes all bounds and comes back
        rows.append((len(rows), dt.datetime(2024, 1, 20) + dt.timedelta(seconds=k), 3, "view", (1.0 + 3 * (k % 2)) * (2.0 ** (min(k, 2500 - k) % 3)), "{}"))
    shape = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    return at, con


def key(row):
    return tuple(x if not isinstance(x, float) else "nan" if math.isnan(x) else x for x in row)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


NAMES = [
    "b02_future_return_log", "m14_drawup", "m14_drawdown", "s07_normalize_table", "b01_make_labels", "t06_roc", "s01_kline_payloads", "s02_completed_bars", "m09_minute_indicators", "t27_future_return",
    "m09_minute_indicator_set",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, odd, name):
    at, con = odd
    df = QUERIES[name](spark, at)
    want = con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    order = lambda rows: sorted(map(key, rows), key=lambda r: [(x is None, str(x)) for x in r])
    got, want = order(df.collect()), order(want)
    wrong = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert len(got) == len(want) and not wrong, wrong[:3]


def test_rounding_in_binary(spark):
    xs = [0.575, 0.545, 1.005, -0.575, 2.5, 0.1234567895, None, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.nearest("x", 2)).collect()]
    assert got == [duckdb.execute("select round(?::double, 2)", [x]).fetchall()[0][0] for x in xs]


def test_mean_of_equal_rates_is_that_rate(spark):
    """Sums of many equal rates round, so their mean fell below or above the quantile that it equals."""
    t = dt.datetime(2024, 1, 3, 8)
    rates = [k / 100000 for k in range(1, 1200, 7)]
    rows = [(i, t + dt.timedelta(minutes=k), 60 * i + k, rate, (t.date() - dt.date(1970, 1, 1)).days) for i, rate in enumerate(rates) for k in range(60)]
    events = spark.createDataFrame(rows, "instrument long, ts timestamp_ntz, event_id long, rate double, day int").repartition(7)
    dates = spark.createDataFrame([(t.date(),)], "date date")
    got = regime.funding_allowed(dates, events, 10, 0.8).collect()
    assert len(got) == len(rates)
    assert all(r["recent"] == r["cut"] == rates[r["instrument"]] and not r["allowed"] for r in got)


@pytest.mark.parametrize("n, a, b", [(12, 1, 112), (14, 1, 6), (17, 1, 17), (19, 1, 17)])
def test_the_liquidity_cut_stays_between_sums_a_bit_apart(spark, tmp_path, n, a, b):
    """Two names with the same week of volume, whose sums differ in their last bit, on both sides of the cut (F12)."""
    con = duckdb.connect()
    names = [(1, 4, a / 100), (1, 5, b / 100), (2, 5, (a + b) / 100), (0, 5, 0.01), *((k, 5, 5.0 + k) for k in range(3, n))]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-0{d} 10:00:00', {u}, 'view', {v}::DOUBLE, '{{}}')" for i, (u, d, v) in enumerate(names))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(SQL["p12_liquidity_mask"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["p12_liquidity_mask"](spark, str(tmp_path)).collect()) == want


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """Events of users of three to five digits, some with the same first four, and a DuckDB view of them."""
    at, con = str(tmp_path_factory.mktemp("long_keys")), duckdb.connect()
    users = (3, 120, 1234, 12340, 12345, 30003)
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-{1 + i % 20:02d} 10:00:00', {users[i % 6]}, '{('error', 'view')[i % 5 > 2]}', {20 + i % 7 / 100}::DOUBLE, '{{}}')" for i in range(360))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{at}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["s12_membership_windows", "s15_glob_of_csv_files"])
def test_symbols_show_four_digits(spark, long_keys, name):
    """The SQL shows a symbol's first four digits, so users of five digits meet there (F10, F11)."""
    at, con = long_keys
    df = QUERIES[name](spark, at)
    want = con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want) and got


def test_a_mean_that_equals_the_funding_cut_falls_as_in_the_sql(spark, tmp_path):
    """Days of two rates whose mean is the cut between two others: the last bit of the cut decides (F3)."""
    ties = [(4, 64, 104, 56), (4, 197, 237, 189), (4, 211, 316, 190), (5, 50, 90, 26), (5, 57, 97, 33), (5, 99, 139, 75), (5, 120, 160, 96), (9, 64, 104, 56), (9, 211, 316, 190)]
    con, rows = duckdb.connect(), []
    for user, (n, low, high, x) in enumerate(ties):
        at = math.floor((n - 1) * 0.8)
        before = [low, *[1] * (at - 1), *[1000] * (n - at - 2)]
        rows += [(2, user, v) for v in before] + [(3, user, high), (3, user, x)]
    events = ", ".join(f"({i}, TIMESTAMP '2024-01-0{d} 10:00:00' + INTERVAL {i} SECOND, {u}, 'error', {v / 100}::DOUBLE, '{{}}')" for i, (d, u, v) in enumerate(rows))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {events}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["b11_funding_allowed"](spark, str(tmp_path))
    want = sorted(con.execute(f"select {', '.join(df.columns)} from ({SQL['b11_funding_allowed']})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and len({r[2] for r in want if r[1].day == 3}) == 2


def test_product_and_sum_rounded_once(spark):
    rng = random.Random(5)
    xs = [tuple(rng.choice((-1, 1)) * rng.expovariate(1) * 10.0 ** rng.randrange(-6, 7) for _ in range(3)) for _ in range(2000)] + [(0.1, 10.0, -1.0), (0.0, 3.0, 2.0)]
    got = [r[0] for r in spark.createDataFrame(xs, "a double, b double, c double").select(S.fused("a", "b", "c")).collect()]
    assert got == [math.fma(*x) for x in xs]


def test_rates_of_a_date_are_added_up_in_the_order_of_events(spark):
    """Whatever the order in which rows come, a mean has the last bit that the events' own order gives (F3)."""
    rng, t = random.Random(8), dt.datetime(2024, 1, 3, 8)
    rates = [[rng.randrange(1, 30000) / 100000 for _ in range(4)] for _ in range(400)]
    rows = [(i, t + dt.timedelta(minutes=k), 4 * i + k, rate, (t.date() - dt.date(1970, 1, 1)).days) for i, four in enumerate(rates) for k, rate in enumerate(four)]
    events = spark.createDataFrame(rows[::-1], "instrument long, ts timestamp_ntz, event_id long, rate double, day int").repartition(7)
    dates = spark.createDataFrame([(t.date(),)], "date date")
    got = {r["instrument"]: r["recent"] for r in regime.funding_allowed(dates, events, 10, 0.8).collect()}
    assert got == {i: (((a + b) + c) + d) / 4 for i, (a, b, c, d) in enumerate(rates)}


def test_correlation_of_two_days_is_one(spark):
    """Steps of a millionth of the values: the quotient of moments was off by up to 1e-9, enough to split ranks to nine places (F4)."""
    rng = random.Random(4)
    rows = [(i, d, 5 + rng.random() * 1e-5, 20 + rng.random() * 1e-5) for i in range(2000) for d in range(2)]
    panel = spark.createDataFrame(rows, "instrument int, day int, x double, y double")
    got = [r[0] for r in panel.select("day", R.ts_corr("x", "y", 2).alias("c")).filter("day = 1 and c is not null").select("c").collect()]
    sign = {i: (rows[2 * i + 1][2] - rows[2 * i][2]) * (rows[2 * i + 1][3] - rows[2 * i][3]) > 0 for i in range(2000)}
    assert set(got) == {1.0, -1.0} and len(got) > 900 and abs(got.count(1.0) - sum(sign.values())) <= 2000 - len(got)
