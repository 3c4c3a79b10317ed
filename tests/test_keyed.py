"""States that a stream keeps: late bars, idle instruments, micro-batches and a restart."""

import datetime as dt

import pytest

from quantloom.streaming import jobs, keyed

SCHEMA = "instrument long, ts timestamp, high double, low double, close double"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def bar(instrument, day):
    c = 10 + (day * 7 + instrument * 3) % 11
    return (instrument, at(day), c + 1.0, c - 1.0 - day % 3, float(c))


def expected(days_by_instrument, last, idle):
    """Bars in order of time; a gap of `idle` days begins anew."""
    out = []
    for i, days in days_by_instrument.items():
        state = None
        for d in sorted(days):
            if d > last:
                continue
            _, _, h, low, c = bar(i, d)
            if state is not None and d - state[0] // keyed.DAY >= idle:
                state = None
            state = keyed.carry(state, (d * keyed.DAY, h, low, c), 0.2, 4, 1.0)
            out.append((i, at(d), round(state[2], 9), state[1], state[9]))
    return sorted(out)


@pytest.fixture()
def streamed(spark, tmp_path):
    def run(files, idle=30, restart_after=None):
        progress = []

        def drain():
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
            with keyed.rocksdb(spark):
                progress.extend(jobs.drain(keyed.carried(stream, "2 days", idle=idle * keyed.DAY), f"{tmp_path}/out", f"{tmp_path}/state"))

        for k, rows in enumerate(files):
            spark.createDataFrame([bar(*r) for r in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            if k == restart_after:
                drain()
        drain()
        rows = spark.read.schema(keyed.OUT).parquet(f"{tmp_path}/out").collect()
        return sorted((r.instrument, r.ts, round(r.level, 9), r.n, r.side) for r in rows), progress

    return run


def test_late_bars_restart_and_idle_instruments(spark, streamed):
    # instrument 1 has a late bar (day 4 comes with day 5), 2 is idle from day 3 to 15
    files = [[(1, 1), (2, 1), (2, 3), (1, 3)], [(1, 5), (1, 4), (2, 2)], [(1, 6), (1, 7)], [(1, 9), (2, 15)], [(1, 16), (2, 16)], [(1, 20)]]
    got, progress = streamed(files, idle=10, restart_after=2)
    days = {1: [1, 3, 4, 5, 6, 7, 9, 16, 20], 2: [1, 2, 3, 15, 16]}
    assert got == expected(days, 18, 10)
    assert sum(p["numInputRows"] > 0 for p in progress) == len(files)
    assert [g[3] for g in got if g[0] == 2] == [1, 2, 3, 1, 2]  # begins anew after the gap
    with_store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert with_store != keyed.PROVIDER


def test_stop_turns_on_the_stop_of_the_bar_before():
    state, sides = None, []
    for h, low, c in [(10, 9, 9.5), (10, 9, 9.5), (9, 7, 7.0), (8, 7, 7.5), (12, 8, 11.9)]:
        state = keyed.carry(state, (0, h, low, c), 0.5, 4, 1.0)
        sides.append(state[9])
    assert sides == [1, 1, -1, -1, 1]


def test_snapshots_are_read_one_at_a_time(spark, tmp_path):
    path = str(tmp_path / "means")
    rows = lambda *r: spark.createDataFrame([(u, at(k), k, float(v)) for k, (u, v) in enumerate(r)], "user_id long, ts timestamp, event_id long, value double")
    jobs.running_mean(rows((1, 4), (1, 8), (2, 1)), 0.5, 0, path)
    jobs.running_mean(rows((1, 2)), 0.5, 1, path)
    jobs.running_mean(rows((3, 5), (1, 4)), 0.5, 2, path)
    jobs.running_mean(rows((3, 5), (1, 4)), 0.5, 2, path)  # the batch again
    assert {r.instrument: (r.level, r.n) for r in jobs.newest(spark, path).collect()} == {1: (4.0, 4), 2: (1.0, 1), 3: (5.0, 1)}
