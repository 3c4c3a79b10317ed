"""States kept by instrument in Spark's state store: a recursive mean and a trailing stop carried over micro-batches and restarts,
per-instrument progress, and duplicates within a second.

A bar may come late or out of order within the watermark, so bars wait in the store until the watermark passes their time; a
timer then folds what has become due, in time order. An instrument without bars for `idle` loses its state
(an event-time timer, the same for every run over the same bars). No job reads what earlier batches wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs this store; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


BAR = "at long, high double, low double, close double"
STATE = "last long, n long, level double, close double, atr double, highs array<double>, lows array<double>, long_stop double, short_stop double, side int"
OUT = "instrument long, ts timestamp, level double, n long, side int"


def carry(state: tuple | None, bar: tuple, weight: float, window: int, width: float) -> tuple:
    """The state after a bar: a mean of the closes, and the side of a stop `width` true ranges from the extremes of `window` bars, which
    turns when the close passes the stop of the bar before."""
    at, high, low, close = bar
    if state is None:
        n, level, atr, highs, lows, side = 1, close, high - low, [high], [low], 1
    else:
        _, n, level, before, atr, highs, lows, long_stop, short_stop, side = state
        n, level = n + 1, level * (1 - weight) + close * weight
        reach = max(high - low, abs(high - before), abs(low - before))
        atr = atr * (1 - 1 / window) + reach / window
        side = 1 if short_stop is not None and close > short_stop else -1 if long_stop is not None and close < long_stop else side
        highs, lows = [*highs, high][-window:], [*lows, low][-window:]
    known = len(highs) >= max(2, window // 2)
    return (at, n, level, close, atr, highs, lows, max(highs) - width * atr if known else None, min(lows) + width * atr if known else None, side)


class Carried(StatefulProcessor):
    """Bars in, one row per bar out once the watermark has passed it. An arrival sets one timer, at its first bar; a timer folds all bars
    that the watermark has passed and sets the next, so calls to the store grow with batches, not with bars."""

    def __init__(self, weight: float, window: int, width: float, idle: int):
        self.weight, self.window, self.width, self.idle = weight, window, width, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carried", STATE)
        self.waiting = handle.getListState("waiting", BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bars = [(r.at, r.high, r.low, r.close) for r in rows]
        self.waiting.appendList(bars)
        self.handle.registerTimer(min(b[0] for b in bars))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted(map(tuple, self.waiting.get()))
        due = [b for b in waiting if b[0] <= now]
        state = self.state.get()
        if not due:
            if state is not None and state[0] + self.idle <= now:
                self.state.clear()
            return
        rest = waiting[len(due) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        for bar in due:
            if state is not None and state[0] + self.idle <= bar[0]:
                state = None  # idle until then
            state = carry(state, bar, self.weight, self.window, self.width)
            yield Row(instrument=key[0], at=bar[0], level=state[2], n=state[1], side=state[9])
        self.state.update(state)
        self.handle.registerTimer(rest[0][0] if rest else state[0] + self.idle)

    def close(self) -> None:
        pass


def carried(bars: DataFrame, delay: str = "1 day", weight: float = 0.2, window: int = 4, width: float = 1.0, idle: int = 30 * DAY) -> DataFrame:
    """instrument, ts, level, n and side of a stream of bars (instrument, ts, high, low, close), one bar a time and instrument."""
    slim = bars.selectExpr("cast(instrument as long) instrument", "cast(ts as timestamp) ts", "unix_millis(cast(ts as timestamp)) at", "cast(high as double) high", "cast(low as double) low", "cast(close as double) close")
    keyed = slim.withWatermark("ts", delay).groupBy("instrument")
    out = keyed.transformWithState(Carried(weight, window, width, idle), "instrument long, at long, level double, n long, side int", "Append", "EventTime")
    return out.selectExpr("instrument", "timestamp_millis(at) ts", "level", "n", "side")
