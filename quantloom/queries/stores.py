"""Queries over stored tables: planned scans, values used again by what they were made of, the table of minutes, users' factors, and
states that a stream keeps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from quantloom import views
from quantloom.operators import rolling as R
from quantloom.plans import catalogue, formula, registry, scan
from quantloom.queries.common import add, r
from quantloom.sources import minutes, reuse, tables
from quantloom.streaming import jobs, keyed

DY = views.BARS_DY
START, END = date(1996, 3, 1), date(1996, 8, 31)
RANGE = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
NAMES = ["apb", "volatility_efficiency", "lib_clv_delta"]
TREES = {n: catalogue.FACTORS[n].formula for n in NAMES}


def daily(s, d) -> str:
    """Daily bars stored by month."""
    at = tables.scratch(s, "bars")
    scan.write(views.bars_dy(s, d), at)
    return at


add("g26_planned_range", lambda s, d: scan.evaluate(s, daily(s, d), NAMES, START, END), f"SELECT * FROM ({formula.sql(DY, TREES)}) WHERE {RANGE}")


# users' factors


@registry.factor(fields=["close", "volume"], warmup=4)
def user_volume_weighted_move(panel: DataFrame, params) -> Column:
    """Today's close against the volume-weighted close of five days."""
    w = R.window(5)
    paid = F.sum(F.col("close") * F.col("volume")).over(w) / F.sum("volume").over(w)
    return R.full("close", 5, F.col("close") / paid - 1)


@registry.factor(fields=["high", "low"], warmup=9, direction=-1, days=10)
def user_widest_range(panel: DataFrame, params) -> Column:
    """The widest day of the last few, as a share of its low."""
    return R.full("high", params["days"], F.max((F.col("high") - F.col("low")) / F.col("low")).over(R.window(params["days"])))


_USER = ["user_volume_weighted_move", "user_widest_range"]
_OVER5 = "(PARTITION BY instrument ORDER BY day RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"
_OVER10 = "(PARTITION BY instrument ORDER BY day RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"
_USER_SQL = f"""SELECT instrument, date, {r(f'CASE WHEN count(close) OVER {_OVER5} >= 5 THEN close / (sum(close * volume) OVER {_OVER5} / sum(volume) OVER {_OVER5}) - 1 END', _USER[0])},
  {r(f'CASE WHEN count(high) OVER {_OVER10} >= 10 THEN max((high - low) / low) OVER {_OVER10} END', _USER[1])} FROM bars"""
add(
    "u14_user_factors_beside_the_catalogue",
    lambda s, d: scan.evaluate(s, daily(s, d), [*_USER, "volatility_efficiency"], START, END),
    f"SELECT u.*, c.volatility_efficiency FROM (WITH {DY} {_USER_SQL}) u JOIN ({formula.sql(DY, {'volatility_efficiency': TREES['volatility_efficiency']})}) c USING (instrument, date) WHERE {RANGE}",
)
add(
    "u14_output_check",
    lambda s, d: registry.check_output(registry.evaluate((b := views.bars_dy(s, d)).unionByName(b.filter("instrument = 0 and day % 7 = 0")), [_USER[1]]), [_USER[1]]),
    f"""WITH {DY}, b AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE instrument = 0 AND day % 7 = 0), v AS (SELECT instrument, date, CASE WHEN count(high) OVER w >= 10 THEN 1 END AS x FROM b WINDOW w AS {_OVER10})
    SELECT '{_USER[1]}' AS factor, count(*) AS n_rows, (SELECT count(*) FROM (SELECT 1 FROM v GROUP BY instrument, date HAVING count(*) > 1)) AS repeated, count(*) FILTER (WHERE x IS NULL) AS missing, 0 AS not_finite FROM v""",
)


# values used again


def _served(s, d):
    """Values asked for three times: computed, used again for a shorter range, computed once more after an input has changed."""
    at, store = daily(s, d), tables.scratch(s, "values")
    first = reuse.serve(s, at, store, NAMES, START, END)
    again = reuse.serve(s, at, store, NAMES, START, date(1996, 6, 30))
    more = views.bars_dy(s, d).filter(F.col("date") == F.lit(END)).select("*", F.date_format("date", "yyyy-MM").alias(scan.MONTH))
    more.withColumn("instrument", -1 - F.col("instrument")).write.mode("append").partitionBy(scan.MONTH).parquet(at)
    third = reuse.serve(s, at, store, NAMES, START, END)
    told = [("first", first), ("again", again), ("changed", third)]
    out = None
    for name, x in told:
        row = x.values.agg(F.count("*").alias("n_rows"), F.count(NAMES[1]).alias("n_values"), F.max("date").alias("last")).select(F.lit(name).alias("asked"), F.lit(x.reused).alias("reused"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_VALUES = f"SELECT * FROM ({formula.sql(DY, {NAMES[1]: TREES[NAMES[1]]})}) WHERE {RANGE}"
add(
    "s19_reuse_by_validity",
    _served,
    f"""WITH v AS ({_VALUES}), n AS (SELECT count(*) AS more FROM ({_VALUES}) WHERE date = DATE '{END}')
    SELECT 'first' AS asked, false AS reused, count(*) AS n_rows, count({NAMES[1]}) AS n_values, max(date) AS last FROM v
    UNION ALL SELECT 'again', true, count(*), count({NAMES[1]}), max(date) FROM v WHERE date <= DATE '1996-06-30'
    UNION ALL SELECT 'changed', false, count(*) + any_value(more), count({NAMES[1]}), max(date) FROM v, n""",
)


# minutes: few buckets suit these small days
BUCKETS = 4


def _minutes(s, d):
    """Events as minutes, stored in two writes: the later days have one field more."""
    at = tables.scratch(s, "minutes")
    e = views.read(s, d, "events").select(F.col("user_id").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.pmod("event_id", F.lit(97)) + 1).cast("double").alias("volume"))
    late = F.to_date("ts") >= F.lit("2024-01-16")
    minutes.write(e.filter(~late), at, BUCKETS)
    minutes.write(e.filter(late).withColumn("open_interest", F.col("price") * 10), at, BUCKETS)
    return at


add(
    "s24_minutes_of_some_instruments",
    lambda s, d: minutes.read(s, _minutes(s, d), ["price", "open_interest", "spread"], date(2024, 1, 10), date(2024, 1, 20), [3, 5, 8], ["open_interest", "spread"], BUCKETS),
    f"""SELECT user_id AS instrument, ts, ts::DATE AS date, {r('value', 'price')}, {r("CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value * 10 END", 'open_interest')}, {r('NULL', 'spread')}
    FROM events WHERE user_id IN (3, 5, 8) AND ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""",
)
add(
    "s24_daily_sums_of_minutes",
    lambda s, d: minutes.read(s, _minutes(s, d), ["price", "volume"], date(2024, 1, 10), date(2024, 1, 20), buckets=BUCKETS).groupBy("instrument", "date").agg(F.count("*").alias("n"), F.sum(F.col("price") * F.col("volume")).alias("traded")),
    f"SELECT user_id AS instrument, ts::DATE AS date, count(*) AS n, {r('sum(value * (event_id % 97 + 1))', 'traded')} FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY ALL",
)


# keyed states

#: Files of a set.
FILES = 8


def _carried(s, d):
    """Daily bars as four sets of files in order of time, a micro-batch each; the stream stops after two and starts again from its
    checkpoint when the others have come."""
    at, b = tables.scratch(s, "carried"), views.bars_ev(s, d).select("instrument", F.col("date").cast("timestamp").alias("ts"), "high", "low", "close", "day")
    bounds = b.agg(F.min("day"), F.max("day")).first()
    step = (bounds[1] - bounds[0]) // 4 + 1
    for some in ((0, 1), (2, 3)):
        for k in some:
            b.filter(F.floor((F.col("day") - bounds[0]) / step) == k).drop("day").repartition(FILES).write.parquet(f"{at}/in/{k}")
        stream = s.readStream.schema(b.drop("day").schema).option("maxFilesPerTrigger", FILES).parquet(f"{at}/in/*")
        with keyed.rocksdb(s):
            jobs.drain(keyed.carried(stream), f"{at}/out", f"{at}/state")
    out = s.read.schema(keyed.OUT).parquet(f"{at}/out")
    return out.select("instrument", F.to_date("ts").alias("date"), "level", "n", "side")


_RANGE4 = "(PARTITION BY instrument ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
add(
    "x07_keyed_states",
    _carried,
    f"""WITH RECURSIVE {views.BARS_EV}, t AS (SELECT *, row_number() OVER w AS k, coalesce(lag(close) OVER w, close) AS pc FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY day)),
    e AS (SELECT instrument, k, close AS level, high - low AS atr FROM t WHERE k = 1
      UNION ALL SELECT t.instrument, t.k, e.level * 0.8 + t.close * 0.2, e.atr * 0.75 + greatest(t.high - t.low, abs(t.high - t.pc), abs(t.low - t.pc)) / 4 FROM e JOIN t ON t.instrument = e.instrument AND t.k = e.k + 1),
    b AS (SELECT *, CASE WHEN count(*) OVER {_RANGE4} >= 2 THEN max(high) OVER {_RANGE4} - atr END AS below, CASE WHEN count(*) OVER {_RANGE4} >= 2 THEN min(low) OVER {_RANGE4} + atr END AS above FROM t JOIN e USING (instrument, k)),
    c AS (SELECT *, CASE WHEN close > lag(above) OVER w THEN 1 WHEN close < lag(below) OVER w THEN -1 END AS crossed FROM b WINDOW w AS (PARTITION BY instrument ORDER BY k))
    SELECT instrument, date, {r('level', 'level')}, k AS n, coalesce(last_value(crossed IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS side
    FROM c QUALIFY date <= (SELECT max(date) FROM bars) - INTERVAL 1 DAY""",
)
