"""Intraday operators: minutes of one (instrument, period) to one value, and path-dependent daily states.

Minutes are rows (instrument, date, ts, seq, a, b). Statistics are grouped aggregates; those that need the order inside a
period use one window sorted by time. Path-dependent states are carried along an instrument's history, one batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quantloom.functions.scalar import clip, divide, safe_div
from quantloom.operators import rolling as R

KEY = ("instrument", "date")


def in_period():
    return Window.partitionBy(*KEY)


def in_time():
    return Window.partitionBy(*KEY).orderBy("ts", "seq")


def resample(minutes: DataFrame) -> DataFrame:
    """Period bars: first, last, extremes, sum and the clipped return of the last values."""
    at = F.struct("ts", "seq")
    bars = minutes.groupBy(*KEY).agg(
        F.min_by("a", at).alias("open"), F.max("a").alias("high"), F.min("a").alias("low"), F.max_by("a", at).alias("close"), F.sum("b").alias("volume"), F.count("*").alias("n")
    )
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("date"))
    return bars.withColumn("ret", clip(F.try_divide("close", before) - 1, -0.5, 5.0))


def last_minutes(minutes: DataFrame, n: int) -> DataFrame:
    """The last n rows of each period."""
    back = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("seq")))
    return minutes.withColumn("_r", back).filter(F.col("_r") <= n).drop("_r")


def quantile_mask(minutes: DataFrame, field: str, q: float, high: bool = True) -> DataFrame:
    """Rows whose rank in the period, as (rank - 1) / (n - 1), is at least q (or at most 1 - q)."""
    p = F.percent_rank().over(in_period().orderBy(field, "ts", "seq"))
    m = minutes.withColumn("_p", p)
    return m.filter(F.col("_p") >= q if high else F.col("_p") <= 1 - q).drop("_p")


def indicators(minutes: DataFrame) -> DataFrame:
    """Per row: return, log of b, b against the period's mean, return so far, and signed flow."""
    before = F.lag("a").over(in_time())
    m = minutes.withColumn("ret", divide("a", before) - 1)
    first = F.min_by("a", F.struct("ts", "seq")).over(in_period())
    return m.withColumn("log_b", F.log1p("b")).withColumn("intensity", divide("b", F.avg("b").over(in_period()))).withColumn("cum_return", divide("a", first) - 1).withColumn("signed_flow", F.nanvl(F.signum(F.coalesce("ret", F.lit(0.0))), F.lit(0.0)) * F.col("b"))


def day_slots(minutes: DataFrame) -> DataFrame:
    """Per period: path efficiency, where high and low lie in time, returns before and after noon, late share of b."""
    at = F.struct("ts", "seq")
    m = minutes.withColumn("_step", F.abs(F.col("a") - F.lag("a").over(in_time()))).withColumn("_t", F.hour("ts") + F.minute("ts") / 60).withColumn("_am", F.hour("ts") < 12)
    first, last = F.min_by("a", at), F.max_by("a", at)
    hi, lo = F.max_by("_t", F.struct("a", -F.col("seq"))), F.min_by("_t", F.struct("a", "seq"))
    part = lambda c: (safe_div(F.max_by("a", F.when(c, at)), F.min_by("a", F.when(c, at))) - 1)
    return m.groupBy(*KEY).agg(
        safe_div(F.abs(last - first), F.sum("_step")).alias("path_efficiency"), (hi / 24).alias("high_time"), (lo / 24).alias("low_time"), (hi < lo).cast("int").alias("high_first"),
        part(F.col("_am")).alias("am_return"), part(~F.col("_am")).alias("pm_return"), safe_div(F.sum(F.when(~F.col("_am"), F.col("b"))), F.sum("b")).alias("late_share"),
    )


def true_range() -> Column:
    pc = R.ref("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def technical(bars: DataFrame, n: int = 5) -> DataFrame:
    """True range, ATR, RSI, stochastic K, CCI and MACD histogram."""
    b = bars.withColumn("tr", true_range()).withColumn("_d", R.diff("close", 1)).withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_dn", F.greatest(-F.col("_d"), F.lit(0.0)))
    b = b.withColumn("_up", F.when(F.col("_d").isNotNull(), F.col("_up"))).withColumn("_dn", F.when(F.col("_d").isNotNull(), F.col("_dn")))
    b = R.recursive_pass(b, atr=("tr", 1 / n), _ru=("_up", 1 / n), _rd=("_dn", 1 / n), _fast=("close", 2 / (n + 1)), _slow=("close", 2 / (2 * n + 1)))
    b = R.recursive_pass(b.withColumn("_macd", F.col("_fast") - F.col("_slow")), _signal=("_macd", 2 / 4))
    return b.select(
        *KEY, "tr", "atr", (100 * safe_div("_ru", F.col("_ru") + F.col("_rd"))).alias("rsi"), (100 * safe_div(F.col("close") - R.ts_min("low", n), R.ts_max("high", n) - R.ts_min("low", n))).alias("stochastic"),
        safe_div(F.col("_tp") - R.ts_mean("_tp", n), 0.015 * R.ts_mad("_tp", n)).alias("cci"), (F.col("_macd") - F.col("_signal")).alias("macd"),
    )


def followed(df: DataFrame, columns: Sequence[str], start: Callable[[], object], step: Callable, outputs: str, keep: Sequence[str] = KEY) -> DataFrame:
    """`keep` (instrument and date) and `outputs` (a DDL list) of every row: step(state, *columns) -> (state, outputs), called in order of day
    from start() for each instrument. Instruments are dealt over partitions sorted by day, and the state goes along from batch to
    batch, so a task holds one batch however long a history is."""
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            rows = []
            for who, *values in zip(*(b.column(c).to_pylist() for c in ("instrument", *columns))):
                if who != now:
                    now, state = who, start()
                state, out = step(state, *values)
                rows.append(out)
            cols = [pa.array(v, kinds.field(n).type) for v, n in zip(zip(*rows), names)] if rows else [pa.array([], kinds.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *names])

    shape = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(outputs).fields])
    kinds = to_arrow_schema(shape)
    rows = df.select(*dict.fromkeys([*keep, "instrument", "day", *columns])).repartition("instrument").sortWithinPartitions("instrument", "day")
    return rows.mapInArrow(run, shape)


def placeholders(bars: DataFrame) -> DataFrame:
    """Bars without volume whose four prices are one."""
    return bars.filter("volume = 0 and open = high and high = low and low = close")


def days_since_change(df: DataFrame, state: str) -> DataFrame:
    """Rows since `state` last changed."""
    w = Window.partitionBy("instrument").orderBy("date")
    changed = F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(True))
    df = df.withColumn("_run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("since", F.row_number().over(Window.partitionBy("instrument", "_run").orderBy("date")) - 1).drop("_run")


def lagged_size(panel: DataFrame, size: str, turnover: str, cap: str, n: int = 20) -> DataFrame:
    """Yesterday's size, its rank on that date, its z-score over n days, and turnover over capital, for each of today's rows."""
    w = Window.partitionBy("date")
    rank = (F.rank().over(w.orderBy(size)) + (F.count("*").over(Window.partitionBy("date", size)) - 1) / 2) / F.count(size).over(w)
    z = safe_div(F.col(size) - R.ts_mean(size, n), R.ts_std(size, n))
    before = panel.select("instrument", (F.col("day") + 1).alias("day"), F.col(size).alias("size"), rank.alias("size_rank"), z.alias("size_z"), (F.col(turnover) / F.col(cap)).alias("turn"))
    return panel.select("instrument", "day", "date").join(before, ["instrument", "day"], "left").drop("day")
