"""Panel views of the given tables, and the same views as SQL for the oracles.

A panel is long: one row per (instrument, date), with `day` (days since 1970) to order and range over. Windows are ranges
of calendar days, so gaps need no filling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of `events`: instrument user_id; prices are values; rate, where there is one, from error events."""
    at = F.struct("ts", "event_id")
    e = read(spark, sf_dir, "events")
    bars = e.groupBy(F.col("user_id").alias("instrument"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.round(F.sum("value"), 6).alias("volume"),
        F.round(F.sum(F.col("value") * (1 + F.pmod(F.col("event_id"), F.lit(5)))), 6).alias("quote_volume"),
        F.count("*").alias("trade_count"),
        F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)), 6).alias("taker_volume"),
        F.round(F.sum(F.when(F.col("event_type") == "error", F.col("value") / 1000)), 9).alias("rate"),
    )
    return bars.withColumn("day", F.unix_date("date"))


BARS_EV = """bars AS (
  SELECT user_id AS instrument, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, round(sum(value), 6) AS volume,
         round(sum(value * (1 + event_id % 5)), 6) AS quote_volume, count(*) AS trade_count,
         round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS taker_volume,
         round(sum(CASE WHEN event_type = 'error' THEN value / 1000 END), 9) AS rate,
         (ts::DATE - DATE '1970-01-01')::INTEGER AS day
  FROM events GROUP BY user_id, ts::DATE
)"""


def bars_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of `lineitem`: instrument l_suppkey; price is the extended price a unit."""
    at, price = F.struct("l_orderkey", "l_linenumber"), F.col("l_extendedprice") / F.col("l_quantity")
    buy = F.col("l_returnflag") == "N"
    li = read(spark, sf_dir, "lineitem").withColumn("p", price)
    bars = li.groupBy(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 4).alias("quote_volume"), F.count("*").alias("trade_count"),
        F.sum(F.when(buy, F.col("l_quantity")).otherwise(0.0)).alias("taker_volume"), F.round(F.sum(F.when(buy, F.col("l_extendedprice")).otherwise(0.0)), 4).alias("taker_quote_volume"),
    )
    return bars.withColumn("day", F.unix_date("date"))


BARS_LI = """bars AS (
  SELECT l_suppkey AS instrument, l_shipdate::DATE AS date,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 4) AS quote_volume, count(*) AS trade_count,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS taker_volume,
         round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END), 4) AS taker_quote_volume,
         (l_shipdate::DATE - DATE '1970-01-01')::INTEGER AS day
  FROM lineitem GROUP BY l_suppkey, l_shipdate::DATE
)"""


def flows_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular events: instrument, ts, date, day, rate (value / 1000, null where not positive), kind."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("instrument"), "ts", F.to_date("ts").alias("date"), F.unix_date(F.to_date("ts")).alias("day"),
        (F.col("value") / 1000).alias("rate"), F.col("event_type").alias("kind"), "event_id",
    )


FLOWS_EV = """flows AS (
  SELECT user_id AS instrument, ts, ts::DATE AS date, (ts::DATE - DATE '1970-01-01')::INTEGER AS day, value / 1000 AS rate,
         event_type AS kind, event_id FROM events
)"""

#: Members of a week: instruments with at least 40 in summed value in the week before.
MEMBER_MIN = 40.0


def members_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly universe intervals: instrument, decision_date, effective_date, effective_end_date (null for the last week)."""
    week = F.to_date(F.date_trunc("week", "ts"))
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instrument"), week.alias("week")).agg(F.round(F.sum("value"), 6).alias("total"))
    last = e.select(F.max("week").alias("last_week"))
    m = e.filter(F.col("total") >= MEMBER_MIN).crossJoin(F.broadcast(last))  # one row
    start = F.date_add("week", 7)
    return m.select(
        "instrument", F.date_add("week", 6).alias("decision_date"), start.alias("effective_date"),
        F.when(F.col("week") < F.col("last_week"), F.date_add("week", 13)).alias("effective_end_date"), F.col("total").alias("score"),
    )


MEMBERS_EV = """weekly AS (
  SELECT user_id AS instrument, date_trunc('week', ts)::DATE AS week, round(sum(value), 6) AS total FROM events GROUP BY ALL
), members AS (
  SELECT instrument, week + 6 AS decision_date, week + 7 AS effective_date,
         CASE WHEN week < (SELECT max(week) FROM weekly) THEN week + 13 END AS effective_end_date, total AS score
  FROM weekly WHERE total >= 40.0
)"""


def _periods(spark: SparkSession, sf_dir: str, instrument: Column, date: Column, day: Column) -> DataFrame:
    """Bars of `lineitem` by instrument and period. Discount and tax stand in for funding, mark and index prices and open interest,
    closed lines for a second venue."""
    at, p = F.struct("l_shipdate", "l_orderkey", "l_linenumber"), F.col("l_extendedprice") / F.col("l_quantity")
    buy = F.col("l_returnflag") == "N"
    li = read(spark, sf_dir, "lineitem").withColumn("p", p).withColumn("buy", buy | (F.pmod("l_orderkey", F.lit(3)) == 0))
    bars = li.groupBy(instrument.alias("instrument"), date.alias("date")).agg(
        F.round(F.min_by("p", at), 6).alias("open"), F.round(F.max("p"), 6).alias("high"), F.round(F.min("p"), 6).alias("low"), F.round(F.max_by("p", at), 6).alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 3).alias("quote_volume"), F.count("*").alias("trade_count"),
        F.sum(F.when(F.col("buy"), F.col("l_quantity")).otherwise(0.0)).alias("taker_volume"), F.round(F.sum(F.when(F.col("buy"), F.col("l_extendedprice")).otherwise(0.0)), 3).alias("taker_quote_volume"),
        F.round(F.avg("l_discount") - 0.05, 9).alias("funding"), F.round(F.sum("l_tax") * 100, 6).alias("open_interest"),
        F.round(F.max_by("p", at) * (1 + F.avg("l_tax") / 10), 6).alias("mark_close"), F.round(F.max_by("p", at) * (1 + F.avg("l_discount") / 10), 6).alias("index_close"),
        F.round(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).otherwise(0.0)), 3).alias("venue_quote_volume"),
    )
    return bars.withColumn("standard", (F.pmod("instrument", F.lit(3)) > 0).cast("double")).withColumn("day", day)


def bars_mo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars: instrument l_suppkey, `day` the month's number."""
    return _periods(spark, sf_dir, F.col("l_suppkey"), F.to_date(F.date_trunc("month", "l_shipdate")), F.year("date") * 12 + F.month("date"))


def bars_wk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars, histories long enough for all windows: instruments are groups of five suppliers, `day` the week's number."""
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    return _periods(spark, sf_dir, F.floor(F.col("l_suppkey") / 5), week, F.floor((F.unix_date("date") - 4) / 7).cast("int"))


def bars_dy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars nearly without gaps: instruments are groups of 25 suppliers, `day` is days since 1970."""
    return _periods(spark, sf_dir, F.floor(F.col("l_suppkey") / 25), F.to_date("l_shipdate"), F.unix_date("date"))


_AT = "(l_shipdate, l_orderkey, l_linenumber)"


def _periods_sql(instrument: str, date: str, day: str) -> str:
    return f"""li AS (
  SELECT *, l_extendedprice / l_quantity AS p, (l_returnflag = 'N' OR l_orderkey % 3 = 0) AS buy, ({instrument})::BIGINT AS inst, {date} AS period FROM lineitem
), bars AS (
  SELECT inst AS instrument, period AS date,
         round(arg_min(p, {_AT}), 6) AS open, round(max(p), 6) AS high, round(min(p), 6) AS low, round(arg_max(p, {_AT}), 6) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 3) AS quote_volume, count(*) AS trade_count,
         sum(CASE WHEN buy THEN l_quantity ELSE 0 END) AS taker_volume,
         round(sum(CASE WHEN buy THEN l_extendedprice ELSE 0 END), 3) AS taker_quote_volume,
         round(avg(l_discount) - 0.05, 9) AS funding, round(sum(l_tax) * 100, 6) AS open_interest,
         round(arg_max(p, {_AT}) * (1 + avg(l_tax) / 10), 6) AS mark_close, round(arg_max(p, {_AT}) * (1 + avg(l_discount) / 10), 6) AS index_close,
         round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END), 3) AS venue_quote_volume, (inst % 3 > 0)::INT::DOUBLE AS standard,
         ({day})::INTEGER AS day
  FROM li GROUP BY inst, period
)"""


BARS_MO = _periods_sql("l_suppkey", "date_trunc('month', l_shipdate)::DATE", "year(period) * 12 + month(period)")
BARS_DY = _periods_sql("l_suppkey // 25", "l_shipdate::DATE", "(period - DATE '1970-01-01')")
BARS_WK = _periods_sql("l_suppkey // 5", "date_trunc('week', l_shipdate)::DATE", "(period - DATE '1970-01-05') // 7")


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel for cross-section work: factors x, y and w, label (next month's return), ret, sector, eligible."""
    from quantloom.operators import rolling as R

    b = bars_mo(spark, sf_dir)
    return b.select(
        "instrument", "date", "day", "open", "close", "volume", "quote_volume", "funding",
        F.round((F.col("high") - F.col("low")) / F.col("close"), 9).alias("x"), F.round(F.col("taker_volume") / F.col("volume"), 9).alias("y"),
        F.round(F.log("quote_volume"), 9).alias("w"),
        F.round(R.roc("close", 1), 9).alias("ret"), F.round(R.future_return("close", 1), 9).alias("label"),
        F.pmod("instrument", F.lit(7)).cast("int").alias("sector"), (F.col("trade_count") >= 4).alias("eligible"),
    )


_LAG1 = "max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {0} AND {0})"
FACTOR_PANEL = f"""{BARS_MO}, panel AS (
  SELECT instrument, date, day, open, close, volume, quote_volume, funding, round((high - low) / close, 9) AS x, round(taker_volume / volume, 9) AS y,
         round(ln(quote_volume), 9) AS w, round(close / {_LAG1.format('1 PRECEDING')} - 1, 9) AS ret,
         round({_LAG1.format('1 FOLLOWING')} / close - 1, 9) AS label, (instrument % 7)::INTEGER AS sector, trade_count >= 4 AS eligible
  FROM bars
)"""
