"""Landed JSON payloads to typed rows. Payloads are text columns; numbers inside them are strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def klines(payloads: DataFrame, raw: str = "payload", symbol: str = "symbol") -> DataFrame:
    """Pages of positional bar arrays: one typed row per bar, completed bars only, one per (date, symbol)."""
    page = F.from_json(raw, "array<array<string>>")
    rows = payloads.select(F.col(symbol).alias("symbol"), F.explode(page).alias("k"))

    def at(i: int, kind: str) -> Column:
        return F.get("k", F.lit(i)).try_cast(kind)

    return rows.select(
        F.to_date(F.timestamp_millis(at(0, "long"))).alias("date"), "symbol", F.timestamp_millis(at(6, "long")).alias("close_time"), at(1, "double").alias("open"), at(2, "double").alias("high"), at(3, "double").alias("low"),
        at(4, "double").alias("close"), at(5, "double").alias("volume"), at(7, "double").alias("quote_volume"), at(8, "long").alias("trade_count"), at(9, "double").alias("taker_buy_base_volume"), at(10, "double").alias("taker_buy_quote_volume"),
    ).dropDuplicates(["date", "symbol"])


def completed(bars: DataFrame, as_of: Column, start: Column | None = None) -> DataFrame:
    """Bars whose close lies before `as_of`, from `start` on."""
    done = bars.filter(F.col("close_time") < as_of)
    return done if start is None else done.filter(F.col("date") >= start)


def funding(payloads: DataFrame, raw: str = "payload") -> DataFrame:
    """Pages of funding objects: empty mark prices are null, a missing rate type is Regular, one row per key."""
    page = F.from_json(raw, "array<struct<symbol:string,fundingRate:string,fundingTime:bigint,markPrice:string,rateType:string>>")
    e = payloads.select(F.explode(page).alias("e"))
    return e.select(
        F.timestamp_millis("e.fundingTime").alias("funding_time"), "e.symbol", F.col("e.fundingRate").try_cast("double").alias("funding_rate"), F.nullif("e.markPrice", F.lit("")).try_cast("double").alias("mark_price"), F.coalesce("e.rateType", F.lit("Regular")).alias("rate_type")
    ).dropDuplicates(["funding_time", "symbol", "rate_type"])


def exchange_info(payloads: DataFrame, raw: str = "payload") -> DataFrame:
    """Perpetual contracts quoted in USDT."""
    s = payloads.select(F.explode(F.from_json(raw, "struct<symbols:array<struct<symbol:string,baseAsset:string,quoteAsset:string,contractType:string,onboardDate:bigint,status:string>>>")["symbols"]).alias("s")).select("s.*")
    return s.filter("quoteAsset = 'USDT' and contractType = 'PERPETUAL'").select("symbol", F.col("baseAsset").alias("base_asset"), F.to_date(F.timestamp_millis("onboardDate")).alias("onboard_date"), "status")


def index_history(payloads: DataFrame, raw: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Index values and constituents of history payloads; an error status stops the job. A constituent takes its point's time
    where it has none of its own."""
    kind = "struct<status:struct<error_code:int>,data:array<struct<update_time:bigint,value:double,constituents:array<struct<id:bigint,symbol:string,weight:double,update_time:bigint>>>>>"
    p = payloads.select(F.from_json(raw, kind).alias("p"))
    p = p.withColumn("_ok", F.when(F.col("p.status.error_code") != 0, F.raise_error(F.lit("payload with an error status")).cast("boolean")).otherwise(True)).filter("_ok")
    points = p.select(F.explode("p.data").alias("d"))
    values = points.select(F.to_date(F.timestamp_millis("d.update_time")).alias("date"), F.col("d.value").alias("index_value")).distinct()
    c = points.select("d.update_time", F.explode("d.constituents").alias("c"))
    rows = c.select(F.to_date(F.timestamp_millis(F.coalesce("c.update_time", "update_time"))).alias("date"), F.col("c.id").alias("id"), F.col("c.symbol").alias("symbol"), F.col("c.weight").alias("weight"))
    return values, rows.distinct()
