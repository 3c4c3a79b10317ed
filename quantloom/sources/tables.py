"""Keyed tables in Parquet: schemas, strict typing, key checks, reads with pushed predicates, sinks."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...]


_TYPES = {"date": T.DateType(), "timestamp": T.TimestampType(), "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


KLINES = TableSpec("klines_daily", _schema("date date, symbol string, close_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, trade_count bigint, taker_buy_base_volume double, taker_buy_quote_volume double"), ("date", "symbol"))
FUNDING = TableSpec("funding_events", _schema("funding_time timestamp, symbol string, funding_rate double, mark_price double, rate_type string"), ("funding_time", "symbol", "rate_type"))
UNIVERSE = TableSpec("universe_monthly", _schema("decision_date date, effective_date date, effective_end_date date, id bigint, symbol string, market_cap_rank int, weight double"), ("effective_date", "symbol"))
METADATA = TableSpec("metadata", _schema("key string, value string, updated_at timestamp"), ("key",))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names; a folder of our own only in a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that it is computed once for all that read it."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def normalize(spec: TableSpec, df: DataFrame) -> DataFrame:
    """Project, type strictly, drop exact repeats; rows that share a key but differ, or have a null key, stop the job when
    they are reached. Extra columns go."""
    missing = [f.name for f in spec.schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{spec.name} lacks {missing}")
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema]).distinct()
    n = F.count("*").over(Window.partitionBy(*spec.key))
    null = F.lit(False)
    for k in spec.key:
        null = null | F.col(k).isNull()
    wrong = F.when(null, F.raise_error(F.lit(f"{spec.name}: null key")).cast("boolean")).when(n > 1, F.raise_error(F.lit(f"{spec.name}: rows differ under one key")).cast("boolean"))
    return typed.withColumn("_ok", F.coalesce(wrong, F.lit(True))).filter("_ok").drop("_ok")


def read_table(spark: SparkSession, spec: TableSpec, path: str, where: str | None = None) -> DataFrame:
    """The table with its predicate pushed to the scan; a table never written is empty."""
    try:
        df = spark.read.schema(spec.schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], spec.schema)
    return df.where(where) if where else df


def replace_dates(old: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """old without the dates that new brings, and new."""
    return old.join(new.select(date).distinct(), date, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], business: Sequence[str]) -> DataFrame:
    """old with new's rows where a key is new or a business column differs; other columns alone change nothing."""
    cols = old.columns
    a, b = old.select(*key, F.struct(*cols).alias("_old")), new.select(*key, F.struct(*cols).alias("_new"))
    same = F.lit(True)
    for c in business:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    row = F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & same), F.col("_old")).otherwise(F.col("_new"))
    return a.join(b, list(key), "full_outer").select(row.alias("_row")).select("_row.*")


def latest_metadata(rows: DataFrame) -> DataFrame:
    """The newest value of every key."""
    return rows.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))


def membership_windows(rows: DataFrame, blacklist: Sequence[str] = ()) -> DataFrame:
    """(date, instrument) of window rows: start, end, comma-separated list."""
    days = rows.select(F.explode(F.sequence("window_start", "window_end")).alias("date"), "names")
    names = days.select("date", F.explode(F.split("names", ",")).alias("instrument")).select("date", F.trim("instrument").alias("instrument"))
    return names.filter((F.col("instrument") != "") & ~F.col("instrument").isin(list(blacklist))).distinct()


def mixed_dates(text: str, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")):
    """A date column from text in any of several formats; null where none fits."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(F.col(text), F.lit(f)) for f in formats]))


def index_components(rows: DataFrame, n: int) -> DataFrame:
    """Rebalance rows' first n components: date, instrument, place."""
    exploded = rows.filter("is_rebalance_day").select("date", F.posexplode(F.split("components", ",")).alias("place", "instrument"))
    return exploded.filter(F.col("place") < n).select("date", F.trim("instrument").alias("instrument"), "place")


def read_csvs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(glob, header=True)


def check_factor(df: DataFrame) -> DataFrame:
    """A long factor table: finite values, unique key. What breaks it stops the job when it is reached."""
    n = F.count("*").over(Window.partitionBy("date", "instrument"))
    clean = df.select("date", "instrument", F.when(F.isnan("factor") | (F.abs("factor") == float("inf")), None).otherwise(F.col("factor")).alias("factor")).filter("factor is not null")
    return clean.withColumn("_ok", F.when(n > 1, F.raise_error(F.lit("two values under one key")).cast("boolean")).otherwise(True)).filter("_ok").drop("_ok")


def content(df: DataFrame) -> str:
    """An order-free fingerprint of a table, one row at the driver."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{r[0]}-{r[1] or 0}"


def save_factor(df: DataFrame, path: str, factor_id: str, settings: dict) -> str:
    """Write a factor's values under its content; saving other values under the same settings is an error."""
    spark, run = df.sparkSession, content(df)
    meta = read_table(spark, METADATA, f"{path}/_meta")
    key = f"{factor_id}:{json.dumps(settings, sort_keys=True)}"
    old = meta.filter(F.col("key") == key).select("value").first()
    if old and old[0] != run:
        raise ValueError(f"{factor_id}: other values are stored under these settings")
    if not old:
        df.write.parquet(f"{path}/{factor_id}/run_id={run}")
        spark.createDataFrame([(key, run)], "key string, value string").withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/_meta")
    return run


def load_factor(spark: SparkSession, path: str, factor_id: str, settings: dict) -> DataFrame | None:
    """Stored values of these settings, or None."""
    key = f"{factor_id}:{json.dumps(settings, sort_keys=True)}"
    found = read_table(spark, METADATA, f"{path}/_meta").filter(F.col("key") == key).select("value").first()
    return spark.read.parquet(f"{path}/{factor_id}/run_id={found[0]}") if found else None


def incremental(cached: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached rows and the recomputed tail; where both have a row they must agree, else the job stops."""
    j = cached.withColumnRenamed("value", "_old").join(recomputed.withColumnRenamed("value", "_new"), list(keys), "full_outer")
    bad = F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.abs(F.col("_old") - F.col("_new")) > 1e-9)
    return j.select(*keys, F.when(bad, F.raise_error(F.lit("the recomputed tail differs from the stored values")).cast("double")).otherwise(F.coalesce("_old", "_new")).alias("value"))


def save_tables(tables: dict[str, DataFrame], at: str) -> None:
    """Each table of an evaluation as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/{name}")


def save_dated_csv(factor: DataFrame, at: str) -> None:
    """A factor (date, instrument, factor) as CSV files, a folder a date."""
    factor.repartition("date").write.partitionBy("date").mode("errorifexists").csv(at, header=True)


def same_second(ts):
    """Timestamps within half a second of a full second as that second."""
    return F.date_trunc("second", ts + F.expr("interval 500 milliseconds"))
