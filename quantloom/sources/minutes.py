"""A table of minutes, partitioned by date and bucket of instruments.

A day's minutes of some instruments are a few files, whatever the table's size: a read of a range of dates lists its dates, one of some
instruments the buckets that these hash to. Files of different times may hold different optional fields; they merge on
reading, and a field that no file holds is null. A day is written again by replacing its partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 16
DATE, BUCKET = "date", "bucket"
KEY = ["instrument", "ts"]


def bucket_of(instrument: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(instrument), F.lit(buckets)).cast("int")


def write(minutes: DataFrame, path: str, buckets: int = BUCKETS, files: int = 1) -> None:
    """Add minutes (instrument, ts and fields). The dates and buckets written replace what was there for them; `files` per date
    and bucket, for days with more than a task should hold."""
    rows = minutes.withColumn(DATE, F.to_date("ts")).withColumn(BUCKET, bucket_of(F.col("instrument"), buckets))
    part = F.pmod(F.xxhash64(*KEY), F.lit(files))
    spread = rows.repartition(DATE, BUCKET, part).sortWithinPartitions(DATE, BUCKET, *KEY)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE, BUCKET).parquet(path)


def _buckets(spark: SparkSession, instruments: Sequence, kind: str, buckets: int) -> list[int]:
    """The buckets of some instruments, by the same hash as the table's."""
    asked = spark.createDataFrame([(i,) for i in instruments], f"instrument {kind}")
    return sorted(r[0] for r in asked.select(bucket_of(F.col("instrument"), buckets)).distinct().collect())  # at most `buckets`


def read(spark: SparkSession, path: str, fields: Sequence[str], start: date, end: date, instruments: Sequence | None = None, optional: Iterable[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """instrument, ts, date and fields from start to end, of all or some instruments. An optional field that no file holds is null; any
    other missing field is an error. The number of buckets is the table's."""
    table = spark.read.option("mergeSchema", "true").parquet(path)
    missing = [f for f in fields if f not in table.columns]
    if wrong := set(missing) - set(optional):
        raise ValueError(f"the table lacks {sorted(wrong)}")
    kept = table.filter(F.col(DATE).between(F.lit(start), F.lit(end)))
    if instruments is not None:
        kind = table.schema["instrument"].dataType.simpleString()
        kept = kept.filter(F.col(BUCKET).isin(_buckets(spark, instruments, kind, buckets)) & F.col("instrument").isin(list(instruments)))
    columns = [F.lit(None).cast("double").alias(f) if f in missing else F.col(f) for f in fields]
    return kept.select(*KEY, DATE, *columns)
