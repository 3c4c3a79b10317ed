"""Scans that read what some factors need over a range of dates, and no more.

The asked range grows by the longest history of the factors, the columns shrink to the fields they read, and both go down to a
table that is partitioned by month: Spark then lists the range's months only, skips row groups by date and reads those columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from quantloom.plans import registry

MONTH = "month"


@dataclass(frozen=True)
class ScanPlan:
    """start and end as asked, the first day to read, and the columns."""

    start: date
    end: date
    first: date
    fields: tuple[str, ...]


def plan(names: Iterable[str], start: date, end: date) -> ScanPlan:
    if start > end:
        raise ValueError("a range starts before it ends")
    fields, history = registry.needs(names)
    return ScanPlan(start, end, start - timedelta(days=history), tuple(sorted(fields)))


def month_of(day: date) -> str:
    return day.strftime("%Y-%m")


def write(bars: DataFrame, path: str) -> None:
    """Bars by month, sorted by date inside the files, so that row groups can be skipped."""
    rows = bars.withColumn(MONTH, F.date_format("date", "yyyy-MM"))
    rows.repartition(MONTH, F.pmod(F.xxhash64("instrument"), F.lit(8))).sortWithinPartitions("date", "instrument").write.partitionBy(MONTH).parquet(path)


def read(spark: SparkSession, path: str, p: ScanPlan, optional: Iterable[str] = ()) -> DataFrame:
    """instrument, date, day and the plan's fields over the widened range; a field named in `optional` that the table doesn't have
    is null, any other missing field an error."""
    table = spark.read.option("mergeSchema", "true").parquet(path)
    missing = [f for f in p.fields if f not in table.columns]
    if wrong := set(missing) - set(optional):
        raise ValueError(f"the table lacks {sorted(wrong)}")
    kept = table.filter(F.col(MONTH).between(month_of(p.first), month_of(p.end)) & F.col("date").between(F.lit(p.first), F.lit(p.end)))
    columns = [F.lit(None).cast("double").alias(f) if f in missing else F.col(f) for f in p.fields]
    return kept.select("instrument", "date", F.unix_date("date").alias("day"), *columns)


def evaluate(spark: SparkSession, path: str, names: Iterable[str], start: date, end: date, optional: Iterable[str] = ()) -> DataFrame:
    """instrument, date and a column per factor (the catalogue's or a user's) from start to end, as over the whole history."""
    names = list(names)
    p = plan(names, start, end)
    values = registry.evaluate(read(spark, path, p, optional), names)
    return values.filter(F.col("date") >= F.lit(start))


def inputs(spark: SparkSession, path: str, p: ScanPlan) -> DataFrame:
    """The files that a plan's scan would read (path, size, time of change); no data column is read for it."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "file string, size long, changed timestamp")
    rows = table.filter(F.col(MONTH).between(month_of(p.first), month_of(p.end)))
    m = F.col("_metadata")
    return rows.select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_modification_time"].alias("changed")).distinct()
