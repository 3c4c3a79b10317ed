"""Helpers shared by the corpus operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in a batch of texts that goes to a Python worker; Spark's own default of 10,000 suits narrow rows.
BATCH_ROWS = 500


_SHIPPED: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send the package to the Python workers of every executor, once a session, and keep batches of texts small where the
    session leaves their size at the default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(made)  # from the driver's file server
        _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only in a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for every row (__row), written to the shared folder so that it stays the same."""
    at = f"{shared_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (stable: a checkpoint or a table) with __nth, each one's number from 0 among those equal in `by`. Equals are numbered
    within their partition, after those of earlier partitions, so no task gets all rows of a value."""
    at = rows.withColumn("__same", F.xxhash64(*by)).withColumn("__part", F.spark_partition_id())
    before = Window.partitionBy("__same").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy("__same", "__part").agg(F.count("*").alias("n"))
    first = counts.select("__same", "__part", F.sum("n").over(before).alias("__first")).filter("__first > 0")
    own = F.row_number().over(Window.partitionBy("__same", "__part").orderBy(*by)) - 1
    met = at.withColumn("__own", own).join(first, ["__same", "__part"], "left")
    return met.withColumn("__nth", F.coalesce("__first", F.lit(0)) + F.col("__own")).drop("__same", "__part", "__first", "__own")


def keep_first(rows: DataFrame, root: DataFrame) -> DataFrame:
    """One of all rows (with __row) that share a root (table of __row, root): the one with the smallest doc_id, and only where
    none has an id a row without."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = root.join(rows.select("__row", "doc_id"), "__row").groupBy("root").agg(F.min(order).alias("first"))
    stay = first.select(F.col("first.__row").alias("__row"))
    return rows.join(stay.hint("shuffle_hash"), "__row", "left_semi").drop("__row")


#: A key with more than one in so many of all rows is hot; so there are fewer hot keys than this.
HOT_PARTS = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with groups (one row per key, `size` rows of `rows` each) on key. Hot keys, fewer than HOT_PARTS whatever
    the data, are broadcast, and their rows go past the shuffle's key to anywhere; so no task gets a hot key's rows."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    info = F.struct(*[c for c in groups.columns if c != key])
    hot = groups.filter(F.col(size) * HOT_PARTS > total).select(F.col(key).alias("_hot_key"), info.alias("_hot"))
    cold = groups.filter(F.col(size) * HOT_PARTS <= total).select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_at"), info.alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    met = met.withColumn("_at", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))))
    met = met.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_at") == F.col("_cold_at")), "left")
    found = F.coalesce("_hot", "_cold")
    return met.filter(found.isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in groups.columns if c != key])
