"""Structured Streaming forms of the incremental jobs. Each takes a streaming DataFrame and returns one; `run` drives a
file-backed stream to its end and reads its sink back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quantloom.sources.tables import same_second, scratch

DELAY = "1 day"


def source(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream, event time as a timestamp. The path is given as a pattern, since a plain path to a stream
    must be a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """One row per key within the watermark, times rounded to the nearest second first."""
    return stream.withColumn("ts", same_second(F.col("ts"))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Daily sum, mean and count per instrument, once the day is past the watermark."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("instrument"))
    return g.agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.to_date("w.start").alias("date"), "instrument", "total", "mean", "n")


def sliding(stream: DataFrame, days: int = 5, delay: str = DELAY) -> DataFrame:
    """Counts and maxima over the last days, every day."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), F.col("event_type").alias("kind"))
    return g.agg(F.count("*").alias("n"), F.max("value").alias("high")).select(F.to_date("w.start").alias("from_date"), "kind", "n", "high")


def bars(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Daily bars from ticks."""
    at = F.struct("ts", "event_id")
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("instrument"))
    b = g.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("volume"))
    return b.select(F.to_date("w.start").alias("date"), "instrument", "open", "high", "low", "close", "volume")


def snapshot(spark: SparkSession, path: str, before: int | None, shape: str) -> DataFrame:
    """The states that the batch before left, one row per key; none before the first batch."""
    if before is None or before < 0:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{path}/batch={before}")


MEANS = "instrument long, level double, n long"


def running_mean(df: DataFrame, weight: float, batch: int, path: str) -> None:
    """Writes the states (instrument, level, n) of a recursive mean per instrument after a batch: those of the batch before, carried
    over the batch's rows in event time. A row's weight follows from the number of rows after it, so the batch is one window
    and one sum. A batch reads one earlier snapshot and writes its own; written again after a failure, it is the same."""
    spark = df.sparkSession
    w = Window.partitionBy("instrument").orderBy("ts", "event_id")
    rows = df.select(F.col("user_id").alias("instrument"), "ts", "event_id", "value").withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("instrument")))
    left = F.pow(F.lit(1 - weight), F.col("_n") - F.col("_i"))
    new = rows.groupBy("instrument").agg(F.sum(weight * left * F.col("value")).alias("_sum"), F.max(F.when(F.col("_i") == 1, (1 - weight) * left * F.col("value"))).alias("_first"), F.count("*").alias("_k"))
    met = snapshot(spark, path, batch - 1, MEANS).join(new, "instrument", "full")
    level = F.col("_sum") + F.coalesce(F.col("level") * F.pow(F.lit(1 - weight), "_k"), F.col("_first"))
    overwrite_batch(met.select("instrument", F.coalesce(level, "level").alias("level"), (F.coalesce("n", F.lit(0)) + F.coalesce("_k", F.lit(0))).alias("n")), batch, path)


PROGRESS = "instrument long, last_event long, n long"


def progress(df: DataFrame, batch: int, path: str) -> None:
    """Writes per instrument the last event and the number of events so far, merged with the batch before."""
    new = df.groupBy(F.col("user_id").alias("instrument")).agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))
    both = snapshot(df.sparkSession, path, batch - 1, PROGRESS).unionByName(new)
    overwrite_batch(both.groupBy("instrument").agg(F.max("last_event").alias("last_event"), F.sum("n").alias("n")), batch, path)


def newest(spark: SparkSession, path: str, shape: str = MEANS) -> DataFrame:
    """Each instrument's newest state: the last batch's snapshot. Only the names of the batches are listed."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    return snapshot(spark, path, last, shape)


def drain(stream: DataFrame, out: str, state: str) -> list[dict]:
    """Process what is there into Parquet, from where the checkpoint left off; the progress of each micro-batch."""
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return [dict(p) for p in q.recentProgress]


def run(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is there, write append-mode Parquet with a checkpoint, and read it back."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None]) -> str:
    """foreachBatch with a writer that must be idempotent in the batch id; returns the sink's path."""
    at = scratch(stream.sparkSession, name)
    q = stream.writeStream.foreachBatch(lambda df, i: write(df, i, f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{at}/out"


def overwrite_batch(df: DataFrame, batch: int, path: str) -> None:
    """A batch owns its partition: written again after a failure, it replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
