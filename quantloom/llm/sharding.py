"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots. Bytes are aggregated per slot, and a versioned map sends each slot to a
shard; rebalancing edits the map and never rehashes a record. Everything per record is a column expression and carries
no text; whatever is gathered in one place is bounded by the number of slots, a parameter.

Defined results: a null text has size 1; an empty table gives no rows; copies of one row go to one slot after the other;
columns that the operator does not need are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.llm.common import checkpoint, numbered, read, shared_dir

N_SLOTS = 4096


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record. The slot hashes id, size and checksum, and copies of one record
    take the slots after it in turn, so neither a hot id nor a hot row fills a slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    slot = F.pmod(F.pmod(F.xxhash64(*key), F.lit(n_slots)) + F.col("__nth"), F.lit(n_slots))
    return numbered(checkpoint(out), key).withColumn("virtual_slot", slot.cast("int")).drop("__nth")


def slot_sizes(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def complete(slot_map: DataFrame, n_slots: int, n_shards: Column, version: Column) -> DataFrame:
    """The map with a row for every slot: those it lacks hold no bytes and go to the shards in turn."""
    rest = slot_map.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot")).join(slot_map, "virtual_slot", "left_anti")
    turn = F.row_number().over(Window.partitionBy().orderBy("virtual_slot")) - 1
    none = F.lit(0).cast("long")
    rest = rest.select("virtual_slot", F.pmod(turn, n_shards).cast("int").alias("shard"), none.alias("bytes"), none.alias("n_rows"), version.cast("int").alias("version"))
    return slot_map.unionByName(rest)


def build_slot_map(sizes: DataFrame, n_shards: int, version: int = 1, n_slots: int = N_SLOTS) -> DataFrame:
    """Slots in order of falling bytes each go to the shard with the fewest bytes so far. One row holds all slots: at most
    as many as there are virtual slots, whatever the number of records. Empty slots have a shard as well, for later records."""
    zero = F.array_repeat(F.lit(0).cast("long"), n_shards)
    none = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,n_rows:bigint>>)")

    def place(acc, x):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == at, v - x["neg"]).otherwise(v))
        row = F.struct(x["virtual_slot"].alias("virtual_slot"), at.alias("shard"), (-x["neg"]).alias("bytes"), x["n_rows"].alias("n_rows"))
        return F.struct(loads.alias("loads"), F.concat(acc["placed"], F.array(row)).alias("placed"))

    ordered = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "n_rows")))
    placed = (
        sizes.agg(ordered.alias("s"))
        .select(F.aggregate("s", F.struct(zero.alias("loads"), none.alias("placed")), place, lambda a: a["placed"]).alias("p"))
        .select(F.inline("p"))
        .withColumn("version", F.lit(version))
    )
    return complete(checkpoint(placed), n_slots, F.lit(n_shards), F.lit(version))


def rebalance(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map for n_shards, one or more above the present number: every old shard gives away slots
    (least first by hash) until it is down to an equal part of all bytes; the new shards share them. No slot moves
    between old shards."""
    old = F.max("shard").over(Window.partitionBy()) + 1
    fair = F.sum("bytes").over(Window.partitionBy()) / F.lit(n_shards)
    kept = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = slot_map.withColumn("old", old).withColumn("moves", F.sum("bytes").over(kept) > fair)
    turn = F.row_number().over(Window.partitionBy("moves").orderBy(F.desc("bytes"), "virtual_slot")) - 1
    new = F.col("old") + F.pmod(turn, F.greatest(F.lit(n_shards) - F.col("old"), F.lit(1)))
    return (
        moved.withColumn("shard", F.when(F.col("moves") & (F.col("old") < n_shards), new).otherwise(F.col("shard")).cast("int"))
        .withColumn("version", F.col("version") + 1)
        .drop("old", "moves")
    )


def save_slot_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_slot_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The given version of the stored map, or the newest."""
    m = spark.read.parquet(path)
    v = version if version is not None else m.agg(F.max("version")).first()[0]
    return m.filter(F.col("version") == v)


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, slot_map: DataFrame | None = None, recs: DataFrame | None = None) -> DataFrame:
    """Every record with its shard under the map (built here from the bytes per slot if none is given), its virtual slot,
    the map's version and its position in the shard, gapless from 0. recs: checkpointed records of docs, if at hand. Positions are a running count within a virtual slot
    plus the rows of the shard's earlier slots, so that no task ever holds a whole shard."""
    recs = checkpoint(records(docs, n_slots)) if recs is None else recs
    if slot_map is not None:  # one stored by an earlier build may lack slots
        top, version = slot_map.agg(F.max("shard"), F.max("version")).first()
        slot_map = complete(slot_map, n_slots, F.lit(top + 1 if top is not None else n_shards), F.lit(version if version is not None else 1))
    m = checkpoint(slot_map if slot_map is not None else build_slot_map(slot_sizes(recs), n_shards, n_slots=n_slots))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = slot_sizes(recs).select("virtual_slot", F.col("n_rows").alias("rows_now")) if slot_map is not None else None
    m = m.join(counts, "virtual_slot", "left").fillna(0, ["rows_now"]) if counts is not None else m.withColumn("rows_now", F.col("n_rows"))
    m = m.select("virtual_slot", "shard", "version", F.coalesce(F.sum("rows_now").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    # the map has at most n_slots rows
    return recs.join(F.broadcast(m), "virtual_slot").withColumn("slot", F.col("first") + F.row_number().over(within) - 1).drop("first")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs, path = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    recs = checkpoint(records(docs))
    save_slot_map(build_slot_map(slot_sizes(recs), 16), path)
    return shard(docs, 16, slot_map=load_slot_map(spark, path), recs=recs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
