"""Exact dedup by skew-safe combining.

Copies are combined where they lie (the map side of the first aggregation), then per digest and salt, then the winners
of the salts per digest. The full normalised text is a grouping key at every stage, so contents and not only digests are
compared; the digest leads the key and serves to hand the group back to each record without its text.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z; the largest doc_id
stays, and a null doc_id only where the group has no other. Rows that repeat id and text of the one that stays are marked
kept as well, since an id names one document. An empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import attach, checkpoint, lower_az, read

SALTS = 16


def _keyed(docs: DataFrame, *cols: str) -> DataFrame:
    return docs.select(*cols, lower_az(F.coalesce(F.col("text"), F.lit(""))).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: text_sha256, keep_id, group_size."""
    salted = (
        _keyed(docs, "doc_id")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("text_sha256", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    contents = salted.groupBy("text_sha256", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # no text from here on; two contents under one SHA-256 would be an error, not a silent merge
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest"))
    return contents.groupBy("text_sha256").agg(
        F.max("keep_id").alias("keep_id"), F.when(F.count("*") == 1, F.max("group_size")).otherwise(clash.cast("long")).alias("group_size")
    )


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The groups come back to the records by digest;
    hot groups by broadcast, of which there is a bounded number."""
    found = attach(_keyed(docs, "doc_id").drop("norm"), checkpoint(groups(docs, salts)), "text_sha256", "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = groups(docs, salts).select("text_sha256", "keep_id")
    text = lower_az(F.coalesce(docs["text"], F.lit("")))
    return docs.join(stay.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(stay["keep_id"]) & (F.sha2(text, 256) == stay["text_sha256"]), "left_semi")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
