"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are range-partitioned into equal buckets within each source; sizes are summed
per bucket, the sums become prefix sums over buckets, and a running sum inside the bucket completes them, so a source of
any size is spread over all buckets. Each source is cut at its exact budget: whole epochs, then the documents that come
first in key order, the last of them in part.

Defined results: null or blank text has size 0 and is taken 0 words; a null source is a source of its own and comes last;
ties of the key go by doc_id, then size; repeated rows count separately; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import WORD, checkpoint, keyed, numbered, read

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Documents in a bucket of keys, about.
BUCKET_ROWS = 5_000
_KEY_SPACE = 1 << 52


def sized(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """What the mix needs of every document; the key hashes id and text, and which of equal rows it is, so that neither a hot id
    nor a hot row fills a bucket."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = docs.select(*carry, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("digest"))
    key = F.conv(F.substring(F.md5(F.concat("digest", F.col("__nth").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return numbered(checkpoint(rows), ["doc_id", "source", "digest"]).withColumn("key", key).drop("digest", "__nth")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target: words per source. Sources in code point order take the weights in turn and split `share`
    of all words by weight, none above `epochs` times its size. With caps sorted by cap per weight, the first k sources are
    at their caps, and the rest split what is left; the least k that leaves none above its cap is a prefix-sum search.
    One row per source is all that is gathered."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("w", F.element_at(table, F.pmod(turn, F.lit(len(weights))).cast("int") + 1)).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_from", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_from"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"])
    )
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, bucket_rows: int = BUCKET_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, after the columns to carry along."""
    base = checkpoint(sized(docs, carry))
    n = max(1, -(-base.count() // bucket_rows))
    base = base.withColumn("bucket", F.floor(F.col("key") / F.lit(-(-_KEY_SPACE // n))).cast("int")).withColumn("src", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    sums = base.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("first"))
    t = targets(base, weights, share, epochs).select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("src"), "source_size", "target")
    starts = starts.join(t, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor(F.col("target")) - whole * F.col("source_size")
    return (
        base.withColumn("upto", F.sum("size").over(inside))
        .join(starts, ["src", "bucket"])
        .withColumn("taken", whole * F.col("size") + F.least(F.greatest(left - (F.col("first") + F.col("upto") - F.col("size")), F.lit(0)), F.col("size")))
        .select(*carry, "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))
    )


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents with all their columns: one row per epoch a document is taken in, the last one cut to the words
    still due (joined by single spaces where it is cut). Every row has its own decision, whatever its id."""
    keys = keyed(docs)
    taken = mix(keys, carry=["__row"], **how).filter(F.col("taken") > 0).select("__row", F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    rows = keys.join(taken.hint("shuffle_hash"), "__row")
    epoch = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__mix_taken") / F.col("__mix_size")))).alias("__mix_epoch")
    rows = rows.select("*", epoch)
    due = F.least(F.col("__mix_taken") - (F.col("__mix_epoch") - 1) * F.col("__mix_size"), F.col("__mix_size")).cast("int")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(due < F.col("__mix_size"), F.array_join(F.slice(words, 1, due), " ")).otherwise(F.col("text"))
    names = [F.col(c) for c in docs.columns]
    rows = rows.withColumn("text", cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*names)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS nth FROM d
), d2 AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(digest || nth::VARCHAR), 1, 13))::BIGINT AS k FROM n
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d2 GROUP BY source
), r AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT min_by(lev, cap / w) FROM l WHERE lev <= cap / w) * w), cap) AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d2 d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + least(greatest(floor(target) - whole * source_size - (upto - size), 0), size))::BIGINT AS taken FROM c
"""
