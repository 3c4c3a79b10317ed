"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within 3 bits differ by at most 1 bit, half the radius, in one of their two 32-bit halves. So every
fingerprint emits, for both halves, the half itself and (where the half has odd parity) all its variants within one bit:
of two halves one bit apart exactly one is odd, and its variants meet the other half itself. Fingerprints shuffle on
(side, variant) and meet there as seekers (variants) and anchors (unchanged halves); colliding pairs are compared in full.

Only distinct fingerprints take part, so exact copies cost one row. Where many near copies meet under one variant, seekers
and anchors are dealt into blocks of bounded size and each pair of blocks is a task of its own; a task returns links that
span its connected parts, never all pairs, so the links stay in proportion to the rows while no connection is lost.

Defined results: null and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle; repeated rows share a component; rows with a null doc_id get the component of their fingerprint (null if nothing
in it has an id); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import LOWER, UPPER, attach, checkpoint, keep_first, keyed, read
from quantloom.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Rows of one variant compared in one piece.
BLOCK = 1024
#: Shingles hashed in one piece.
HASHES = 65_536
_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles, unsigned. The words, one blank apart, are one byte string; shingles are
    slices of it, hashed HASHES at a time, so a very long text needs little more than a few bytes a word."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    line = _GAP.sub(b" ", raw).strip(b" ")
    if not line:
        return 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = len(blanks) + 2 - shingle
    if n <= 1:
        starts, ends, n = np.zeros(1, np.int64), np.array([len(line)]), 1
    else:
        starts, ends = np.concatenate([[0], blanks[: n - 1] + 1]), np.concatenate([blanks[shingle - 1 :], [len(line)]])
    for k in range(0, n, HASHES):
        at = zip(starts[k : k + HASHES].tolist(), ends[k : k + HASHES].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in at], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every document, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ids}, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    half = F.when(F.col("side") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return fps.select("fp", side).withColumn("half", half)


def _spanning(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links (x, y) with the same connected parts as all pairs of a and b within the radius."""
    i, j = np.nonzero(np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius)
    nodes, j = np.concatenate([a, b]), j + len(a)
    root = np.arange(len(nodes))
    while True:  # every node takes the least label around it, then its label's label
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            break
        root = low
    keep = nodes != nodes[root]
    return np.unique(np.stack([nodes[keep], nodes[root[keep]]], axis=1), axis=0)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly those joined by chains of fingerprints at
    `radius` (at most 3) or fewer differing bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves one bit around cover a radius of 3 at most")
    halves = checkpoint(_halves(fps))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])
    odd = F.bit_count("half") % 2 == 1
    near = F.when(odd, flips).otherwise(F.array(F.lit(0).cast("long")))
    seekers = halves.select("fp", "side", "half", F.explode(near).alias("flip")).select("side", F.col("half").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    anchors = halves.groupBy("side", F.col("half").alias("variant")).agg(F.count("*").alias("n_anchors"), F.min("fp").alias("only"))
    # a variant at which nothing but its own anchor arrives can't link
    met = seekers.join(anchors, ["side", "variant"]).filter((F.col("n_anchors") > 1) | (F.col("fp") != F.col("only")))
    small = met.filter(F.col("n_anchors") == 1).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("only"))) <= radius).select(F.col("fp").alias("a"), F.col("only").alias("b"))
    # more anchors: blocks of seekers against blocks of anchors
    many = met.filter(F.col("n_anchors") > 1).select("side", "variant", "fp", "n_anchors")
    sizes = checkpoint(
        many.groupBy("side", "variant").agg(F.count("*").alias("n_seekers"), F.first("n_anchors").alias("n_anchors"))
        .filter("n_seekers > 1")
        .select("side", "variant", F.ceil(F.col("n_seekers") / block).cast("int").alias("p"), F.ceil(F.col("n_anchors") / block).cast("int").alias("q"))
    )
    deal = F.xxhash64("fp")
    rows = many.select("side", "variant", "fp").join(sizes, ["side", "variant"]).withColumn("p_at", F.pmod(deal, F.col("p"))).withColumn("is_anchor", F.lit(False))
    rows = rows.withColumn("q_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q").cast("long") - 1)))
    held = halves.select("side", F.col("half").alias("variant"), "fp").join(sizes, ["side", "variant"]).withColumn("q_at", F.pmod(deal, F.col("q"))).withColumn("is_anchor", F.lit(True))
    held = held.withColumn("p_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p").cast("long") - 1)))
    cols = ["side", "variant", "p_at", "q_at", "is_anchor", "fp"]
    dealt = rows.select(*cols).unionByName(held.select(*cols)).withColumn("task", F.xxhash64("side", "variant", "p_at", "q_at"))
    dealt = dealt.repartition("task").sortWithinPartitions("task", "side", "variant", "p_at", "q_at")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            found = np.concatenate(parts) if parts else np.empty((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        def solve(fp, anchor):
            return _spanning(fp[~anchor], fp[anchor], radius)

        rest = None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("side", "variant", "p_at", "q_at")], axis=1)
            fp, anchor = np.asarray(batch.column("fp")), np.asarray(batch.column("is_anchor").to_numpy(zero_copy_only=False))
            if rest is not None:
                key, fp, anchor = np.concatenate([rest[0], key]), np.concatenate([rest[1], fp]), np.concatenate([rest[2], anchor])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            yield out([solve(fp[s:t], anchor[s:t]) for s, t in zip(edges, edges[1:])])
            s = edges[-1]  # the last block may go on in the next batch
            rest = key[s:], fp[s:], anchor[s:]
        if rest is not None:
            yield out([solve(rest[1], rest[2])])

    return small.unionByName(dealt.select(*cols).mapInArrow(compare, "a long, b long"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, fingerprint, component_id (smallest doc_id that chains of links reach) of every document."""
    d = checkpoint(fingerprints(docs, shingle))
    f = checkpoint(d.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = checkpoint(components(links(f.select("fp"), radius, block)))
    least = comp.join(f, F.col("node") == f["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    ids = f.join(comp.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return attach(d, checkpoint(ids), "fp", "n").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Of documents in one component, the one with the smallest doc_id, with all its columns; a document without an id stays
    only if nothing in its component has one."""
    rows = keyed(docs)
    found = near_dedup(rows.select(F.col("__row").alias("doc_id"), "text"), **how)
    return keep_first(rows, checkpoint(found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("root"))))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
