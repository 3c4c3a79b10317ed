"""Packing along a space-filling curve.

A document's token counts, hashed to DIMS features and scaled to length one, are projected to four dimensions by a fixed
random matrix; the Hilbert index of the projected point orders all documents so that neighbours on the curve resemble each
other. Documents are range-sorted by that key (small rows without ids), running totals give each its place in the stream,
and the stream is cut at every multiple of the sequence length: sequences are full, but for the last.

Defined results: a null or empty text is the end id alone; equal keys go by a hash of the row's number, so a large group of
copies is spread over range partitions; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import checkpoint, read, shared_dir
from quantloom.llm.tokens import encoded, write_ids

LENGTH, FEATURES, DIMS, BITS = 2048, 256, 4, 10


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) of `bits` bits a dimension: walk the bits from the top; each level's corner,
    in Gray code order, reflects and rotates the levels below."""
    n, dims = points.shape
    x, key = points.astype(np.int64), np.zeros(n, dtype=np.int64)
    mask, size = np.int64((1 << dims) - 1), dims
    entry, turn = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def rotate(v, by):  # to the right, within `dims` bits
        return ((v >> by) | (v << (size - by))) & mask

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, dtype=np.int64)
        for d in range(dims):
            corner |= ((x[:, d] >> level) & 1) << d
        gray = rotate(corner ^ entry, (turn + 1) % size)
        rank = gray.copy()  # from Gray code
        for s in (1, 2, 4, 8):
            rank ^= rank >> s
        key = (key << dims) | rank
        even = np.maximum((rank - 1) & ~np.int64(1), 0)
        start = np.where(rank == 0, 0, even ^ (even >> 1))
        entry ^= rotate(start, (size - (turn + 1) % size) % size)
        probe = np.where(rank == 0, 0, np.where(rank & 1 == 1, rank, rank - 1))
        trailing = np.zeros(n, dtype=np.int64)  # ones at the low end
        run = probe.copy()
        for _ in range(dims):
            trailing += run & 1
            run = np.where(run & 1 == 1, run >> 1, 0)
        turn = (turn + np.where(probe == 0, 0, trailing) % size + 1) % size
    return key


def curve_keys(id_arrays: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    vectors = np.stack([np.bincount((a.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(FEATURES), minlength=FEATURES) for a in id_arrays]).astype(np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    base = np.linalg.qr(np.random.default_rng(11).standard_normal((FEATURES, DIMS)))[0]
    place = np.clip((vectors @ base + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(place.astype(np.int64))


def places(rows: DataFrame) -> DataFrame:
    """row, at: where each row starts in the stream of all tokens in curve order."""
    small = rows.select("row", "n_tokens", "curve", F.xxhash64("row").alias("tie")).repartitionByRange("curve", "tie")
    small = checkpoint(small.withColumn("part", F.spark_partition_id()))
    totals = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("curve", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    return small.withColumn("upto", F.sum("n_tokens").over(inside)).join(first, "part").select("row", (F.col("first") + F.col("upto") - F.col("n_tokens")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, blanks: bool = False, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the piece's ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    rows = write_ids(encoded(docs, tokenizer, end_id, blanks, curve_keys).withColumnRenamed("key", "curve"), path)
    placed = rows.select("row", "doc_id", "width", "ids").join(places(rows).hint("shuffle_hash"), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in ("from", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")} | ({"ids": []} if with_ids else {})
            for i, (width, raw, at) in enumerate(zip(*(b.column(c).to_pylist() for c in ("width", "ids", "at")))):
                ids, s = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                while s < len(ids):
                    n = min(len(ids) - s, length - (at + s) % length)
                    piece = ids[s : s + n]
                    row = [i, s, n, zlib.crc32(piece), len(ids), (at + s) // length, (at + s) % length] + ([piece.tobytes()] if with_ids else [])
                    for c, v in zip(out, row):
                        out[c].append(v)
                    s += n
            took = pa.array(out.pop("from"), pa.int64())
            cols = [b.column("doc_id").take(took)] + [pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return placed.select("doc_id", "width", "ids", "at").mapInArrow(cut, shape)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
