"""Token files: a concatenated id array with Elias-Fano coded document boundaries.

Texts are encoded where they lie; their ids are range-partitioned by doc_id and written as segments, rows of Parquet files
that any shared store can hold: the ids as one little-endian array, and the documents' boundaries and doc_ids as Elias-Fano
codes with a select structure (the place of every 256th one bit), close to the least space possible and without tables of
64-bit offsets. A segment ends at the first document that brings it to SEGMENT_IDS ids, so a task holds one segment, or one
document where that is longer.

Defined results: a null or empty text is the end id alone; rows of equal doc_id go by their ids' checksum, and rows with a null
doc_id come first; an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import read, shared_dir
from quantloom.llm.tokens import encoded, write_ids

SEGMENT_IDS = 1 << 20
#: One bits between two places that the select structure holds.
SAMPLE = 256
_HEAD = struct.Struct("<QQB")


class EliasFano:
    """A code of non-decreasing integers from 0: low bits packed, high bits in unary."""

    def __init__(self, raw: bytes):
        self.n, self.universe, self.low_bits = _HEAD.unpack_from(raw)
        at = _HEAD.size
        low, high = -(-self.n * self.low_bits // 8), -(-(self.n + (self.universe >> self.low_bits) + 1) // 8)
        self.low = np.frombuffer(raw, np.uint8, low, at)
        self.high = np.frombuffer(raw, np.uint8, high, at + low)
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + low + high)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(n + (top >> bits) + 1, dtype=np.uint8)
        high[ones] = 1
        return _HEAD.pack(n, top, bits) + np.packbits(low).tobytes() + np.packbits(high).tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i: int) -> int:
        """The i-th value, from the sampled place before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:  # pass over whole bytes of high bits, then to the bit
            step = np.unpackbits(self.high[at + 1 >> 3 : (at + 1 >> 3) + 64])[(at + 1) & 7 :]
            ones = np.flatnonzero(step)
            if len(ones) >= left:
                at, left = at + 1 + int(ones[left - 1]), 0
            else:
                at, left = at + len(step), left - len(ones)
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        i = np.arange(self.n)
        return (((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)).astype(np.int64)


SEGMENT = "part int, segment int, n_docs long, n_ids long, null_docs long, first_doc long, width int, doc_ids binary, bounds binary, ids binary"


def _crc(arrays: list[np.ndarray]) -> np.ndarray:
    return np.array([zlib.crc32(a) for a in arrays], dtype=np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, blanks: bool = True, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text where it lies and write the files in ascending doc_id order (part, then segment). Only ids are
    range-partitioned, by doc_id, checksum and row, so rows of one doc_id, or copies of one row, spread as well."""
    rows = write_ids(encoded(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, end_id, blanks, _crc), f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_in, ids_in, size, segment, at = [], [], 0, 0, (0, 2)

        def close():
            nonlocal docs_in, ids_in, size, segment
            known = [d for d in docs_in if d is not None]
            first, (part, width) = known[0] if known else 0, at
            ends = np.cumsum([0, *(len(x) // width for x in ids_in)])
            row = {
                "part": part, "segment": segment, "n_docs": len(docs_in), "n_ids": size, "null_docs": len(docs_in) - len(known), "first_doc": first, "width": width,
                "doc_ids": EliasFano.encode(np.array([d - first for d in known], dtype=np.uint64)), "bounds": EliasFano.encode(ends), "ids": b"".join(ids_in),
            }
            docs_in, ids_in, size, segment = [], [], 0, segment + 1
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for b in batches:
            for part, d, width, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "width", "ids"))):
                at = part, width
                docs_in.append(d)
                ids_in.append(raw)
                size += len(raw) // width
                if size >= segment_ids:
                    yield close()
        if docs_in:
            yield close()

    ints, binary = pa.int64(), pa.binary()
    kinds = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", ints), ("n_ids", ints), ("null_docs", ints), ("first_doc", ints), ("width", pa.int32()), ("doc_ids", binary), ("bounds", binary), ("ids", binary)])
    order = ["doc_id", "key", "row"]
    ordered = rows.select(*order, "width", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    segments = ordered.select("doc_id", "width", "ids", F.spark_partition_id().alias("part")).mapInArrow(run, SEGMENT)
    segments.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def documents_of(spark, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id, ids of the given documents (few), found by select: no other boundary of their segments is decoded, and segments
    that start after all of them aren't read."""
    wanted = np.unique(np.asarray(doc_ids, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                known = EliasFano(r["doc_ids"]).values() + r["first_doc"]
                bounds, found = EliasFano(r["bounds"]), np.flatnonzero(np.isin(known, wanted))
                spans = [(bounds.select(i), bounds.select(i + 1)) for i in (found + r["null_docs"]).tolist()]
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                yield pa.RecordBatch.from_arrays([pa.array(known[found]), pa.array([ids[s:t].tolist() for s, t in spans], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = spark.read.parquet(path).filter(F.col("first_doc") <= int(wanted.max(initial=-1)))
    return near.select("null_docs", "first_doc", "width", "doc_ids", "bounds", "ids").mapInArrow(run, "doc_id long, ids array<long>")


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    up_to_now = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(up_to_now), F.lit(0)).alias("part_first"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("segment_first")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bounds = EliasFano(r["bounds"]).values()
                known = [r["first_doc"] + d for d in EliasFano(r["doc_ids"]).values().tolist()]
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(ids[s:t]) for s, t in zip(bounds.tolist(), bounds[1:].tolist())]
                n = r["n_docs"]
                cols = [np.full(n, r["part"], np.int32), np.full(n, r["segment"], np.int32), pa.array([None] * r["null_docs"] + known, pa.int64()), bounds[:-1], np.diff(bounds), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.select("part", "segment", "n_docs", "null_docs", "first_doc", "width", "doc_ids", "bounds", "ids").mapInArrow(run, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(first, ["part", "segment"]).select("doc_id", (F.col("part_first") + F.col("segment_first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
