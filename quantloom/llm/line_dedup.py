"""Removal of lines that many documents share, through a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; it is known by its 128-bit hash. One scan counts
in how many documents each distinct hash of a long key is and which document has the largest doc_id. The distinct hashes that
repeat across documents are dealt to shards; each shard builds a minimal perfect hash (a cascade of bit arrays, about four bits
a hash) that leads to three compact arrays: fingerprints (the other 64 bits of the hash), document counts and holders. A hash
of one document only can never be dropped, so it isn't indexed; probing for one meets a wrong fingerprint.

Documents probe the arrays in a second scan and are never joined with lines. Where all arrays together take at most
`local_bytes`, every task has them and texts stay where they lie. Beyond that the probes go to the shards: distinct hashes
of a document are sent to their shard's arrays, shards with many probes are split over salts (each with a copy of the arrays,
so that a hot line is no task's alone), and only hits come back to the texts.

Defined results: doc_id is an integer. Null and empty texts are one empty line. Rows that repeat a doc_id count as documents of
their own, and all rows with the largest doc_id keep the line. Rows without a doc_id count, and lose the line if any holder has
one; where none has, all keep it. A document with no line left has the empty text. An empty table gives no rows; other columns
stay in `keep_lines` as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm.common import importable, read, shared_dir

MIN_CHARS, MIN_DOCS = 40, 5
#: Hashes of a shard, about; bytes of arrays that every task may have; probes of a routed group, about.
SHARD_KEYS, LOCAL_BYTES, GROUP_PROBES = 1_000_000, 48 << 20, 1_000_000
#: No holder: all documents with the line are without an id.
NOBODY = np.iinfo(np.int64).min

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """Another 64 bits of each hash, for a level."""
    with np.errstate(over="ignore"):
        x = x + _GOLD * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys have the numbers 0 to n - 1. At each level the keys still without a
    place take one bit of an array of twice their number; those alone on their bit have their place there, the others go on.
    A key's number is the rank of its bit over all levels. Other keys have any number, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        bits = np.concatenate(levels) if levels else np.empty(0, np.uint8)
        self.bits = bits
        self.starts = np.cumsum([0, *[len(x) * 8 for x in levels]])
        ones = np.bitwise_count(bits)
        self.ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            size = (2 * len(left) + 7) // 8 * 8
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            x = keys[open_]
            at = self.starts[k] + (_mix(x, k) % np.uint64(len(level) * 8)).astype(np.int64)
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            here = (byte >> bit) & 1 == 1
            below = byte[here] & ((np.uint8(1) << bit[here]) - np.uint8(1))
            out[open_[here]] = self.ranks[at[here] >> 3] + np.bitwise_count(below)
            open_ = open_[~here]
            if not len(open_):
                break
        return out


class Shard:
    """The arrays of one shard, indexed by its perfect hash."""

    def __init__(self, row):
        sizes = np.frombuffer(row["level_bytes"], "<i8")
        self.hash = PerfectHash(np.split(np.frombuffer(row["bits"], np.uint8), np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self.prints, self.docs, self.holder = (np.frombuffer(row[c], t) for c, t in (("prints", "<u8"), ("docs", "<i8"), ("holder", "<i8")))

    @staticmethod
    def make(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, holder: np.ndarray) -> dict[str, bytes]:
        h = PerfectHash.build(hi)
        to = h.find(hi)
        place = lambda x, kind: (a := np.empty(len(x), kind)).__setitem__(to, x) or a.tobytes()
        sizes = np.array([len(x) for x in h.levels], "<i8")
        return {"level_bytes": sizes.tobytes(), "bits": h.bits.tobytes(), "prints": place(lo, "<u8"), "docs": place(docs, "<i8"), "holder": place(holder, "<i8")}

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of each line hash (0 if it isn't here) and its holder."""
        at = self.hash.find(hi)
        known = at >= 0
        known[known] = self.prints[at[known]] == lo[known]
        docs, holder = np.zeros(len(hi), np.int64), np.full(len(hi), NOBODY)
        docs[known], holder[known] = self.docs[at[known]], self.holder[at[known]]
        return docs, holder


def shard_of(lo: np.ndarray, shards: int) -> np.ndarray:
    return ((lo >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def line_hashes(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and each one's hash (16 bytes; empty where the key is short)."""
    lines, hashes = (text or b"").split(b"\n"), []
    for x in lines:
        key = x.strip()
        n = len(key)
        long = n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars)
        hashes.append(xxhash.xxh3_128_digest(key.lower()) if long else b"")
    return lines, hashes


def _words(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc")


def _count(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct line hashes of each batch with their number of documents and largest doc_id."""

    def run(batches):
        for b in batches:
            found: dict[bytes, list[int]] = {}
            for doc, text in zip(b.column("doc").to_pylist(), _texts(b)):
                for h in set(line_hashes(text, min_chars)[1]):
                    if (x := found.get(h)) is None:
                        found[h] = [1, doc]
                    else:
                        x[0] += 1
                        x[1] = max(x[1], doc)
            found.pop(b"", None)
            hi, lo = _words(list(found))
            docs, holder = np.array(list(found.values()), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi.view(np.int64), lo.view(np.int64), docs, holder)], names=["hi", "lo", "docs", "holder"])

    return run


class LineIndex(NamedTuple):
    """A stored index: a table with a row of arrays per shard, the number of shards, and the bytes of all arrays."""

    table: DataFrame
    shards: int
    n_bytes: int


ARRAYS = ["level_bytes", "bits", "prints", "docs", "holder"]


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """Index every distinct line hash found in two documents or more; counts and arrays are written to the shared folder."""
    spark = docs.sparkSession
    importable(spark)
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = docs.select(_doc(), "text").mapInArrow(_count(min_chars), "hi long, lo long, docs long, holder long")
    repeated = rows.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder")).filter("docs > 1")
    repeated.write.parquet(f"{at}/counts")
    counts = spark.read.parquet(f"{at}/counts")
    shards = max(1, -(-counts.count() // shard_keys))

    def build(t: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (t[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        arrays = Shard.make(hi, lo, t["docs"].to_numpy(), t["holder"].to_numpy())
        return pd.DataFrame([{"shard": shard_of(lo[:1], shards)[0], **arrays}])

    shard = F.pmod(F.shiftrightunsigned("lo", 20), F.lit(shards))
    made = counts.groupBy(shard).applyInPandas(build, f"shard long, {', '.join(f'{c} binary' for c in ARRAYS)}")
    made.write.parquet(f"{at}/shards")
    table = spark.read.parquet(f"{at}/shards")
    n_bytes = table.agg(F.coalesce(F.sum(sum(F.length(c) for c in ARRAYS)), F.lit(0))).first()[0]
    return LineIndex(table, shards, n_bytes)


_OWN = ["n_lines", "n_dropped", "kept_text"]


def _kept(lines: list[list[bytes]], drop: list[list[bool]]) -> list[pa.Array]:
    """Columns of the result: lines, dropped lines and the text of the others."""
    kept = [b"\n".join(x for x, d in zip(ls, ds) if not d) for ls, ds in zip(lines, drop)]
    return [pa.array([len(x) for x in lines], pa.int64()), pa.array([sum(x) for x in drop], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


def _probe_here(packed: DataFrame, index: LineIndex, min_chars: int, min_docs: int) -> DataFrame:
    """Texts probe the arrays of all shards, which every task has."""
    rows = index.table.collect()  # at most local_bytes, checked by the caller
    arrays = packed.sparkSession.sparkContext.broadcast({r["shard"]: {c: bytes(r[c]) for c in ARRAYS} for r in rows})
    n_shards = index.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {s: Shard(r) for s, r in arrays.value.items()}
        for b in batches:
            split = [line_hashes(t, min_chars) for t in _texts(b)]
            hi, lo = _words([h for _, hashes in split for h in hashes if h])
            docs, holder = np.zeros(len(hi), np.int64), np.full(len(hi), NOBODY)
            of = shard_of(lo, n_shards)
            for s, shard in shards.items():
                mine = of == s
                docs[mine], holder[mine] = shard.probe(hi[mine], lo[mine])
            own = np.repeat(b.column("doc").to_numpy(), [sum(map(bool, hashes)) for _, hashes in split])
            hit = iter(((docs >= min_docs) & (holder != NOBODY) & (holder != own)).tolist())
            drop = [[bool(h) and next(hit) for h in hashes] for _, hashes in split]
            yield pa.RecordBatch.from_arrays([b.column("row"), *_kept([x for x, _ in split], drop)], names=["row", *_OWN])

    return packed.mapInArrow(run, _schema(packed))


def _probe_routed(packed: DataFrame, index: LineIndex, min_chars: int, min_docs: int, group_probes: int) -> DataFrame:
    """Line hashes go to their shard's arrays, and what they hit comes back to the texts by doc and text hash."""
    spark, n_shards = packed.sparkSession, index.shards
    at = f"{shared_dir(spark)}/probes-{uuid.uuid4().hex}"
    packed = packed.withColumn("of", F.xxhash64("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [{h for h in line_hashes(t, min_chars)[1] if h} for t in _texts(b)]
            hi, lo = _words([h for hashes in own for h in hashes])
            take = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            out = [b.column(c).take(take) for c in ("doc", "of")] + [pa.array(x) for x in (shard_of(lo, n_shards), hi.view(np.int64), lo.view(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["doc", "of", "shard", "hi", "lo"])

    packed.select("doc", "of", "text").mapInArrow(ask, "doc long, of long, shard long, hi long, lo long").write.parquet(at)
    probes = spark.read.parquet(at)
    wanted = probes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(group_probes)).cast("long").alias("salts"))  # a row per shard
    spread = probes.join(F.broadcast(wanted), "shard").select("doc", "of", "shard", "hi", "lo", F.pmod(F.monotonically_increasing_id(), F.col("salts")).alias("salt"))
    to = F.broadcast(wanted.select(F.col("shard").alias("to"), F.col("salts").alias("copies")))
    copies = index.table.join(to, F.col("shard") == F.col("to")).select("to", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), *ARRAYS)

    def probe(asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or arrays.empty:
            return pd.DataFrame({"doc": [], "of": [], "hash": []})
        hi, lo = (asked[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        docs, holder = Shard(arrays.iloc[0]).probe(hi, lo)
        hit = (docs >= min_docs) & (holder != NOBODY) & (holder != asked["doc"].to_numpy())
        found = np.stack([hi[hit], lo[hit]], 1).astype(">u8")
        return pd.DataFrame({"doc": asked["doc"][hit], "of": asked["of"][hit], "hash": [x.tobytes() for x in found]})

    hits = spread.groupBy("shard", "salt").cogroup(copies.groupBy("to", "copy")).applyInPandas(probe, "doc long, of long, hash binary")
    met = packed.join(hits.groupBy("doc", "of").agg(F.collect_set("hash").alias("hits")), ["doc", "of"], "left")  # hits: lines of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [line_hashes(t, min_chars) for t in _texts(b)]
            hit = [set(x or ()) for x in b.column("hits").to_pylist()]
            drop = [[h in mine for h in hashes] for (_, hashes), mine in zip(split, hit)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *_kept([x for x, _ in split], drop)], names=["row", *_OWN])

    return met.select("row", "text", "hits").mapInArrow(run, _schema(packed))


def _schema(packed: DataFrame) -> str:
    return f"row {packed.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string"


def probe_lines(docs: DataFrame, index: LineIndex, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, local_bytes: int = LOCAL_BYTES, group_probes: int = GROUP_PROBES) -> DataFrame:
    """row (a struct of all columns but text), n_lines, n_dropped and kept_text of every document, by an index of these documents.
    min_docs is 2 or more."""
    importable(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), _doc(), "text")
    if index.n_bytes <= local_bytes:
        return _probe_here(packed, index, min_chars, min_docs)
    return _probe_routed(packed, index, min_chars, min_docs, group_probes)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every document."""
    found = probe_lines(docs.select("doc_id", "text"), build_index(docs, min_chars), min_chars, min_docs, local_bytes)
    return found.select("row.doc_id", *_OWN)


def keep_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with all their columns, their texts without the dropped lines."""
    found = probe_lines(docs, build_index(docs, min_chars), min_chars, min_docs)
    return found.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (
  SELECT row, doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5
), judged AS (
  SELECT row, doc_id, k, line, coalesce(holder IS NOT NULL AND doc_id IS DISTINCT FROM holder, false) AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row
"""
