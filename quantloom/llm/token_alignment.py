"""Alignment of the tokens of two tokenizers over the same text, and counts of the ids that they link.

Tokenizer A is a byte-level BPE file for `tokenizers`, which gets a blank before the text; B a `sentencepiece` model, which adds that
blank itself. Both cut the bytes of blank+text. The tokens of many documents are aligned at once: all A and B tokens are lexsorted by
start, the ends accumulated to a running maximum, and a group breaks where a start reaches that maximum; within a group the
overlapping pairs are expanded. Neither step leaves numpy or looks at one token at a time.

An id pair's count is the number of its links in the corpus. Each block of documents keeps its distinct pairs once; these are
summed over the blocks, and the sums come back to the blocks by pair, so a pair that every document links is one row per block. There
are at most as many pairs as A ids times B ids, whatever the corpus.

Defined results: a text that is null or empty, or that A or B doesn't give back byte for byte, has no tokens: zeros and an empty
groups string. Documents are rows; ids may repeat or be null. An empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import importable, read, shared_dir

#: Characters of text aligned together, and links of a block, about (a longer text is a block of its own).
ALIGN_BYTES, BLOCK_LINKS = 1 << 18, 2_000_000
#: Texts of these characters only are cut alike by both libraries that know vocabulary A; all others go through `tokenizers`.
_COMMON = re.compile("[\t\n\r -~ -ȳ‐-‧]*").fullmatch
_LOADED: dict[tuple[str, str], Pair] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the others
    for the remaining bytes in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with each id's bytes."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        with open(a) as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(map(byte_of.__getitem__, x)): k for x, k in spec["model"]["vocab"].items() if x not in special}
        #: The same vocabulary, whose ids are in the order of the merges, in the faster library.
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for x, k in ranks.items():
            self.bytes_a[k] = x
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Every id in decimal, followed by each separator.
        self.decimal = [f"{k}{s}" for k in range(max(len(self.bytes_a), len(self.bytes_b))) for s in SEPARATORS]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A ids and B ids of each text; none where the bytes of either aren't those of blank+text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = " " + text
            a = self.fast.encode_ordinary(whole) if _COMMON(text) else self.a.encode(whole, add_special_tokens=False).ids
            raw = whole.encode()
            same = text and all(b"".join(map(table.__getitem__, ids)) == raw for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))
            out.append((a, b) if same else ([], []))
        return out


#: After a token: more of the same side of its group, the group's other side, the next group, nothing.
SEPARATORS = [",", "|", ";", ""]


def tokenizers_of(a: str, b: str) -> Pair:
    """This process's pair; workers keep it from task to task."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Pair(a, b)
    return _LOADED[a, b]


class Aligned:
    """Some documents' tokens, aligned: doc (index of each link), pair (a << 32 | b of each link), groups of each document, and strings."""

    def __init__(self, p: Pair, coded: list[tuple[list[int], list[int]]]):
        self.n_a, self.n_b = (np.array([len(x[k]) for x in coded], np.int64) for k in (0, 1))
        a, b = (np.array([i for x in coded for i in x[k]], np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(p.len_a[a]), np.cumsum(p.len_b[b])  # in the bytes of all documents, which both cut whole
        start_a, start_b = end_a - p.len_a[a], end_b - p.len_b[b]
        doc_a = np.repeat(np.arange(len(coded)), self.n_a)
        # groups: all tokens by start, broken where a start reaches the running maximum of the ends
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        side = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        first = np.ones(len(order), bool)
        first[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        # overlaps: B tokens that end after an A token's start and start before its end; all in its group
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        n = high - low
        links = np.cumsum(n)
        of_a = np.repeat(np.arange(len(a)), n)
        of_b = np.arange(links[-1] if len(a) else 0) - np.repeat(links - n, n) + np.repeat(low, n)
        self.doc, self.pair = doc_a[of_a], a[of_a] << 32 | b[of_b]
        doc_of_group = np.empty(int(first.sum()), np.int64)
        doc_of_group[group[: len(a)]] = doc_a
        self.n_groups = np.bincount(doc_of_group, minlength=len(coded))
        self.n_links = np.bincount(self.doc, minlength=len(coded))
        self.strings = self._strings(p, np.concatenate([a, b]), group, side, doc_of_group)

    def _strings(self, p: Pair, ids: np.ndarray, group: np.ndarray, side: np.ndarray, doc_of_group: np.ndarray) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each document."""
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        g, s, d = group[order], side[order], doc_of_group[group[order]]
        after = np.full(len(order), 3)
        after[:-1] = np.where(d[1:] != d[:-1], 3, np.where(g[1:] != g[:-1], 2, np.where(s[1:] != s[:-1], 1, 0)))
        words = (ids[order] * len(SEPARATORS) + after).tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(map(p.decimal.__getitem__, words[x:y])) for x, y in zip([0, *ends], ends)]


_DOC = "n_a: long, n_b: long, n_groups: long, n_links: long, n_own: long, groups_sha256: string"

_ARROW_DOC = pa.struct([(f.split(":")[0], pa.string() if f.endswith("string") else pa.int64()) for f in _DOC.split(", ")])


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Block:
    """Documents gathered until they have enough links: what is known of each, the distinct pairs of all with their links, and each
    document's own pairs (places in the block's list, ascending) with their links."""

    def __init__(self):
        self.ids, self.docs, self.pairs, self.links, self.n = [], [], [], [], 0

    def add(self, ids: list, x: Aligned) -> None:
        distinct, at = np.unique(x.pair, return_inverse=True)
        cell, links = np.unique(x.doc * max(len(distinct), 1) + at, return_counts=True)
        doc, own = np.divmod(cell, max(len(distinct), 1))
        self.pairs.append(distinct[own])
        self.links.append(links)
        columns = [x.n_a, x.n_b, x.n_groups, x.n_links, np.bincount(doc, minlength=len(ids))]
        rows = zip(*[c.tolist() for c in columns], map(_digest, x.strings))
        self.docs += [dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_own", "groups_sha256"), r)) for r in rows]
        self.ids += ids
        self.n += len(x.pair)

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        links = np.concatenate(self.links).astype(np.int64)
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        pair_links = np.zeros(len(pairs), np.int64)
        np.add.at(pair_links, at, links)
        columns = {
            "block": pa.array([number], pa.int64()),
            "ids": pa.array([self.ids], pa.list_(kind)),
            "docs": pa.array([self.docs], pa.list_(_ARROW_DOC)),
            "pairs": pa.array([pairs], pa.list_(pa.int64())),
            "pair_links": pa.array([pair_links], pa.list_(pa.int64())),
            "own": pa.array([_packed(at)], pa.binary()),
            "own_links": pa.array([_packed(links)], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def blocks(docs: DataFrame, a: str, b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """The documents encoded, aligned and gathered to blocks, a row each, written to the shared folder."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], pa.DataType]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= ALIGN_BYTES:
                    yield ids, texts, kind
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts, kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, part = tokenizers_of(a, b), TaskContext.get().partitionId() << 32
        block, kind = Block(), None
        for ids, texts, kind in pieces(batches):
            block.add(ids, Aligned(p, p.encode(texts)))
            if block.n >= block_links:
                yield block.batch(part, kind)
                block, part = Block(), part + 1
        if block.ids:
            yield block.batch(part, kind)

    spark = docs.sparkSession
    importable(spark)
    at = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, docs array<struct<{_DOC}>>, pairs array<long>, pair_links array<long>, own binary, own_links binary"
    docs.select("doc_id", "text").mapInArrow(run, schema).write.parquet(at)
    return spark.read.parquet(at)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n (its links in the corpus) and best (no pair of its B id has more)."""
    each = made.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("links"))
    counts = each.groupBy("pair").agg(F.sum("links").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    top = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per B id of the vocabulary
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, a: str, b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id and RESULT of every document, for the tokenizer files a (tokenizers) and b (sentencepiece)."""
    made = blocks(docs, a, b, block_links)
    asked = made.select("block", F.explode("pairs").alias("pair"))
    known = asked.join(pair_counts(made), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("known"))
    met = made.select("block", "ids", "docs", "own", "own_links").join(known.select("block", F.col("known.n").alias("n"), F.col("known.best").alias("best")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, table = row.column("ids").flatten(), row.column("docs").flatten()
                docs = {name: table.field(name) for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                n_own = table.field("n_own").to_numpy()
                n, best = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n", "best"))
                own, links = (_unpacked(row.column(c)[0].as_py(), int(n_own.sum())) for c in ("own", "own_links"))
                ends = np.concatenate([[0], np.cumsum(n_own)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (links * best[own].astype(np.int64), links * n[own].astype(np.int64))] if len(own) else [np.zeros(len(n_own), np.int64)] * 2
                docs |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
                yield pa.RecordBatch.from_arrays([ids, *[docs[c] for c in RESULT]], names=["doc_id", *RESULT])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.select("ids", "docs", "own", "own_links", "n", "best").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
