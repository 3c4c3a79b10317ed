"""Token ids of whole texts from a public tokenizer file, with a cache of pieces.

Texts are cut where their tokenizer cuts as well, by Arrow; each distinct piece is looked up once a batch, and those not seen
before go through the `tokenizers` library together. Texts in which such cuts aren't plain (runs of white space, other white space than blanks and line ends,
special tokens) go through the library whole, so ids always equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: White space other than blank and line end, and the cutting mark.
_OTHER = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c == "\1" or c.isspace() and c not in " \n") + "]"
#: Pieces kept in a worker's cache, at most.
CACHE = 1_400_000
#: Texts cut into pieces together.
ROWS = 512
#: Punctuation that a word's tokens never run into.
_AFTER = ".,;:!?*#%&$|"
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks: bool) -> Encoder:
    """This process's encoder for a tokenizer file; workers keep it, with its cache, from task to task."""
    return _ENCODERS.setdefault((path, blanks), Encoder(path, blanks)) if (path, blanks) not in _ENCODERS else _ENCODERS[path, blanks]


class Encoder:
    def __init__(self, path: str, blanks: bool):
        """blanks: white space belongs to the tokens (byte level); else the tokenizer drops it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks = Tokenizer.from_file(path), blanks
        #: One word of letters whose lower case is one letter, with the blank before it where blanks belong to tokens.
        self.plain = re.compile((" " if blanks else "") + "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What sends a text through the library whole (RE2).
        self.odd = "|".join([_OTHER, *special] + ([r"[ \n][ \n]", r"\A[ \n]", r"[ \n]\z"] if blanks else []))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text, in order."""
        if not self.blanks:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\1\n\1"), " ", "\1 "), "\1")

    def _ask(self, pieces: list[str]) -> None:
        """Encode pieces through the library, many at a time. Plain words go as one text, in which each is one word to the
        tokenizer; other pieces go as a list."""
        plain = [x for x in pieces if self.plain(x)]
        for some in (plain[k : k + 4096] for k in range(0, len(plain), 4096)):
            self._keep(some, self.tokenizer.encode(("" if self.blanks else " ").join(some), add_special_tokens=False))
        rest = [x for x in pieces if not self.plain(x)]
        for some in (rest[k : k + 4096] for k in range(0, len(rest), 4096)):
            self._keep(some, self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False))

    def _keep(self, pieces: list[str], e) -> None:
        ids, of = np.array(e.ids, dtype=self.kind), np.array(e.word_ids, dtype=np.int64)
        cuts = (np.searchsorted(of, np.arange(len(pieces) + 1)) * self.kind.itemsize).tolist()
        raw = ids.tobytes()
        self.cache.update(zip(pieces, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _learn(self, new: list[str]) -> None:
        """Bring pieces into the cache: from its older half, from a word and the punctuation after it, or from the library."""
        cache, old = self.cache, self.old
        ask, joined = set(), []
        for x in new:
            if (y := old.get(x)) is not None:
                cache[x] = y
            elif x and x[-1] in _AFTER and (w := x.rstrip(_AFTER)) and w[-1].isalpha() and w[-1] < "\u0100":
                joined.append((x, w, x[len(w) :]))
            else:
                ask.add(x)
        for _, w, tail in joined:
            for y in (w, tail):
                if y not in cache:
                    if (z := old.get(y)) is not None:
                        cache[y] = z
                    else:
                        ask.add(y)
        self._ask(list(ask))
        for x, w, tail in joined:
            cache[x] = cache[w] + cache[tail]

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of `kind`."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list = []
        for k in range(0, len(texts), ROWS):
            some = texts.slice(k, ROWS)
            odd = pc.match_substring_regex(some, self.odd)
            cut = iter(self._cut(some.filter(pc.invert(odd))))
            out += [self._whole(t.as_py()) if w else next(cut) for t, w in zip(some, odd.to_pylist())]
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        pieces = self._pieces(texts)
        coded = pieces.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE // 2:  # never while its entries are needed
            self.old, self.cache = self.cache, {}
        known = list(map(self.cache.get, distinct))
        if missing := [k for k, x in enumerate(known) if x is None]:
            self._learn([distinct[k] for k in missing])
            for k in missing:
                known[k] = self.cache[distinct[k]]
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int64)
        ends = starts[np.concatenate([[0], np.cumsum(pc.list_value_length(pieces))])].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()


def encoded(docs: DataFrame, tokenizer: str, end_id: int, blanks: bool, key: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, key, width (bytes of an id), ids (little-endian, the end id last) and row (a number of its own) of every
    document, encoded where its text lies; key makes a 64-bit integer of each document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, blanks)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                some = b.slice(k, ROWS)
                raw = [x + end for x in enc.encode(some.column("text"))]
                arrays = [np.frombuffer(x, enc.kind) for x in raw]
                cols = [some.column("doc_id"), pa.array([len(a) for a in arrays], pa.int64()), pa.array(key(arrays), pa.int64()), pa.array([enc.kind.itemsize] * len(raw), pa.int32()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "key", "width", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, key long, width int, ids binary").withColumn("row", F.monotonically_increasing_id())


def write_ids(rows: DataFrame, path: str) -> DataFrame:
    """The table, written once and read again, so that its row numbers stay and texts are encoded once."""
    rows.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return rows.sparkSession.read.parquet(path)
