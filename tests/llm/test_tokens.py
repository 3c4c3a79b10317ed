"""Tokenizer cache, token files and packing: exact round trips."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quantloom.llm import packing, token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "a", " a", "a ", "a  b", "it's  x\n\ny\n z", "tab\tx", "nb\xa0sp", "Ça <|endoftext|> x", "ÉÀ ΑΣ Σ'", "\x1cx", "don't 's 'S", "éa ́b", "a\n", "1234 ½", "日本語 テスト", "İ I", "word, word. word!! x,", "zero\0byte",
    "long words " * 30_000,
    "İ. xİ, İ?! ǅ. ŉ, word",
]


@pytest.mark.parametrize("path,blanks", [(BYTE, True), (WORD, False)])
def test_cached_ids_equal_whole_text_ids(path, blanks):
    e, t = tokens.Encoder(path, blanks), Tokenizer.from_file(path)
    for _ in range(2):
        for text in TEXTS:
            got = np.frombuffer(e.encode([text or ""])[0], e.kind).tolist()
            assert got == t.encode(text or "", add_special_tokens=False).ids, repr(text)[:60]


_alphabet = st.sampled_from(list("ab ,.'\n\tÉß1é́ 日") + ["’s", "'s", "  ", "<|endoftext|>", "\xa0"])


@settings(max_examples=150, deadline=None)
@given(st.lists(_alphabet, max_size=25).map("".join))
def test_any_text(text):
    for path, blanks in ((BYTE, True), (WORD, False)):
        e = tokens.encoder(path, blanks)
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 8)
    e, t = tokens.Encoder(WORD, False), Tokenizer.from_file(WORD)
    for k in range(40):
        text = " ".join(f"w{chr(97 + (k * 7 + j) % 26)}x," for j in range(12))
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, dtype=np.uint64) % np.uint64(1 << 30))
    ef = token_files.EliasFano(token_files.EliasFano.encode(values))
    assert ef.values().tolist() == values.tolist()
    for i in range(0, len(values), 13):
        assert ef.select(i) == values[i]


def test_boundaries_take_little_space():
    ends = np.cumsum(np.full(100_000, 700))
    assert len(token_files.EliasFano.encode(ends)) < 100_000 * 1.7


def expected(rows, tokenizer, end):
    t = Tokenizer.from_file(tokenizer)
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in rows}


@pytest.mark.parametrize("segment_ids", [50, 1 << 20])
def test_token_files(spark, tmp_path, segment_ids):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)]
    want, start = expected(rows, BYTE, 0), 0
    path = str(tmp_path / "files")
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, part int")
    token_files.write_tokens(df, path, BYTE, segment_ids=segment_ids)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), zlib.crc32(np.array(want[i], "<u4")))
        start += len(want[i])


def test_token_file_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (3, "x"), (3, "x"), (None, "a")], "doc_id long, text string")
    token_files.write_tokens(df, str(tmp_path / "a"), BYTE)
    assert sorted((r.start, r.doc_id) for r in token_files.read_tokens(spark, str(tmp_path / "a")).collect()) == [(0, None), (2, None), (4, 3), (6, 3)]
    token_files.write_tokens(df.limit(0), str(tmp_path / "b"), BYTE)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_documents_of_a_token_file(spark, tmp_path):
    rows, path = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "null id")], str(tmp_path / "files")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTE, segment_ids=40)
    want = expected(rows, BYTE, 0)
    some = [-5, 4, 22, 1000]
    assert {r.doc_id: r.ids for r in token_files.documents_of(spark, path, some).collect()} == {i: want[i] for i in some if i in want}
    assert token_files.documents_of(spark, path, []).count() == 0


def test_copies_of_one_row_spread_over_parts(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_tokens(spark.range(4000).selectExpr("7L AS doc_id", "'same text' AS text"), path, BYTE, segment_ids=100)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n"] for r in spark.read.parquet(path).groupBy("part").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()]
    assert sum(parts) == 4000 and len(parts) > 1 and max(parts) < 2500
    starts = [r.start for r in token_files.read_tokens(spark, path).orderBy("start").collect()]
    assert starts == list(range(0, 4000 * 3, 3))


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def check_pieces(pieces, want, length):
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(docs) == set(want)
    for i, ps in docs.items():
        ids, at = want[i], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4"))
            at += p.length
        assert at == len(ids)
    filled = []
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        filled.append(at)
    assert sorted(sequences) == list(range(len(sequences))) and sum(x < length for x in filled) <= 1


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    pieces = packing.pack(df, WORD, length=64).collect()
    want = expected(rows, WORD, 1)
    check_pieces(pieces, want, 64)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_neighbours_are_packed_together(spark):
    texts = {i: ("alpha beta gamma " if i % 2 else "uno dos tres cuatro ") * 40 for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    order = [p.doc_id % 2 for p in sorted(packing.pack(df, WORD, length=256).filter("start = 0").collect(), key=lambda p: (p.sequence_id, p.offset))]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_repeated_documents_are_packed_each(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z")], "doc_id long, text string")
    assert sum(p.length for p in packing.pack(df, WORD, length=4).collect()) == 3 + 3 + 2
