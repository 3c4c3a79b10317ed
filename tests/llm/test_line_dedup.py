"""Line dedup: the perfect hash, both ways of probing against brute force, edge cases."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quantloom.llm import line_dedup
from quantloom.llm.line_dedup import PerfectHash, Shard

SCHEMA = "doc_id long, text string, row string, shard long, kept_text string, doc string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=3000))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert sorted(PerfectHash.build(keys).find(keys).tolist()) == list(range(len(keys)))


def test_arrays_are_compact_and_know_their_keys():
    rng = np.random.default_rng(3)
    hi, lo, other = (rng.integers(0, 2**64, 200_000, dtype=np.uint64) for _ in range(3))
    docs, holder = np.arange(200_000), np.arange(200_000)[::-1].copy()
    row = Shard.make(hi, lo, docs, holder)
    assert len(row["bits"]) * 8 < 4.5 * len(hi)
    shard = Shard(row)
    got = shard.probe(hi, lo)
    assert (got[0] == docs).all() and (got[1] == holder).all()
    assert not shard.probe(other, lo)[0].any() and not shard.probe(hi, other)[0].any()
    assert not Shard(Shard.make(*(x[:0] for x in (hi, lo, docs, holder)))).probe(hi, lo)[0].any()


def test_two_equal_keys_are_an_error():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def brute(docs, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    holders = defaultdict(list)
    for d, lines in split:
        for k in {key(x) for x in lines}:
            holders[k].append(d)

    def drop(d, line):
        k = key(line)
        ids = [x for x in holders[k] if x is not None]
        return len(k) >= min_chars and len(holders[k]) >= min_docs and bool(ids) and d != max(ids)

    out = []
    for d, lines in split:
        kept = [x for x in lines if not drop(d, x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINE = "This line is in many of the documents, word for word."
ACCENTS = "é" * 40  # 40 code points, 80 bytes
DOCS = (
    [(k, f"own line {k} that is long enough to have a key of its own\n {LINE.upper()}\t\n\nshort\n{LINE}") for k in range(12)]
    + [(k, ACCENTS + "\n" + "É" * 40 + "\n" + "ü" * 39) for k in range(20, 26)]
    + [(None, LINE), (None, None), (30, ""), (31, None), (11, LINE), (11, LINE), (5, DUP := "twice under one id, and long enough to be a key, too"), (5, DUP)]
    + [(k, "only four documents hold this line, so it stays where it is") for k in range(40, 44)]
    + [(None, "no holder of this line has an id, so all of them keep it.")] * 6
    + [(50, "\n".join([LINE, "a long text of many lines, this is one of them, number 1"] * 20_000)), (51, "\n\n"), (52, "x" * 500_000), (53, "\x1c" + LINE), (54, LINE + "\x0b\x0c\r")]
)


@pytest.mark.parametrize("local_bytes,group_probes,shard_keys", [(1 << 20, 9, 1_000_000), (1 << 20, 9, 2), (0, 9, 2), (0, 1_000_000, 1)])
def test_equals_brute_force(spark, local_bytes, group_probes, shard_keys):
    docs = spark.createDataFrame([(*d, "r", 1, "k", "d") for d in DOCS], SCHEMA).repartition(5)
    index = line_dedup.build_index(docs, shard_keys=shard_keys)
    assert index.shards > 1 or shard_keys > 2
    got = line_dedup.probe_lines(docs, index, local_bytes=local_bytes, group_probes=group_probes).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS)


def test_whole_table_both_ways(docs):
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for local_bytes in (1 << 20, 0):
        assert sorted(map(tuple, line_dedup.line_dedup(docs, local_bytes=local_bytes).collect()), key=repr) == expected
    assert sum(x[2] for x in expected) > 20  # 36 of 1829 lines


def test_columns_stay(spark):
    docs = spark.createDataFrame([(*d, "r", k, "k", "d") for k, d in enumerate(DOCS)], SCHEMA)
    kept = line_dedup.keep_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(x[0], x[3]) for x in brute(DOCS)], key=repr)
    assert {(r.row, r.kept_text, r.doc) for r in kept.collect()} == {("r", "k", "d")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    index = line_dedup.build_index(docs)
    for local_bytes in (1 << 20, -1):
        assert line_dedup.probe_lines(docs, index, local_bytes=local_bytes).count() == 0
