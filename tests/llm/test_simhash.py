"""SimHash fingerprints, links and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import near_copies, simhash
from quantloom.llm.components import components


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [least[find(i)] for i in range(len(ids))]


TEXTS = [
    None, "", " \n\t ", "one", "one", "One TWO", "a b c", "A B C", "a b c d e f", "ÄÖ ä b c d", "x y z w", "long " * 5000,
    "the quick brown fox jumps over the lazy dog again and again " * 9, "the quick brown fox jumps over the lazy dog again and again " * 9 + "end", "a\x0bb\x1cc d e",
]


def test_query_matches_brute_force(spark):
    rows = [(i, t, f"s{i}", "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: r for r in simhash.near_dedup(df).collect()}
    fps = [brute_fp(t) for t in TEXTS]
    assert [int(got[i].fingerprint, 16) for i in range(len(TEXTS))] == fps
    assert [got[i].component_id for i in range(len(TEXTS))] == brute_components(range(len(TEXTS)), fps)


@pytest.mark.parametrize("block", [7, 1024])
def test_dense_groups(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    near = centre[rng.integers(0, 6, 700)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) * (rng.random(700) < 0.8)
    fps = np.unique(np.concatenate([near, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    got = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), block=block)
    want = brute_components(fps.view(np.int64).tolist(), [int(x) for x in fps])
    have = {r.node: r.root for r in components(got).collect()}
    assert [have.get(x, x) for x in fps.view(np.int64).tolist()] == want
    assert got.count() < 40 * len(fps)


def test_fixture_documents(spark, docs):
    got = simhash.near_dedup(docs).orderBy("doc_id").collect()
    rows = docs.orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in rows]
    assert [int(r.fingerprint, 16) for r in got] == fps
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in rows], fps)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "only here and there")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_dedup(df).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(chain).collect()} == {1}


def test_one_row_of_a_component_stays(spark):
    rows = [(None, "a b c d"), (None, "A b  c d"), (None, "only here and there"), (4, "one other text of words"), (4, "quite another one altogether so"), (4, "one other text of words"), (3, "quite another one altogether so")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep_one in (simhash.keep_one, near_copies.keep_one):
        got = sorted((r.doc_id or -1, r.text.lower().replace("  ", " ")) for r in keep_one(df).collect())
        assert got == [(-1, "a b c d"), (-1, "only here and there"), (3, "quite another one altogether so"), (4, "one other text of words")]
