"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random
import re

import corpus_pipeline
from quantloom.llm import near_copies


def brute_kept(rows, similar=0.8):
    """The smallest id of every group joined by chains of similar texts."""
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if n >= similar * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), x), x)
    return sorted(least.values())


def kept(spark, rows, sf_dir):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, sf_dir).collect())


def test_fixture_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows, sf) == brute_kept(rows)


def test_group_of_chains(spark, sf_dir):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, "One two"), (4, "one  TWO"), (5, "one two three")]
    for i in range(6, 180):  # copies of copies, and each with words of its own
        words = rng.choice(rows[:1] + rows[6:])[1].split()
        for _ in range(rng.choice([1, 2, 4])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute_kept(rows)
    assert 5 < len(want) < 170 and kept(spark, rows, sf_dir) == want
    small = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), block=7)  # many blocks
    assert sorted(r.doc_id for r in small.collect()) == want


def test_simhash_proposes_pairs(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(2000)]
    other = [*base[:1000], "new", *base[1001:]]
    rows = [(0, " ".join(base)), (1, " ".join(other)), (2, "far from both of them and short"), (3, "far from both of them and brief")]
    d = near_copies.sketches(spark.createDataFrame(rows, "__row long, text string"))
    nodes = {r.node: r["__row"] for r in d.collect()}
    found = {frozenset((nodes[r.a], nodes[r.b])) for r in near_copies.by_simhash(d).collect()}
    bits = {r["__row"]: r.fp & (2**64 - 1) for r in d.collect()}
    assert (bits[0] ^ bits[1]).bit_count() <= 3 and found == {frozenset((0, 1))}
