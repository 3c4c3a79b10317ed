"""Near copies by exact Jaccard similarity of five-word shingles.

A SimHash of every shingle set comes first: sets within RADIUS bits are proposed as pairs by ball hashing (`simhash.links`). At
similarity 0.8 two of them differ by about ten bits, so it can't find all pairs. So every document also carries BANDS
fingerprints, each of ROWS least values of its shingles under different hashes. Two documents of similarity 0.8 share a
fingerprint with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9998, more similar ones sooner, and every pair that counts is
verified on its whole shingle sets (32-bit hashes).

Only distinct shingle sets take part. Documents that share a fingerprint make a bucket. In a star round each member of a
bucket is compared with its leader, the member that shares most fingerprints with others, and what links is one component from
then on; so a large group of near copies costs a comparison or two per member. Where a bucket's members stay in several
components, those outside its largest one are compared with all others: blocks of both are dealt over tasks, and a task
returns a link for each component that a member reaches, so no pair becomes a row and no connection is lost. Buckets of the
same members count once.

Defined results: letters A-Z count as lower case; fewer words than a shingle make one shingle; null and blank texts are
copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import attach, checkpoint, keep_first, keyed
from quantloom.llm.components import components
from quantloom.llm import simhash
from quantloom.llm.simhash import _GAP, _LOWER, BLOCK, HASHES, SEED

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Shingles in a block of members, about.
WIDE = 1 << 20
#: Shingles hashed under all functions in one piece.
PIECE = 4096
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_MIX[1] |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    line = _GAP.sub(b" ", raw).strip(b" ")
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n, digest = len(blanks) + 2 - shingle, xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    starts, ends = [0, *(blanks[: n - 1] + 1).tolist()], [*blanks[shingle - 1 :].tolist(), len(line)]
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The BANDS fingerprints of a shingle set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), PIECE):
        least = np.minimum(least, ((hashes[None, k : k + PIECE] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a shingle set, signed: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), HASHES):
        counts += np.unpackbits(hashes[k : k + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def sketches(rows: DataFrame) -> DataFrame:
    """__row, node (hash of the shingle set), size (shingles in it), fp (its SimHash) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("text")]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            values = pa.array(np.concatenate([np.empty(0, np.int64), *map(bands, sets)]))
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, values)
            fps = pa.array(list(map(majority, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), fps, lists], names=["__row", "node", "size", "fp", "bands"])

    return rows.select("__row", F.col("text").cast("string").alias("text")).mapInArrow(run, "__row long, node long, size long, fp long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """node and its shingles, as sorted distinct 32-bit hashes: enough for one pair's overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [np.unique((shingles(t.as_py()) >> np.uint64(32)).astype("<u4")).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(short, pa.binary())], names=["node", "shingles"])

    return rows.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at least that similar. Many members may have one leader b; its set goes to
    them by broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(c: str) -> DataFrame:
        n = pairs.groupBy(c).agg(F.count("*").alias("n"))
        return n.join(sets, F.col(c) == F.col("node")).select(c, "n", F.col("shingles").alias(f"of_{c}"))

    met = attach(attach(pairs, side("b"), "b", "n").drop("n"), side("a"), "a", "n").select("a", "b", "of_a", "of_b")
    return checkpoint(met.mapInArrow(run, "a long, b long"))


def reached(left: list[tuple], right: list[tuple], similar: float) -> list[tuple[int, int]]:
    """Links (a, b) of a block of members (node, root, shingles) with another: for each a one for every other component (root)
    that holds a b at the similarity."""
    right = sorted(right, key=lambda r: len(r[2]))
    width = np.array([len(r[2]) for r in right])
    nodes, roots, ends = np.array([r[0] for r in right]), np.array([r[1] for r in right]), np.concatenate([[0], np.cumsum(width)])
    code = np.unique(np.concatenate([x[2] for x in left + right]), return_inverse=True)[1]
    mine = np.concatenate([[0], np.cumsum([len(x[2]) for x in left])])
    theirs, mark, found = code[mine[-1] :], np.zeros(code.max() + 1, dtype=np.int32), []
    for k, (node, root, own) in enumerate(left):
        # sets whose sizes are further apart can't be similar enough
        i, j = np.searchsorted(width, similar * len(own) - 1e-9), np.searchsorted(width, len(own) / similar + 1e-9, "right")
        if i == j or (roots[i:j] == root).all():
            continue
        at = code[mine[k] : mine[k + 1]]
        mark[at] = 1
        both = np.add.reduceat(mark[theirs[ends[i] : ends[j]]], ends[i:j] - ends[i])
        mark[at] = 0
        hit = np.flatnonzero((both >= similar * (len(own) + width[i:j] - both)) & (roots[i:j] != root)) + i
        found += [(node, int(nodes[h])) for h in hit[np.unique(roots[hit], return_index=True)[1]]]
    return found


def _rest(m: DataFrame, sets: DataFrame, similar: float, block: int) -> DataFrame:
    """Links between members (band, node, size, root) of one bucket that are in different components."""
    held = m.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("width"), F.bit_xor(F.xxhash64("node")).alias("mark"))
    at = held.groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("width").alias("width"),
        F.max("n").alias("n_main"), F.max_by("width", F.struct("n", "root")).alias("main_width"), F.bit_xor("mark").alias("mark"),
    )
    parts = lambda n, w: F.ceil(F.greatest(n / block, w / WIDE))
    at = at.filter("roots > 1 and n > 2").groupBy("n", "mark").agg(F.min_by(F.struct("band", "main", parts(F.col("n") - F.col("n_main"), F.col("width") - F.col("main_width")).alias("p"), parts(F.col("n"), F.col("width")).alias("q")), "band").alias("b"))
    m = checkpoint(attach(m, at.select("b.*", "n"), "band", "n"))  # two members have met in the star round
    deal, every = F.xxhash64("node"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = m.filter("root <> main").select("band", "node", "root", F.lit(True).alias("seeks"), F.pmod(deal, F.col("p")).alias("p_at"), every("q").alias("q_at"))
    right = m.select("band", "node", "root", F.lit(False).alias("seeks"), every("p").alias("p_at"), F.pmod(deal, F.col("q")).alias("q_at"))
    key = ["band", "p_at", "q_at"]
    dealt = left.unionByName(right).join(sets.hint("shuffle_hash"), "node").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def out():
            got = reached(*sides, similar) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*key, "node", "root", "seeks", "shingles")]
            for band, p, q, node, root, seeks, raw in zip(*cols):
                if (band, p, q) != now:
                    if now is not None:
                        yield out()
                    now, sides = (band, p, q), ([], [])
                sides[0 if seeks else 1].append((node, root, np.frombuffer(raw, "<u4")))
        if now is not None:
            yield out()

    return checkpoint(dealt.select(*key, "node", "root", "seeks", "shingles").mapInArrow(run, "a long, b long"))


def by_simhash(f: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of nodes (columns node, size, fp; a > b) that SimHash proposes: those of one fingerprint with the least of them, and
    the least ones of fingerprints whose bits link. Sizes too far apart can't be similar enough."""
    same = checkpoint(f.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("l"), F.count("*").alias("n")))
    own = attach(f.select("node", "size", "fp"), same.select("fp", F.col("l.node").alias("b"), F.col("l.size").alias("b_size"), "n").filter("n > 1"), "fp", "n")
    own = own.filter("node <> b").select(F.col("node").alias("a"), "size", "b", "b_size")
    one = lambda c: same.select(F.col("fp").alias(f"_{c}"), F.col("l.node").alias(c), F.col("l.size").alias("size" if c == "a" else "b_size"))
    linked = simhash.links(same.select("fp")).select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(one("a"), "_a").join(one("b"), "_b")
    pairs = own.unionByName(linked.select("a", "size", "b", "b_size")).filter(F.least("size", "b_size") >= F.lit(similar) * F.greatest("size", "b_size"))
    return checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def near_components(rows: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """__row, root of every row (columns __row, text): rows have one root where chains of pairs at the similarity join them."""
    d = checkpoint(sketches(rows))
    f = checkpoint(d.groupBy("node").agg(F.min("__row").alias("__row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    member = f.select("node", "size", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    member = checkpoint(attach(member, shared, "band", "n"))
    met = checkpoint(member.groupBy("node").agg(F.sum("n").alias("met")))
    close = by_simhash(f, similar)
    needed = met.select("node").union(close.select("a")).union(close.select("b")).distinct()
    needed = f.join(needed, "node", "left_semi").select("node", "__row")
    sets = checkpoint(_sets(rows.join(needed.hint("shuffle_hash"), "__row").select("node", "text")))
    # the star round
    ranked = member.join(met, "node")
    lead = ranked.groupBy("band").agg(F.min(F.struct(-F.col("met"), F.xxhash64("node"), F.col("node").alias("b"), F.col("size").alias("b_size"))).alias("l"), F.count("*").alias("n")).select("band", "l.b", "l.b_size", "n")
    pairs = attach(member.drop("n"), lead, "band", "n").filter("node <> b").filter(F.least("size", "b_size") >= F.lit(similar) * F.greatest("size", "b_size"))
    pairs = checkpoint(pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).union(close).distinct())
    links = _verified(pairs, sets, similar)
    roots = checkpoint(components(links))
    # what it left open
    more = _rest(member.drop("n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), sets, similar, block)
    if not more.isEmpty():
        roots = checkpoint(components(links.unionByName(more)))
    n = d.groupBy("node").agg(F.count("*").alias("n")).join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    return attach(d.select("__row", "node"), checkpoint(n), "node", "n").select("__row", "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Of documents joined by chains of near copies, the one with the smallest doc_id (any one without an id, if none has one),
    with all its columns."""
    rows = keyed(docs)
    return keep_first(rows, checkpoint(near_components(rows.select("__row", "text"), **how)))
