"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are made one dimension longer so that the largest inner product is the least distance, turned by a random rotation
and stored in column blocks; k-means on a bounded sample (MAX_SAMPLE rows, those first in hash order) sets the lists, about two
for every root of the rows, and every row goes to the list of its nearest centre. A query probes as many of its nearest lists as
the sample's own queries need for TARGET of their true neighbours. Its SEED_LISTS nearest ones give a first bound, the k-th least
distance found there; in the others a candidate's distance grows block by block, and a hypothesis test on the partial distance
drops the candidate once it can hardly fall under the bound. What is left gets its exact inner product on the original vectors.

Neighbouring lists make a group of about CANDIDATE_BLOCK rows; a query is sent once to each group that holds lists it probes.
Groups are dealt into blocks of candidates and queries, each pair of blocks a task, so a list of any size (one vector may be
a third of all rows) is spread out and nothing is capped.

Defined results: rows with a null id, and vectors that are null, zero, hold null or non-finite components or have another
length than most, take no part; ties go to the smaller id; a query with fewer candidates gets all of them that its lists
hold; repeated rows count once; an empty table gives no rows. Vectors without any structure need many probes: of random
directions in 64 dimensions, two lists in three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.llm.common import checkpoint, read

MAX_LISTS, SEED_LISTS, MAX_SAMPLE = 2048, 4, 20_000
#: Share of the sample's true neighbours that the probed lists have to hold; queries it is measured on.
TARGET, MEASURED = 0.97, 256
#: Dimensions in a column block; the test's width in standard deviations.
COLUMNS, WIDTH = 16, 2.6
#: Share of living pairs below which they are followed one by one: about where that is faster than whole blocks.
SPARSE = 0.03
CANDIDATE_BLOCK, QUERY_BLOCK = 1024, 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """id, v (doubles) of the rows that take part, and their dimension."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    good = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.coalesce(good, F.lit(False)))
    top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top["d"] if top else 0
    return v.filter(F.size("v") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Index:
    """Rotation, list centres and what to probe; small, and carried by every task."""

    def __init__(self, sample: np.ndarray, top: float, n_rows: int, k: int, n_lists: int | None = None, n_probe: int | None = None, seed: int = 7):
        self.d, self.top = sample.shape[1], top
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((self.d + 1, self.d + 1)))[0]
        rows = self.rows(sample)
        x = np.unique(rows, axis=0)
        centres = x[rng.choice(len(x), min(n_lists or min(max(16, 2 * int(n_rows**0.5)), MAX_LISTS), len(x)), replace=False)]
        for _ in range(12):
            at = self._nearest(x, centres)
            sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
            np.add.at(sums, at, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        way = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
        self.centres = centres[np.argsort(centres @ way, kind="stable")]  # neighbours follow each other
        self.grouped = max(1, round(CANDIDATE_BLOCK * len(centres) / max(n_rows, 1)))
        self.n_probe = min(len(centres), n_probe or self._needed(sample, rows, k))

    def _needed(self, sample: np.ndarray, rows: np.ndarray, k: int) -> int:
        """Lists, nearest first, that hold TARGET of the k nearest rows of some of the sample's vectors."""
        q = sample[:MEASURED]
        score = sample @ q.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 1), axis=0)[:k].T  # the query itself is none of its neighbours
        place = np.argsort(self.order(q), axis=1)
        turn = np.take_along_axis(place, self._nearest(rows, self.centres)[near], axis=1)
        return max(SEED_LISTS, int(np.quantile(turn, TARGET, method="higher")) + 1)

    def rows(self, v: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", v, v), 0))
        return np.concatenate([v, last[:, None]], axis=1) @ self.rotation

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.zeros((len(v), 1))], axis=1) @ self.rotation

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmax(x @ centres.T - np.einsum("ij,ij->i", centres, centres) / 2, axis=1)

    def order(self, v: np.ndarray) -> np.ndarray:
        """All lists of each query, nearest first."""
        c = self.centres
        return np.argsort(np.einsum("ij,ij->i", c, c) / 2 - self.queries(v) @ c.T, axis=1, kind="stable")

    def blocks(self) -> list[tuple[int, int]]:
        return [(s, min(s + COLUMNS, self.d + 1)) for s in range(0, self.d + 1, COLUMNS)]


def build(v: DataFrame, k: int = 20, n_lists: int | None = None, n_probe: int | None = None, max_sample: int = MAX_SAMPLE) -> Index | None:
    """The index over usable vectors, fitted on at most max_sample of them."""
    n, top = v.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not n:
        return None
    some = v.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v").toArrow()["v"].combine_chunks()
    return Index(_matrix(some, len(some[0])), top, n, k, n_lists, n_probe)


def _scan(index: Index, k: int):
    """Top k of every query of a block among the candidates of a block in the lists it probes, by adaptive dimension scan where
    a bound is known."""
    total = index.d + 1

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float), "distance": np.array([], float)})
        if not len(c) or not len(q):
            return empty
        ids, first = np.unique(c["id"].to_numpy(), return_index=True)
        q = q.drop_duplicates("id")
        qids, qv, bound = q["id"].to_numpy(), np.stack([np.frombuffer(x) for x in q["v"]]), q["bound"].to_numpy(dtype=float)
        y = index.queries(qv)
        lists, at = np.unique(c["list"].to_numpy()[first], return_inverse=True)
        asked = np.concatenate(q["lists"].to_list())
        place = np.minimum(np.searchsorted(lists, asked), len(lists) - 1)
        probed = np.zeros((len(q), len(lists)), dtype=bool)
        probed[np.repeat(np.arange(len(q)), q["lists"].map(len))[lists[place] == asked], place[lists[place] == asked]] = True
        live = probed[:, at] & (qids[:, None] != ids[None, :])
        part, i, j = np.zeros(live.shape), None, None
        for n, (s, e) in enumerate(index.blocks()):
            a, b = y[:, s:e], np.frombuffer(b"".join(c[f"x{n}"].iloc[first]), np.float32).reshape(len(ids), e - s).astype(float)
            # of a rotated difference, e of all dimensions hold about e / total of the squared length
            limit = bound * (e / total) * (1 + WIDTH / np.sqrt(e)) ** 2 if e < total else bound
            limit = limit + 1e-5 * (limit + index.top)  # blocks are stored in single precision
            if i is None:  # many pairs live: whole blocks
                part += np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
                live &= part <= limit[:, None]
                if e == total or live.mean() < SPARSE:
                    i, j = np.nonzero(live)
                    part = part[i, j]
            else:  # few pairs live: only those
                gap = a[i] - b[j]
                part = part + np.einsum("ij,ij->i", gap, gap)
                keep = part <= limit[i]
                i, j, part = i[keep], j[keep], part[keep]
            if i is not None and not len(i):
                return empty
        cv = np.frombuffer(b"".join(c["v"].iloc[first])).reshape(len(ids), index.d)
        score = np.einsum("ij,ij->i", qv[i], cv[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, part, score = i[order], j[order], part[order], score[order]
        starts = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        keep = rank < k
        return pd.DataFrame({"query_id": qids[i[keep]], "vec_id": ids[j[keep]], "score": score[keep], "distance": part[keep]})

    return run


HITS = "query_id long, vec_id long, score double, distance double"


def _met(listed: DataFrame, probes: DataFrame, scan) -> DataFrame:
    """Scan the lists that each query probes in a group, dealt into blocks. The table of block counts has a row per group."""
    p = listed.groupBy("grp").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).alias("p"))
    q = probes.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("q"))
    blocks = F.broadcast(p.join(q, "grp"))
    c = listed.join(blocks, "grp").withColumn("c_at", F.pmod(F.xxhash64("id"), "p")).withColumn("q_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    r = probes.join(blocks, "grp").withColumn("q_at", F.pmod(F.xxhash64("id"), "q")).withColumn("c_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    key = ["grp", "c_at", "q_at"]
    stored = [x for x in listed.columns if x != "grp"]
    return c.select(*key, *stored).groupBy(*key).cogroup(r.select(*key, "id", "v", "lists", "bound").groupBy(*key)).applyInPandas(lambda a, b: scan(a, b), HITS)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", n_lists: int | None = None, n_probe: int | None = None, seed_lists: int = SEED_LISTS, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each query. is_query is a condition on the column `id`; lists and
    probes follow from the rows and the sample unless given."""
    v, d = usable(vectors, id_col, vec_col)
    index = build(v, k, n_lists, n_probe, max_sample)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    spans = index.blocks()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"), d)
                x = index.rows(m)
                at = Index._nearest(x, index.centres)
                raw = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (m, *(np.ascontiguousarray(x[:, s:e], np.float32) for s, e in spans))]
                yield pa.RecordBatch.from_arrays([pa.array(at // index.grouped, pa.int32()), pa.array(at, pa.int32()), b.column("id"), *raw], names=["grp", "list", "id", "v", *(f"x{i}" for i in range(len(spans)))])

    def probe(turns: slice):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column("v"), d)
                    row, grp, lists = [], [], []
                    for i, mine in enumerate(index.order(m)[:, turns]):
                        mine = np.sort(mine)
                        groups, starts = np.unique(mine // index.grouped, return_index=True)
                        row += [i] * len(groups)
                        grp += groups.tolist()
                        lists += [x.tolist() for x in np.split(mine, starts[1:])] if len(groups) else []
                    ids, raw = b.column("id").take(pa.array(row, pa.int64())), [x.tobytes() for x in m]
                    yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(lists, pa.list_(pa.int32())), ids, pa.array([raw[i] for i in row], pa.binary())], names=["grp", "lists", "id", "v"])

        return run

    listed = checkpoint(v.mapInArrow(assign, "grp int, list int, id long, v binary, " + ", ".join(f"x{i} binary" for i in range(len(spans)))))
    asked, shape, scan = v.filter(is_query), "grp int, lists array<int>, id long, v binary", _scan(index, k)
    first = asked.mapInArrow(probe(slice(0, seed_lists)), shape)
    near = checkpoint(_met(listed, checkpoint(first).withColumn("bound", F.lit(float("inf"))), scan))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    bounds = near.dropDuplicates(["query_id", "vec_id"]).withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("found"))
    rest = checkpoint(asked.mapInArrow(probe(slice(seed_lists, index.n_probe)), shape).join(bounds, "id", "left").withColumn("bound", F.coalesce("found", F.lit(float("inf")))))
    far = _met(listed, rest, scan)
    hits = near.unionByName(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
