"""Nearest neighbours, the quality classifier and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import ann, quality


def brute(ids, x, q, k):
    s = x @ x[ids == q][0]
    m = ids != q
    o = np.lexsort((ids[m], -s[m].round(12)))[:k]
    return ids[m][o], s[m][o]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_on_the_fixture(spark, sf_dir, scale):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if scale:  # inner products, not angles
        df = df.withColumn("embedding", F.transform("embedding", lambda v: v * (1 + F.col("vec_id") % 5)))
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(ids[ids % 20 == 0])
    hits = 0
    for q, found in got.items():
        want, _ = brute(ids, x, q, 20)
        hits += len(set(want) & {v for v, _ in found})
        scores = [s for _, s in found]
        assert len(found) == 20 and scores == sorted(scores, reverse=True) and q not in {v for v, _ in found}
        for v, s in found[:3]:
            assert abs(s - x[ids == q][0] @ x[ids == v][0]) < 1e-9
    assert hits / (20 * len(got)) >= 0.9


def test_recall_at_scale(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found & set(brute(ids, x, q, 20)[0])) for q, found in got.items()) / (20 * len(got)) >= 0.93


def test_lists_grow_and_structure_needs_few_probes():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 16)) * 4
    x = centres[rng.integers(200, size=6000)] + rng.standard_normal((6000, 16)) * 0.2
    top = float((x**2).sum(axis=1).max())
    small, large = ann.Index(x, top, 6000, 20), ann.Index(x, top, 60_000, 20)
    assert len(large.centres) > 3 * len(small.centres)
    assert small.n_probe < 0.3 * len(small.centres)


def test_edges_and_ties(spark):
    bad = [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (None, [1.0, 0.0]), (101, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), *[(i, [1.0, 0.0]) for i in range(1, 31)], (40, [0.0, 1.0]), (41, [-1.0, 0.0]), (40, [0.0, 1.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    assert [v for _, v, _ in got[0]] == list(range(1, 21))  # of equal scores the smaller ids
    assert [v for _, v, _ in got[20]] == [*range(0, 20)]
    few = ann.search(df.filter("vec_id in (0, 40, 41)"), F.col("id") % 20 == 0, k=20)
    assert {(r.query_id, r.rank, r.vec_id) for r in few.collect()} == {(0, 1, 40), (0, 2, 41), (40, 1, 0), (40, 2, 41)}
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 100"), F.col("id") % 20 == 0).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) > 0)
    model = quality.train(docs, known)
    scored = quality.score(docs, model)
    assert scored.count() == docs.count()
    held = scored.join(labels.join(known, "doc_id", "left_anti"), "doc_id")
    right = held.filter((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).count()
    clean = held.filter("quality = 1")
    assert right / held.count() >= 0.95 and clean.filter("accepted").count() / clean.count() >= 0.97
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == scored.filter("accepted").count()


def test_scores_equal_a_plain_computation(spark, sf_dir):
    """The whole co-training once more, in memory, over all rows."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    fold = {d: 4 - k % 5 for q in (0, 1) for k, d in enumerate(x for x in order if known[x] == q)}
    views = [np.stack([quality.text_view(r.text) for r in rows]), np.stack([quality.metadata_view(r.lang, r.source, r.n_chars) for r in rows])]
    y = np.array([known.get(r.doc_id, np.nan) for r in rows])
    f = np.array([fold.get(r.doc_id, 9) for r in rows])
    given, edge = np.where(f >= 2, y, np.nan), np.log(0.97 / 0.03)

    def fit(x, y):
        x, y = x[~np.isnan(y)], y[~np.isnan(y)]
        means = [x[y == c].mean(axis=0) for c in (0, 1)]
        rest = np.concatenate([x[y == c] - means[c] for c in (0, 1)])
        spread = np.where(rest.std(axis=0) < 1e-9, 1, rest.std(axis=0))
        z = rest / spread
        w = np.linalg.solve(z.T @ z / len(z) + 1e-3 * np.eye(x.shape[1]), (means[1] - means[0]) / spread) / spread
        return lambda v: v @ w + np.log(np.mean(y == 1) / np.mean(y == 0)) - w @ (means[0] + means[1]) / 2

    models = [fit(v, given) for v in views]
    for _ in range(2):
        margins = [m(v) for m, v in zip(models, views)]
        labels_by = [np.where(np.isnan(y) & (np.abs(m) > edge), m > 0, given) for m in margins]
        models = [fit(views[0], labels_by[1]), fit(views[1], labels_by[0])]
    model = quality.train(docs, labels)
    for got, want, view in ((model.text, models[0], views[0]), (model.metadata, models[1], views[1])):
        assert np.allclose(got.margin(view), want(view), rtol=1e-3, atol=1e-3)
    want = model.combined.margin(np.stack([np.clip(model.text_calibration.margin(models[0](views[0])[:, None]), -700, 700), model.metadata_calibration.margin(models[1](views[1])[:, None])], axis=1))
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(scored) == len(rows)
    assert all(abs(scored[r.doc_id].quality_score - 1 / (1 + np.exp(-np.clip(w, -700, 700)))) < 1e-2 for r, w in zip(rows, want))
    assert all(scored[r.doc_id].accepted == (scored[r.doc_id].quality_score >= 0.5) for r in rows)


def test_rare_class_and_no_cap(spark):
    texts = [(i, "!!! BAD ### " * 9 if i % 50 == 0 else f"good words here number {i} " * 9, "en", "s", 90) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 50 != 0)) for i in range(0, 200)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels))
    assert {r.doc_id for r in scored.filter("not accepted").collect()} == set(range(0, 400, 50))
    few = quality.score(docs, quality.train(docs, labels.filter("doc_id in (0, 1)")))
    assert few.count() == 400 and few.filter("quality_score is null").count() == 0


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "", "en", 3), (None, "x " * 50_000, None, 3), (2, "", "en", 3)], "doc_id long, text string, lang string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.accepted for r in quality.score(df, quality.train(df, none)).collect()} == {True}
    assert quality.keep_good(df, none).count() == 4
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(i, "good words here " * 9 if i % 2 else "!!! BAD ### " * 9, "en", 0) for i in range(40)] + [(90, None, None, 0), (None, "", None, 0)], "doc_id long, text string, lang string, quality int")
    scored = quality.score(many, quality.train(many, labels))
    assert scored.count() == 42 and scored.filter("quality_score is null").count() == 0
    assert quality.score(many.limit(0), quality.train(many, labels)).count() == 0


def test_pipeline(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir).cache()
        assert out.columns == docs.columns, name
        seen.append(out)
    good, exact, near, mixed = seen[1:]
    bad = labels.filter("quality = 0").select("doc_id")
    assert good.join(bad, "doc_id").count() <= 0.1 * bad.count()
    assert exact.select(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t")).distinct().count() == exact.count()
    assert near.count() <= exact.count() and near.join(exact, "doc_id", "left_anti").count() == 0
    words = lambda d: d.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(near)) <= 30
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.agg(F.max("offset")).first()[0] < 2048 and final.count() >= near.count()


def test_pipeline_edges(spark, sf_dir):
    """Empty tables, null and repeated ids, null texts and columns with the operators' inner names go through every stage."""
    shape = "doc_id long, text string, lang string, source string, n_chars int, size string, key string, row string, root string"
    rows = [(None, None, None, None, None), (None, "a b c", "en", "s", 5), (7, "x " * 3000, "en", "s", 6000), (7, "y " * 40, "en", None, 80), (7, "y " * 40, "en", None, 80), (8, "", "de", "t", 0)]
    for docs in (spark.createDataFrame([], shape), spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], shape)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count() and (out.count() > 0) == (docs.count() > 0), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.filter("start = 0").count() == docs.count()


def test_a_stage_called_by_itself_removes_the_shuffle_files_of_its_jobs(spark, sf_dir):
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []

    @corpus_pipeline.tidied
    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(key))
        return docs

    before = spark.conf.get(key, None)
    stage(spark, None, sf_dir)
    assert seen == ["true"] and spark.conf.get(key, None) == before
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
