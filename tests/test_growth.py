"""Steps whose memory or time grew with whole tables: results as before, and the work dealt out or done once."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.ml import panel as L
from quantloom.operators import candidates as C, evaluation as E
from quantloom.queries import candidates as QC, models, more
from quantloom.queries.evaluation import fp
from quantloom.queries.tables import FACTORS, built


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ic_decay_pools_ranks_without_a_task_for_a_whole_horizon(spark, monkeypatch):
    monkeypatch.setattr(E, "RANGES", 5)
    rng = random.Random(3)
    rows = [(i, d, rng.choice([None, 1.0, 1.0, 2.0, rng.random(), float("inf")]), rng.choice([None, 0.0, -0.0, rng.random()])) for i in range(30) for d in range(12) if rng.random() < 0.9]
    p = spark.createDataFrame(rows, "instrument long, day int, x double, ret double")
    got = E.ic_decay(p, "x", "ret", [1, 2, 7])
    a = p.filter("x is not null").select("instrument", "day", "x", F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("h"))
    b = p.filter("ret is not null").select("instrument", (F.col("day")).alias("later"), F.col("ret").alias("label"))
    pairs = a.withColumn("later", F.col("day") + F.col("h")).join(b, ["instrument", "later"])
    want = E.with_ranks(pairs, ["h"], ["x", "label"]).groupBy("h").agg(F.count("*").alias("n"), E.pearson("r_x", "r_label").alias("rank_ic"))
    want = {r.h: (r.n, r.rank_ic) for r in want.collect()}
    told = {r.h: (r.n, r.rank_ic) for r in got.collect()}
    assert told.keys() == want.keys()
    for h in want:
        assert told[h] == (want[h][0], pytest.approx(want[h][1], abs=1e-12))
    plan = _plan(got)
    assert "hashpartitioning(h#" in plan and f", {E.TASKS}), REPARTITION_BY_NUM" in plan
    same = spark.createDataFrame([(i, d, 1.0, float(i)) for i in range(4) for d in range(3)], "instrument long, day int, x double, ret double")
    assert [(r.n, r.rank_ic) for r in E.ic_decay(same, "x", "ret", [1]).collect()] == [(8, None)]
    assert E.ic_decay(same.filter("x > 1"), "x", "ret", [1]).count() == 0


def test_daily_similarity_deals_pairs_and_dates_out(spark):
    v = spark.createDataFrame([(f, i, "2020-01-01", float(i * s % 11)) for f, s in (("a", 3), ("b", 5)) for i in range(25)], "factor string, instrument long, date string, value double")
    assert _plan(C.daily_similarity(v)).count(f", {C.TASKS}), REPARTITION_BY_NUM") >= 2


def test_gates_under_two_costs_make_one_ledger_from_one_pass_over_the_weights(spark, sf_dir, monkeypatch):
    made, ledgers = [], C.ledgers
    monkeypatch.setattr(C, "ledgers", lambda w, *a: made.append(w) or ledgers(w, *a))
    QC._gated(spark, sf_dir)
    assert len(made) == 1 and len(made[0].inputFiles()) > 0 and "Window" not in _plan(made[0])


def test_scores_are_validated_on_one_panel(spark, sf_dir, monkeypatch):
    seen, panel = [], more.fp
    monkeypatch.setattr(more, "fp", lambda *a: seen.append(a) or panel(*a))
    out = more._validated(spark, sf_dir)
    assert len(seen) == 1 and "lineitem" not in _plan(out)


def test_trees_on_cells_predict_what_trees_on_rows_do(spark):
    import datetime as dt

    from quantloom.ml import panel as L

    rng = random.Random(5)
    rows = [(i, dt.date(2020, 1, 1), rng.random(), float(rng.randrange(5)), float(i % 3 == 0), 0.0, rng.random()) for i in range(600)]
    p = L.assemble(spark.createDataFrame(rows, "instrument long, date date, a double, b double, missing_a double, missing_b double, target double"), ["a", "b"])
    model = L.candidates()["trees"]
    fitted, places = L.fit_trees(model, p, ["a", "b"])
    got, want = ({r.instrument: r.prediction for r in df.collect()} for df in (fitted.transform(places(p)), model.fit(p).transform(p)))
    assert len(got) == 600 and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_ranked_features_come_from_one_panel(spark):
    sf = "/root/testdata/sf0.001"
    got = models._features(spark, sf)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1  # one read of the lines
    t = L.targets(fp(spark, sf), "label", 20).select("instrument", "date", "target")
    want = L.features(built(spark, sf), FACTORS).join(t, ["instrument", "date"]).filter("target is not null and present")
    columns = sorted(want.columns)
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert sorted(got.columns) == columns
    small = fp(spark, sf).filter("eligible").select("instrument", "date", *FACTORS)
    ranked = L.ranked(fp(spark, sf), "eligible", FACTORS).select("instrument", "date", *FACTORS)
    assert small.count() > 0 and sorted(map(tuple, ranked.collect())) == sorted(map(tuple, built(spark, sf).select("instrument", "date", *FACTORS).collect()))
    assert rows(got) == rows(want)
