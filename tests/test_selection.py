"""Components, importance, candidates and the walk forward against plain computations."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from quantloom.ml import panel as L, selection as S

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) @ np.array([[2, 1, 0, 0], [0, 1, 0.5, 0], [0, 0, 0.3, 0], [0, 0, 0, 0.1]])
    x[:, 3] += x[:, 0]  # nearly a copy of the first
    y = x[:, 0] - 2 * x[:, 2] + rng.normal(size=400) * 0.1
    return x, y


@pytest.fixture(scope="module")
def panel(spark, table):
    x, y = table
    rows = [(k % 20, f"20{20 + k // 240}-{1 + k // 20 % 12:02d}-01", *map(float, x[k]), float(y[k])) for k in range(len(x))] + [(99, "2020-01-01", None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "instrument long, date string, a double, b double, c double, d double, target double")
    return df.withColumn("date", F.to_date("date")).repartition(3)


def test_moments_and_components(panel, table):
    x, _ = table
    m = S.moments(panel, NAMES)
    assert m.n == 400 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov, np.cov(x.T)) and np.allclose(m.correlation(), np.corrcoef(x.T))
    c = S.components(m, share=0.9)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    part = values[::-1] / values.sum()
    k = int(np.argmax(np.cumsum(part) >= 0.9)) + 1
    assert c.vectors.shape == (4, k) and np.allclose(c.shares, part[:k])
    assert all(c.vectors[np.argmax(np.abs(c.vectors[:, j])), j] > 0 for j in range(k))
    assert np.allclose(np.abs(c.vectors.T @ vectors[:, ::-1][:, :k]), np.eye(k), atol=1e-9)
    got = np.array([r[2:] for r in c.project(panel.drop("target")).filter("pc1 is not null").collect()])
    assert np.allclose(np.cov(got.T).reshape(k, k), np.diag(values[::-1][:k]))
    assert c.project(panel).columns == ["instrument", "date", "target", *[f"pc{j + 1}" for j in range(k)]]
    assert c.project(panel).filter("pc1 is null").count() == 1


def test_constant_features(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    c = S.components(S.moments(df, ["a", "b"]))
    assert len(c.shares) == 1 and np.allclose(c.vectors[:, 0], [0, 1])
    assert S.uncorrelated(df, ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        S.moments(df.limit(1), ["a", "b"])


def test_uncorrelated(panel, table):
    x, y = table
    for target, limit in ((None, 0.8), ("target", 0.8), ("target", 0.3), (None, 0.999)):
        corr, gone = np.corrcoef(x.T), set()
        worth = [abs(np.corrcoef(x[:, i], y)[0, 1]) for i in range(4)] if target else x.var(0)
        for i in range(4):
            for j in range(i + 1, 4):
                if not {i, j} & gone and abs(corr[i, j]) > limit:
                    gone.add(j if worth[i] >= worth[j] else i)
        assert S.uncorrelated(panel, NAMES, target, limit) == [n for k, n in enumerate(NAMES) if k not in gone]
    left, names = S.orthogonalize(panel, NAMES, "target", 0.8, share=0.99)
    assert left.columns == ["instrument", "date", "target", *names]


def test_combined_importance():
    split, permuted = {"a": 0.5, "b": 0.25, "c": 0.0, "d": 0.05}, {"a": 0.2, "b": 0.1, "c": -0.5, "d": 0.0}
    score, kept = S.combine(split, permuted, 40)
    assert score == {"a": 0.7 + 0.06, "b": 0.35 + 0.03, "c": 0.3 * -0.5, "d": 0.7 * 0.1}
    assert kept == ["a", "b"]  # the 30th percentile of the positive scores is above d
    assert S.combine(split, permuted, 1)[1] == ["a"] and S.combine({"a": 0.0}, {"a": 0.0}, 5)[1] == ["a"]


def test_importance_finds_what_matters(panel):
    data = L.features(panel, NAMES).filter("present").cache()
    train, held = data.filter("date < date'2021-04-01'"), data.filter("date >= date'2021-04-01'")
    i = S.importance(train, held, NAMES, limit=0.9, repeats=1)
    assert set(i.split) == {"a", "b", "c"} or set(i.split) == {"b", "c", "d"}
    first = "a" if "a" in i.split else "d"
    assert first in i.kept and i.combined[first] == max(i.combined.values()) and abs(sum(i.split.values()) - 1) < 1e-9
    dates = [r[0] for r in train.select("date").distinct().orderBy("date").collect()]
    shares = S.stability(train, held, NAMES, S.date_windows(dates, 10, 5), repeats=1, model=S.boosted(5, 3))
    assert shares[first] == 1.0 and shares["d" if first == "a" else "a"] in (0.0, 1 / len(S.date_windows(dates, 10, 5)))


def test_windows():
    assert S.date_windows(range(10), 4, 3) == [(0, 3), (3, 6), (6, 9)] and S.date_windows(range(3), 4, 2) == [(0, 2)]
    assert S.expanding_windows(range(11), 3) == [(0, 4), (0, 6), (0, 8)]
    with pytest.raises(ValueError):
        S.expanding_windows(range(2), 3)


def test_robust_takes_what_is_stable_both_ways(panel):
    stable = lambda *names: {n: float(n in names) for n in NAMES}
    assert S.robust(panel, NAMES, stable("a", "b"), stable("b", "c")) == ["b"]
    assert S.robust(panel, NAMES, stable("b"), stable("c")) == ["b", "c"] and S.robust(panel, NAMES, stable(), stable("c")) == ["c"] and S.robust(panel, NAMES, stable(), stable()) == []
    assert S.robust(panel, NAMES, stable("a", "d"), stable("a", "d")) in (["a"], ["d"])


@pytest.fixture(scope="module")
def rows(panel):
    p = panel.filter("a is not null").withColumn("exit_date", F.add_months("date", 1)).withColumn("label", F.col("target")).withColumn("present", F.lit(True))
    return VectorAssembler(inputCols=NAMES[:3], outputCol="features").transform(p).cache()


def test_trees_stop_where_validation_turns(rows):
    train, held = rows.filter("date < date'2021-01-01'"), rows.filter("date >= date'2021-01-01'")
    c = S.Candidate("c", "trees", (("depth", 3), ("least", 5)))
    got = S.fit(c, train, held, most_rounds=25)
    full = GBTRegressor(labelCol="target", maxDepth=3, minInstancesPerNode=5, stepSize=0.1, seed=42, maxIter=25).fit(train)
    errors = full.evaluateEachIteration(held, "squared")
    best, stop = 0, 25
    for k in range(1, 25):
        if errors[best] - errors[k] < 0:
            stop = best + 1
            break
        if errors[k] < errors[best]:
            best = k
    assert got.rounds == stop
    again = S.fit(c, train, rounds=got.rounds)
    assert again.model.getNumTrees == got.rounds
    with pytest.raises(ValueError):
        S.fit(c, train)


def test_ridge_penalty_grows_with_the_rows(rows, table):
    x, y = table[0][:, :3], table[1]
    for c in S.bank("ridge"):
        alpha = dict(c.params)["alpha"]
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * len(x) * np.eye(3), xc.T @ yc)
        m = S.fit(c, rows).model
        assert np.allclose(m.coefficients.toArray(), w, atol=1e-8) and np.isclose(m.intercept, y.mean() - x.mean(0) @ w)


def test_walk_forward(rows, tmp_path):
    fs = S.folds("2020-01-01", "2021-08-01", 4, 1)
    assert fs[0] == S.Fold("2021Q1", "2020-01-01", "2020-10-01", "2021-01-01", "2021-03-31")
    part = S.parts(rows, fs[0])
    span = lambda df: tuple(map(str, df.agg(F.min("date"), F.max("date")).first()))
    assert [span(part[k]) for k in ("fit", "validation", "refit", "predict")] == [("2020-01-01", "2020-08-01"), ("2020-10-01", "2020-11-01"), ("2020-01-01", "2020-11-01"), ("2021-01-01", "2021-03-01")]
    at = str(tmp_path / "p")
    predicted, told = S.walk_forward(rows, fs, S.bank("ridge"), at)
    assert predicted.count() == rows.filter("date >= date'2021-01-01'").count() and {r.quarter for r in predicted.select("quarter").distinct().collect()} == {f.quarter for f in fs}
    best = {r.quarter: r for r in told.filter("place = 1").collect()}
    for f in fs:
        r = best[f.quarter]
        c = next(c for c in S.bank("ridge") if c.name == r.candidate)
        expected = S.fit(c, S.parts(rows, f)["refit"]).model.transform(S.parts(rows, f)["predict"]).agg(F.sum("prediction")).first()[0]
        assert np.isclose(predicted.filter(F.col("quarter") == f.quarter).agg(F.sum("factor")).first()[0], expected)
    with pytest.raises(Exception, match="(?i)exist"):
        S.select_and_refit(rows, fs[0], S.bank("linear"), at)  # a quarter is written once


def test_a_quarter_without_a_candidate_has_no_predictions(rows, tmp_path):
    fs = S.folds("2020-01-01", "2021-08-01", 4, 1)[:1]
    against = rows.withColumn("label", -F.col("label"))
    predicted, told = S.walk_forward(against, fs, S.bank("linear"), str(tmp_path / "q"))
    assert predicted.count() == 0 and [(r.rejected_by, r.place) for r in told.collect()] == [("ic", None)]
    assert S.walk_forward(rows.limit(0), fs, S.bank("linear"), str(tmp_path / "r"))[1].count() == 0
