"""Choosing features and models: principal components, importance and its stability over folds, candidates with early stopping,
and a walk forward that selects, refits and predicts quarter by quarter into one partitioned table.

Sums over rows are Spark jobs; what comes to the driver is a row per pair of features, per feature and fold, or per candidate. The
number of features is at most MOST_FEATURES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.ml.panel import assemble, permutation_importance
from quantloom.operators.evaluation import candidate_order, daily_ic

MOST_FEATURES = 2000


# moments and components


@dataclass(frozen=True)
class Moments:
    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def correlation(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(self.cov / np.outer(sd, sd))


def moments(panel: DataFrame, names: Sequence[str]) -> Moments:
    """Count, means and covariances over the rows that have all of them: one scan for the means, one for the products around them,
    a matrix per task, added up cell by cell."""
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    rows = panel.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    first = rows.agg(F.count("*"), *[F.avg(c) for c in names]).first()
    n, d = first[0], len(names)
    if n < 2:
        raise ValueError("covariances need two complete rows")
    mean = np.array(first[1:], float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = np.column_stack([c.to_numpy() for c in b.columns]) - mean
            total += x.T @ x
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array(total[i, j])], names=["cell", "part"])

    cells = rows.mapInArrow(products, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("v"))
    cov = np.zeros((d, d))
    for r in cells.collect():  # a row per pair of features
        i, j = divmod(r["cell"], d)
        cov[i, j] = cov[j, i] = r["v"] / (n - 1)
    return Moments(tuple(names), n, mean, cov)


@dataclass(frozen=True)
class Components:
    names: tuple[str, ...]
    mean: np.ndarray
    vectors: np.ndarray  # a column per component
    shares: np.ndarray  # of the whole variance, of the components kept

    def project(self, panel: DataFrame) -> DataFrame:
        """The panel with pc1, pc2, ...; null where a feature is. The features are left out."""
        out = []
        for k in range(self.vectors.shape[1]):
            score = sum((F.col(c) - float(m)) * float(v) for c, m, v in zip(self.names, self.mean, self.vectors[:, k]))
            out.append(score.alias(f"pc{k + 1}"))
        return panel.select(*[c for c in panel.columns if c not in self.names], *out)

    def loadings(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, c, float(v), float(s)) for k, s in enumerate(self.shares) for c, v in zip(self.names, self.vectors[:, k])]
        return spark.createDataFrame(rows, "component int, feature string, loading double, share double")


def components(m: Moments, share: float = 0.95, most: int | None = None) -> Components:
    """The fewest components that explain a share of the variance, or `most` where given. Each one's largest loading, the first
    of equals, is positive."""
    values, vectors = np.linalg.eigh(m.cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    part = values / values.sum() if values.sum() > 0 else np.full(len(values), 1 / len(values))
    k = most or min(int(np.argmax(np.cumsum(part) >= share - 1e-12)) + 1, len(part))
    lead = np.argmax(np.round(np.abs(vectors), 9), axis=0)
    vectors = vectors * np.where(vectors[lead, range(len(part))] < 0, -1.0, 1.0)
    return Components(m.names, m.mean, vectors[:, :k], part[:k])


def uncorrelated(panel: DataFrame, names: Sequence[str], target: str | None = None, limit: float = 0.95) -> list[str]:
    """Features in their order, without one of each pair above the limit: the one less correlated with the target goes, or without a
    target the one of smaller variance; of equals the later."""
    m = moments(panel, [*names, *([target] if target else [])])
    c, d = m.correlation(), len(names)
    worth = np.abs(c[:d, d]) if target else np.diag(m.cov)[:d]
    gone: set[int] = set()
    for i in range(d):
        for j in range(i + 1, d):
            if i not in gone and j not in gone and abs(c[i, j]) > limit:
                gone.add(j if worth[i] >= worth[j] else i)
    return [f for k, f in enumerate(names) if k not in gone]


def orthogonalize(panel: DataFrame, names: Sequence[str], target: str | None = None, limit: float = 0.95, share: float | None = None) -> tuple[DataFrame, list[str]]:
    """The panel without redundant features, and the features that are left; as components where `share` is given."""
    kept = uncorrelated(panel, names, target, limit)
    if share is None:
        return panel.drop(*[f for f in names if f not in kept]), kept
    c = components(moments(panel, kept), share)
    return c.project(panel.drop(*[f for f in names if f not in kept])), [f"pc{k + 1}" for k in range(len(c.shares))]


# importance


def split_importance(model: Model, names: Sequence[str]) -> dict[str, float]:
    """Split gains of a boosted model per feature; a feature's missing indicator counts with it."""
    gains = model.featureImportances.toArray()
    d = len(names)
    return {f: float(gains[k] + (gains[d + k] if len(gains) > d else 0.0)) for k, f in enumerate(names)}


@dataclass(frozen=True)
class Importance:
    split: dict[str, float]
    permuted: dict[str, float]
    combined: dict[str, float]
    kept: list[str]


def combine(split: dict[str, float], permuted: dict[str, float], most: int, percentile: float = 30.0) -> tuple[dict[str, float], list[str]]:
    """0.7 of the split gains, scaled to 1 at most, and 0.3 of the permutation importance; kept are those from the percentile of the
    positive ones on, at most `most`, in the features' order."""
    top = max(split.values(), default=0.0)
    score = {f: 0.7 * (v / top if top > 0 else v) + 0.3 * permuted[f] for f, v in split.items()}
    positive = [v for v in score.values() if v > 0]
    bar = float(np.percentile(positive, percentile)) if positive else 0.0
    kept = [f for f in score if score[f] >= bar]
    best = set(sorted(kept, key=lambda f: -score[f])[:most])
    return score, [f for f in kept if f in best]


def boosted(rounds: int = 20, depth: int = 4, step: float = 0.05, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def importance(train: DataFrame, held: DataFrame, names: Sequence[str], limit: float = 0.9, most: int = 40, repeats: int = 3, model: GBTRegressor | None = None) -> Importance:
    """Importance of the uncorrelated features: split gains on `train`, permutation on `held`. Both are feature panels (with missing
    indicators) with a target."""
    kept = uncorrelated(train, names, "target", limit)
    fitted = (model or boosted()).fit(assemble(train, kept))
    split = split_importance(fitted, kept)
    rises = permutation_importance(fitted, held, kept, repeats)
    permuted = {r["factor"]: r["importance"] for r in rises.collect()}  # a row per feature
    combined, chosen = combine(split, permuted, most)
    return Importance(split, permuted, combined, chosen)


def date_windows(dates: Sequence, size: int, step: int) -> list[tuple]:
    """(first, last) of windows of `size` dates, `step` apart; all dates where there are fewer."""
    starts = range(0, len(dates) - size + 1, step) if len(dates) >= size else [0]
    return [(dates[k], dates[min(k + size, len(dates)) - 1]) for k in starts]


def expanding_windows(dates: Sequence, splits: int) -> list[tuple]:
    """(first, last) of the training dates of a time-series split: the tests are equal blocks at the end, each after all its training
    dates."""
    test = len(dates) // (splits + 1)
    if not test:
        raise ValueError("more splits than dates")
    first = len(dates) - splits * test
    return [(dates[0], dates[first + k * test - 1]) for k in range(splits)]


def stability(train: DataFrame, held: DataFrame, names: Sequence[str], windows: Sequence[tuple], **how) -> dict[str, float]:
    """In which share of the windows of dates a feature is chosen by `importance`."""
    chosen = dict.fromkeys(names, 0)
    for first, last in windows:  # few; each is a job over its rows
        for f in importance(train.filter(F.col("date").between(F.lit(first), F.lit(last))), held, names, **how).kept:
            chosen[f] += 1
    return {f: n / len(windows) for f, n in chosen.items()}


def robust(train: DataFrame, names: Sequence[str], rolling: dict[str, float], crossed: dict[str, float], least: tuple[float, float] = (0.7, 0.8), limit: float = 0.9) -> list[str]:
    """Features stable over rolling windows and over splits; where none is both, those that are either; then uncorrelated."""
    sets = [s for s in ({f for f in names if shares[f] >= bar} for shares, bar in zip((rolling, crossed), least)) if s]
    if not sets:
        return []
    both = set.intersection(*sets) or set.union(*sets)
    return uncorrelated(train, [f for f in names if f in both], "target", limit)


# candidates


@dataclass(frozen=True)
class Candidate:
    name: str
    kind: str  # linear, ridge or trees
    params: tuple[tuple[str, float], ...] = ()


#: Penalties of the ridge grid, per row; depths and least rows of a leaf of the trees.
ALPHAS, DEPTHS, LEAST_ROWS = (0.0001, 0.001, 0.01, 0.1, 1.0), (2, 3, 4), (50, 100)


def bank(kind: str) -> list[Candidate]:
    """The fixed grid of a kind of model, in order."""
    if kind == "linear":
        return [Candidate("c000", kind)]
    if kind == "ridge":
        return [Candidate(f"c{k:03d}", kind, (("alpha", a),)) for k, a in enumerate(ALPHAS)]
    if kind == "trees":
        grid = [(d, n) for d in DEPTHS for n in LEAST_ROWS]
        return [Candidate(f"c{k:03d}", kind, (("depth", d), ("least", n))) for k, (d, n) in enumerate(grid)]
    raise ValueError(f"no candidates of kind {kind}")


@dataclass(frozen=True)
class Fitted:
    candidate: Candidate
    model: Model
    rounds: int | None


def fit(c: Candidate, train: DataFrame, validation: DataFrame | None = None, rounds: int | None = None, most_rounds: int = 100, tolerance: float = 0.0) -> Fitted:
    """A candidate fitted on assembled rows (features, target). A ridge's penalty grows with the rows, alpha each, on features as
    they are. Trees are added until one no longer lowers the error on `validation` (by more than the tolerance); with `rounds` given
    there is no validation, but that many trees."""
    p = dict(c.params)
    if c.kind in ("linear", "ridge"):
        # the library takes the penalty against a target of unit spread
        spread = (train.agg(F.stddev_pop("target")).first()[0] or 0.0) if "alpha" in p else 0.0
        m = LinearRegression(labelCol="target", regParam=float(p.get("alpha", 0.0)) * spread, elasticNetParam=0.0, standardization=False, solver="normal")
        return Fitted(c, m.fit(train), None)
    if rounds is None and validation is None:
        raise ValueError("trees need validation rows or a number of rounds")
    gbt = GBTRegressor(labelCol="target", maxDepth=int(p["depth"]), minInstancesPerNode=int(p["least"]), stepSize=0.1, seed=42, maxIter=rounds or most_rounds, validationTol=tolerance)
    if rounds is not None:
        return Fitted(c, gbt.fit(train), rounds)
    marked = train.select("features", "target", F.lit(False).alias("held")).unionByName(validation.select("features", "target", F.lit(True).alias("held")))
    m = gbt.setValidationIndicatorCol("held").fit(marked)
    return Fitted(c, m, m.getNumTrees)


# walk forward


@dataclass(frozen=True)
class Fold:
    """A quarter's dates: training from history, validation, then prediction from retrain to end."""

    quarter: str
    history: str
    validation: str
    retrain: str
    end: str


def folds(first: str, last: str, train_quarters: int = 8, validation_quarters: int = 2) -> list[Fold]:
    q = pd.period_range(first, last, freq="Q")
    day = lambda p: str(p.start_time.date())
    return [Fold(str(q[i]), day(q[i - train_quarters]), day(q[i - validation_quarters]), day(q[i]), str(q[i].end_time.date())) for i in range(train_quarters, len(q))]


def parts(data: DataFrame, f: Fold) -> dict[str, DataFrame]:
    """Rows to fit on (known before validation begins), to validate on and to refit on (known before the quarter), and to predict.
    `exit_date` is the day on which a row's target is known."""
    known = F.col("target").isNotNull() & (F.col("date") >= f.history)
    return {
        "fit": data.filter(known & (F.col("exit_date") < f.validation)),
        "validation": data.filter(known & (F.col("date") >= f.validation) & (F.col("exit_date") < f.retrain)),
        "refit": data.filter(known & (F.col("exit_date") < f.retrain)),
        "predict": data.filter((F.col("date") >= f.retrain) & (F.col("date") <= f.end) & F.col("present")),
    }


def validate(predicted: DataFrame, coverage: float = 0.0) -> DataFrame:
    """Per candidate (a row for every validation cell, factor null where it gives none): the least share of a date's cells that
    have a value, the mean rank IC (to nine places), and which gate rejects it."""
    share = predicted.groupBy("candidate", "date").agg((F.count("factor") / F.count("*")).alias("c"))
    least = share.groupBy("candidate").agg(F.min("c").alias("min_coverage"))
    ic = daily_ic(predicted.withColumn("x", F.round("factor", 9)), "x", by=["candidate"]).groupBy("candidate").agg(F.round(F.avg("rank_ic"), 9).alias("mean_rank_ic"))
    reason = F.when(F.col("min_coverage") < coverage, "coverage").when(~F.coalesce(F.col("mean_rank_ic") > 0, F.lit(False)), "ic").otherwise("none")
    return least.join(ic, "candidate", "left").withColumn("rejected_by", reason)


Scorer = Callable[[DataFrame], DataFrame]


def select_and_refit(data: DataFrame, f: Fold, candidates: Sequence[Candidate], path: str, score: Scorer = validate, weights: dict[str, float] | None = None) -> list[tuple]:
    """Fit every candidate, score all on the validation rows in one job, refit the best of those that no gate rejects, and write the
    quarter's predictions (instrument, date, factor, model_id) as a partition that is never written again. Returns a row
    (quarter, candidate, rounds, min_coverage, mean_rank_ic, rejected_by, place) per candidate; a quarter in which all are
    rejected, or without rows to fit, has no predictions."""
    part = parts(data, f)
    if part["fit"].isEmpty() or part["validation"].isEmpty():
        return []
    fitted = {c.name: fit(c, part["fit"], part["validation"]) for c in candidates}
    cells = part["validation"]
    predicted = None
    for name, m in fitted.items():
        p = m.model.transform(cells).select(F.lit(name).alias("candidate"), "instrument", "date", "label", F.col("prediction").alias("factor"))
        predicted = p if predicted is None else predicted.unionByName(p)
    told = score(predicted).cache()
    order = candidate_order(told.filter("rejected_by = 'none'"), weights or {"mean_rank_ic": 1.0}, "candidate").select("candidate", "place")
    rows = told.join(order, "candidate", "left").collect()  # a row per candidate
    told.unpersist()
    best = [r for r in rows if r["place"] == 1]
    if best:
        m = fitted[best[0]["candidate"]]
        final = fit(m.candidate, part["refit"], rounds=m.rounds)
        out = final.model.transform(part["predict"]).select("instrument", "date", F.col("prediction").alias("factor"), F.lit(f"{m.candidate.kind}_{f.quarter}_{m.candidate.name}").alias("model_id"))
        out.write.mode("errorifexists").parquet(f"{path}/quarter={f.quarter}")
    return [(f.quarter, r["candidate"], fitted[r["candidate"]].rounds, r["min_coverage"], r["mean_rank_ic"], r["rejected_by"], r["place"]) for r in rows]


TOLD = "quarter string, candidate string, rounds int, min_coverage double, mean_rank_ic double, rejected_by string, place int"


def walk_forward(data: DataFrame, fs: Sequence[Fold], candidates: Sequence[Candidate], path: str, **how) -> tuple[DataFrame, DataFrame]:
    """Predictions of all quarters, read from the one table that they were written to, and the table of candidates."""
    spark = data.sparkSession
    told = [r for f in fs for r in select_and_refit(data, f, candidates, path, **how)]
    table = spark.createDataFrame(told, TOLD)
    shape = f"instrument {data.schema['instrument'].dataType.simpleString()}, date date, factor double, model_id string, quarter string"
    if not any(r[-1] == 1 for r in told):
        return spark.createDataFrame([], shape), table
    return spark.read.schema(shape).parquet(path), table
