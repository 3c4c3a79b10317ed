"""Feature panels, targets, folds and models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.operators.cross_section import rank_to_unit
from quantloom.operators.evaluation import daily_ic
from quantloom.operators.portfolio import ledger


def build_panel(eligible: DataFrame, long: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Eligible keys with one column of scaled ranks per factor of a long table (factor, instrument, date, value)."""
    wide = long.groupBy("instrument", "date").agg(*[F.max(F.when(F.col("factor") == f, F.col("value"))).alias(f) for f in factors])
    j = eligible.select("instrument", "date").join(wide, ["instrument", "date"], "left")
    return j.select("instrument", "date", *[rank_to_unit(f).alias(f) for f in factors])


def ranked(panel: DataFrame, eligible, factors: Sequence[str]) -> DataFrame:
    """`build_panel` of a panel that has a column per factor and tells itself what is eligible: its eligible rows, other columns kept, the
    factors as scaled ranks among them; neither a long table nor a join."""
    kept = panel.filter(eligible)
    return kept.select(*[c for c in kept.columns if c not in factors], *[rank_to_unit(f).alias(f) for f in factors])


def admit(panel: DataFrame, factors: Sequence[str], coverage: float) -> list[str]:
    """Factors with enough values and more than one of them; one row reaches the driver."""
    row = panel.agg(*[F.avg(F.col(f).isNotNull().cast("int")).alias(f"c_{f}") for f in factors], *[F.count_distinct(f).alias(f"d_{f}") for f in factors]).first()
    return [f for f in factors if (row[f"c_{f}"] or 0) >= coverage and row[f"d_{f}"] > 1]


def features(panel: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Nulls as 0 with an indicator beside them; `present` where any factor has a value."""
    present = F.lit(False)
    for f in factors:
        present = present | F.col(f).isNotNull()
    cols = [F.coalesce(f, F.lit(0.0)).alias(f) for f in factors] + [F.col(f).isNull().cast("double").alias(f"missing_{f}") for f in factors]
    others = [c for c in panel.columns if c not in factors]
    return panel.select(*others, present.alias("present"), *cols)


def assemble(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[*factors, *(f"missing_{f}" for f in factors)], outputCol="features").transform(df)


def targets(panel: DataFrame, label: str, least: int, mode: str = "rank") -> DataFrame:
    """Targets on dates with enough labels: ranks, raw or excess over the date's mean."""
    day = Window.partitionBy("date")
    t = rank_to_unit(label) if mode == "rank" else F.col(label) if mode == "raw" else F.col(label) - F.avg(label).over(day)
    return panel.withColumn("target", F.when(F.count(label).over(day) >= least, t))


def partition_of(exit_date, train_end, validation_end):
    """fit, validation, refit or test by a row's exit date."""
    return F.when(exit_date <= train_end, "fit").when(exit_date <= validation_end, "validation").otherwise("test")


def quarter_folds(first: str, last: str, train_quarters: int) -> list[tuple[str, str, str]]:
    """(train start, test start, test end) of rolling quarterly folds."""
    import pandas as pd

    q = pd.period_range(first, last, freq="Q")
    return [(str(q[i - train_quarters].start_time.date()), str(q[i].start_time.date()), str(q[i].end_time.date())) for i in range(train_quarters, len(q))]


def candidates() -> dict:
    """The fixed grid of models."""
    return {
        "linear": LinearRegression(labelCol="target", regParam=0.0),
        "ridge": LinearRegression(labelCol="target", regParam=0.1),
        "trees": GBTRegressor(labelCol="target", maxIter=10, maxDepth=3, seed=1),
    }


#: Rows that thresholds of trees are taken from, as Spark's own trees do.
LOOKED_AT = 10_000


def thresholds(values: np.ndarray, bins: int = 32) -> list[float]:
    """The thresholds that Spark's trees try on these values: between all distinct ones, or at nearly equal counts where there are more."""
    at, n = np.unique(values, return_counts=True)
    splits = min(bins, len(values)) - 1
    if len(at) - 1 <= splits:
        return [float(x) for x in (at[:-1] + at[1:]) / 2]
    out, stride = [], len(values) / (splits + 1)
    now, target = n[0], stride
    for k in range(1, len(at)):
        before, now = now, now + n[k]
        if abs(before - target) < abs(now - target):
            out.append(float((at[k - 1] + at[k]) / 2))
            target += stride
    return out


def _bin(c: str, cuts: Sequence[float]):
    """How many of the sorted cuts are below the value, by halves."""

    def within(low: int, high: int):
        if low == high:
            return F.lit(float(low))
        mid = (low + high) // 2
        return F.when(F.col(c) <= F.lit(cuts[mid]), within(low, mid)).otherwise(within(mid + 1, high))

    return within(0, len(cuts))


def fit_trees(model: GBTRegressor, train: DataFrame, factors: Sequence[str]):
    """A boosted model, and what makes a table's features into those that it knows. Trees see of a row only the places of its values among the
    thresholds, and squared errors only the mean target of equal rows: so all rows are counted into cells of equal places once, and
    the trees are fitted on cells, weighted by their rows."""
    n = train.count()
    few = train if n <= LOOKED_AT else train.filter(F.pmod(F.xxhash64("instrument", "date"), F.lit(n)) < LOOKED_AT)
    seen = few.select(*factors).toPandas()  # about LOOKED_AT rows at most
    cuts = {f: thresholds(seen[f].to_numpy(), model.getMaxBins()) for f in factors}
    places = lambda df: assemble(df.drop("features").withColumns({f: _bin(f, cuts[f]) for f in factors}), factors)
    key = [*factors, *(f"missing_{f}" for f in factors)]
    cells = places(train).groupBy(*key).agg(F.avg("target").alias("target"), F.count("*").cast("double").alias("weight"))
    cells = assemble(cells, factors).select("features", "target", "weight").cache()
    try:
        return model.copy().setWeightCol("weight").fit(cells), places
    finally:
        cells.unpersist()


def walk_forward(data: DataFrame, folds: Sequence[tuple[str, str, str]], models: dict, factors: Sequence[str] | None = None) -> DataFrame:
    """Out-of-sample predictions of every model and fold: fit on labels that are known before the test quarter begins. Folds
    without training rows give no predictions. Where `factors` names what the features are made of, trees are fitted on cells."""
    out = data.sparkSession.createDataFrame([], "instrument long, date date, factor double, model_id string, quarter string")
    for start, test, end in folds:
        train = data.filter((F.col("date") >= start) & (F.add_months("date", 1) < test) & F.col("target").isNotNull())
        held = data.filter((F.col("date") >= test) & (F.col("date") <= end) & F.col("present"))
        if train.isEmpty():
            continue
        for name, model in models.items():
            fitted, places = fit_trees(model, train, factors) if factors and isinstance(model, GBTRegressor) else (model.fit(train), lambda df: df)
            p = fitted.transform(places(held)).select("instrument", "date", F.col("prediction").alias("factor"), F.lit(name).alias("model_id"), F.lit(test).alias("quarter"))
            out = out.unionByName(p)
    return out


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Of overlapping windows the latest prediction of a cell."""
    return predictions.groupBy("instrument", "date", "model_id").agg(F.max_by("factor", "quarter").alias("factor"))


def drop_correlated(panel: DataFrame, factors: Sequence[str], target: str, limit: float) -> list[str]:
    """Of each pair above the limit, the one that correlates less with the target goes; one row of pair sums reaches the driver."""
    pearson = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    complete = panel.dropna(subset=[*factors, target])
    row = complete.agg(*[pearson(a, b).alias(f"{a}|{b}") for i, a in enumerate(factors) for b in factors[i + 1 :]], *[F.abs(pearson(a, target)).alias(f"{a}|") for a in factors]).first()
    kept: list[str] = []
    for f in sorted(factors, key=lambda x: (-(row[f"{x}|"] or 0), x)):
        pair = lambda a, b: row[f"{a}|{b}"] if f"{a}|{b}" in row.asDict() else row[f"{b}|{a}"]
        if all(abs(pair(f, k) or 0) < limit for k in kept):
            kept.append(f)
    return kept


def sample_labels(df: DataFrame, holdout: tuple[str, str], out_from: str) -> DataFrame:
    """Each row's part: hold-out first, then in or out of sample by date."""
    part = F.when(F.col("date").between(*holdout), "holdout").when(F.col("date") >= out_from, "out").otherwise("in")
    return df.withColumn("part", part)


def permutation_importance(model, data: DataFrame, factors: Sequence[str], repeats: int = 3) -> DataFrame:
    """Rise of the mean squared error when one column is shuffled among rows (by a seeded order within its date)."""
    base = model.transform(assemble(data, factors)).agg(F.avg(F.pow(F.col("prediction") - F.col("target"), F.lit(2.0)))).first()[0]
    rows = []
    for f in factors:
        for k in range(repeats):
            w, r = Window.partitionBy("date").orderBy("instrument"), Window.partitionBy("date").orderBy(F.xxhash64(F.lit(k), F.lit(f), "instrument"), "instrument")
            d = data.withColumn("_i", F.row_number().over(w))
            s = data.select("date", F.col(f).alias("_s"), F.row_number().over(r).alias("_i"))
            mixed = d.join(s, ["date", "_i"]).withColumn(f, F.col("_s"))
            rows.append((f, k, model.transform(assemble(mixed, factors)).agg(F.avg(F.pow(F.col("prediction") - F.col("target"), F.lit(2.0)))).first()[0] - base))
    return data.sparkSession.createDataFrame(rows, "factor string, run int, rise double").groupBy("factor").agg(F.avg("rise").alias("importance"))


def score_validation(cells: DataFrame, returns: DataFrame, weights: DataFrame, fee: float, coverage: float, candidate: str) -> DataFrame:
    """One row for a candidate: its least coverage over the dates (share of cells that have a factor), mean rank IC, the net Sharpe
    ratio of its weights, which gate rejects it, and its score, the Sharpe ratio where none does."""
    by_date = cells.groupBy("date").agg((F.count("factor") / F.count("*")).alias("c"))
    covered = by_date.agg(F.min("c").alias("min_coverage"))
    ic = daily_ic(cells, "factor").agg(F.avg("rank_ic").alias("mean_rank_ic"))
    net = ledger(weights, returns, fee).agg(F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sharpe"))
    row = covered.crossJoin(ic).crossJoin(net)  # one row each
    reason = F.when(F.col("min_coverage") < coverage, "coverage").when(~(F.col("mean_rank_ic") > 0), "ic").otherwise("none")
    row = row.withColumn("rejected_by", reason)
    return row.select(F.lit(candidate).alias("candidate"), "min_coverage", "mean_rank_ic", "sharpe", "rejected_by", F.when(F.col("rejected_by") == "none", F.col("sharpe")).alias("score"))
