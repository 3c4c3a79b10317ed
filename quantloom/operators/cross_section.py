"""Cross-section operators: one date is one group. Ranks, clipping, standardising, regression, groups and weights.

Regressions never gather a date's rows: sums of products per date make small normal equations, which are solved one row a
date and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import EPS, clip, col, finite, normal_quantile, safe_div

MAD_SCALE = 1.4826


def by_date():
    return Window.partitionBy("date")


def average_rank(x) -> Column:
    """Average rank from 1 among the date's values; null stays null."""
    x = col(x)
    below = F.rank().over(by_date().orderBy(F.asc_nulls_last(x)))
    same = F.count("*").over(Window.partitionBy("date", x))
    return F.when(x.isNotNull(), below + (same - 1) / 2)


def count(x) -> Column:
    return F.count(col(x)).over(by_date())


def cs_rank(x) -> Column:
    return average_rank(x) / count(x)


def rank_to_unit(x) -> Column:
    """Ranks spread evenly over -1 to 1; a lone value is 0."""
    return F.when(count(x) > 1, 2 * (average_rank(x) - 1) / (count(x) - 1) - 1).otherwise(F.when(col(x).isNotNull(), 0.0))


def winsorize_mad(df: DataFrame, x: str, n: float = 3.0, out: str = "value") -> DataFrame:
    """Clip to n scaled median absolute deviations around the date's median; dates without spread stay."""
    df = df.withColumn("_m", F.percentile(x, F.lit(0.5)).over(by_date()))
    df = df.withColumn("_d", F.percentile(F.abs(F.col(x) - F.col("_m")), F.lit(0.5)).over(by_date()))
    width = n * MAD_SCALE * F.col("_d")
    bounded = F.greatest(F.least(F.col(x), F.col("_m") + width), F.col("_m") - width)
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.when(F.col("_d") >= EPS, bounded).otherwise(F.col(x)))).drop("_m", "_d")


def mad_rank(df: DataFrame, x: str, n: float = 3.0, eligible: str | None = None, out: str = "value") -> DataFrame:
    """Mask, clip by MAD, then ranks from -1 to 1."""
    df = df.withColumn("_x", F.when(F.col(eligible), F.col(x)) if eligible else F.col(x))
    return winsorize_mad(df, "_x", n, "_clipped").withColumn(out, rank_to_unit("_clipped")).drop("_x", "_clipped")


def zscore(x, ddof: int = 0) -> Column:
    sd = (F.stddev_samp if ddof else F.stddev_pop)(col(x)).over(by_date())
    return F.when(count(x) > 1, safe_div(col(x) - F.avg(col(x)).over(by_date()), sd))


def winsor_zscore(df: DataFrame, x: str, q: float = 0.05, out: str = "value") -> DataFrame:
    """Clip at the q and 1 - q quantiles (interpolated), then z-score."""
    low, high = (F.percentile(x, F.lit(p)).over(by_date()) for p in (q, 1 - q))
    df = df.withColumn("_lo", low).withColumn("_hi", high)
    df = df.withColumn("_c", F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.col("_hi")), F.col("_lo"))))
    return df.withColumn(out, zscore("_c")).drop("_lo", "_hi", "_c")


def robust_zscore(df: DataFrame, x: str, out: str = "value") -> DataFrame:
    """(x - median) / MAD; 0 on dates without spread."""
    df = df.withColumn("_m", F.percentile(x, F.lit(0.5)).over(by_date()))
    df = df.withColumn("_d", F.percentile(F.abs(F.col(x) - F.col("_m")), F.lit(0.5)).over(by_date()))
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.when(F.col("_d") > 1e-8, (F.col(x) - F.col("_m")) / F.col("_d")).otherwise(0.0))).drop("_m", "_d")


def rank_gaussian(x) -> Column:
    return normal_quantile(clip(cs_rank(x), 0.01, 0.99))


def dispersion_power(x, p: float = 1.5) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(p))


def tail_rank(x, share: float = 0.2) -> Column:
    """Centred ranks; those in the middle are 0."""
    r = cs_rank(x)
    return F.when((r <= share) | (r > 1 - share), r - 0.5).otherwise(F.when(r.isNotNull(), 0.0))


def sector_demean(x, sector: str = "sector") -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy("date", sector))


def neutralize(y, x, least: int = 3) -> Column:
    """Residual of y on x within a date."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    w = by_date()
    beta = safe_div(F.covar_pop(a, b).over(w), F.var_pop(a).over(w))
    return F.when(F.count(b).over(w) >= least, b - (F.avg(b).over(w) + F.coalesce(beta, F.lit(0.0)) * (a - F.avg(a).over(w))))


def normalize(df: DataFrame, x: str, direction: int = 1, q: float = 0.025, out: str = "value") -> DataFrame:
    """direction * x, clipped at lower-interpolated quantiles, as centred ranks, as z-scores (0 where all are equal). The
    quantiles are the values at two places of the date's order."""
    df = df.withColumn("_v", direction * F.col(x))
    df = df.withColumn("_i", F.row_number().over(by_date().orderBy(F.asc_nulls_last("_v")))).withColumn("_n", F.count("_v").over(by_date()))
    at = lambda p: F.max(F.when(F.col("_i") == F.floor(F.lit(p) * (F.col("_n") - 1)) + 1, F.col("_v"))).over(by_date())
    df = df.withColumn("_v", F.when(F.col("_v").isNotNull(), F.greatest(F.least(F.col("_v"), at(1 - q)), at(q)))).drop("_i", "_n")
    df = df.withColumn("_v", cs_rank("_v") - 0.5)
    sd = F.stddev_pop("_v").over(by_date())
    return df.withColumn(out, F.when(F.col("_v").isNotNull(), F.when(sd > EPS, (F.col("_v") - F.avg("_v").over(by_date())) / sd).otherwise(0.0))).drop("_v")


def composite(df: DataFrame, weights: dict[str, float], out: str = "value") -> DataFrame:
    """Weighted sum of z-scores where every factor has a value; a factor without spread counts as 0."""
    total, seen = F.lit(0.0), F.lit(True)
    for x, w in weights.items():
        z = F.when(F.stddev_pop(x).over(by_date()) > EPS, zscore(x)).otherwise(0.0)
        total, seen = total + w * z, seen & F.col(x).isNotNull()
    return df.withColumn(out, F.when(seen, total))


def _solved(sums: DataFrame, k: int, ridge: float) -> DataFrame:
    """date, b0..bk from the sums of products of k regressors with intercept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                m = np.zeros((k + 1, k + 1))
                v = np.zeros(k + 1)
                for i in range(k + 1):
                    v[i] = r[f"v{i}"]
                    for j in range(i, k + 1):
                        m[i, j] = m[j, i] = r[f"m{i}_{j}"]
                m[1:, 1:] += ridge * np.eye(k)
                good = m[0, 0] >= k + 2 and np.linalg.matrix_rank(m) == k + 1
                rows.append([r["date"], *(np.linalg.solve(m, v) if good else np.full(k + 1, np.nan))])
            yield pd.DataFrame(rows, columns=["date", *(f"b{i}" for i in range(k + 1))])

    return sums.mapInPandas(run, "date date, " + ", ".join(f"b{i} double" for i in range(k + 1)))


def regress(df: DataFrame, y: str, xs: Sequence[str], ridge: float = 0.0, out: str = "value") -> DataFrame:
    """Residual of y on all xs within each date, with intercept; null where too few rows or dependent regressors. Regressors
    are centred before their products are summed."""
    k = len(xs)
    have = F.col(y).isNotNull()
    for x in xs:
        have = have & F.col(x).isNotNull()
    used = df.withColumn("_ok", have)
    centred = {x: F.col(x) - F.avg(F.when(F.col("_ok"), F.col(x))).over(by_date()) for x in xs}
    used = used.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(centred.values(), 1)])
    terms = [F.lit(1.0), *[F.col(f"_c{i}") for i in range(1, k + 1)]]
    sums = used.filter("_ok").groupBy("date").agg(
        *[F.sum(terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)], *[F.sum(terms[i] * F.col(y)).alias(f"v{i}") for i in range(k + 1)]
    )
    fit = F.col("b0")
    for i in range(1, k + 1):
        fit = fit + F.col(f"b{i}") * F.col(f"_c{i}")
    joined = used.join(_solved(sums, k, ridge), "date", "left")
    return joined.withColumn(out, F.when(F.col("_ok"), finite(F.col(y) - fit))).drop("_ok", *[f"_c{i}" for i in range(1, k + 1)], *[f"b{i}" for i in range(k + 1)])


def orthogonalize(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Symmetric orthogonalisation per date: X (X'X)^-1/2 over rows with all values, as columns orth_<x>; dates with fewer than
    k + 1 such rows keep their values."""
    k = len(xs)
    have = F.lit(True)
    for x in xs:
        have = have & F.col(x).isNotNull()
    sums = df.filter(have).groupBy("date").agg(F.count("*").alias("n"), *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                values, vectors = np.linalg.eigh(m)
                root = vectors @ np.diag(np.maximum(values, 1e-12) ** -0.5) @ vectors.T if r["n"] > k else np.eye(k)
                rows.append([r["date"], root.ravel().tolist()])
            yield pd.DataFrame(rows, columns=["date", "_root"])

    joined = df.withColumn("_ok", have).join(sums.mapInPandas(run, "date date, _root array<double>"), "date", "left")
    for j, x in enumerate(xs):
        mixed = F.lit(0.0)
        for i, z in enumerate(xs):
            mixed = mixed + F.col(z) * F.col("_root")[i * k + j]
        joined = joined.withColumn(f"orth_{x}", F.when(F.col("_ok"), mixed))
    return joined.drop("_ok", "_root")


def assign_groups(df: DataFrame, x: str, groups: int = 5, out: str = "value") -> DataFrame:
    """Groups 1 to n of nearly equal counts by (value, instrument); null on dates with fewer values than groups."""
    place = F.row_number().over(by_date().orderBy(F.asc_nulls_last(x), "instrument")) - 1
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (count(x) >= groups), F.floor(place * groups / count(x)) + 1))


def fractional_weights(df: DataFrame, x: str, groups: int = 5) -> DataFrame:
    """date, instrument, grp, weight: tied values share the slots of their block, so a block may lie in several groups."""
    slots = assign_groups(df.filter(F.col(x).isNotNull()), x, groups, "grp").filter("grp is not null")
    blocks = slots.groupBy("date", x, "grp").agg(F.count("*").alias("in_block"))
    of = Window.partitionBy("date", "grp")
    block = Window.partitionBy("date", x)
    share = blocks.select("date", x, "grp", (F.col("in_block") / F.sum("in_block").over(of) / F.sum("in_block").over(block)).alias("weight"))
    return slots.select("date", "instrument", x).join(share, ["date", x]).select("date", "instrument", "grp", "weight")


def target_weights(df: DataFrame, group: str, mode: str = "long_short", groups: int = 5, direction: int = 1, out: str = "value") -> DataFrame:
    """Equal weights: long the best group (long_only), or half long the best and half short the worst (long_short)."""
    best, worst = (groups, 1) if direction > 0 else (1, groups)
    n = lambda g: F.count(F.when(F.col(group) == g, 1)).over(by_date())
    size = 0.5 if mode == "long_short" else 1.0
    w = F.when(F.col(group) == best, size / n(best))
    if mode == "long_short":
        w = w.when(F.col(group) == worst, -size / n(worst))
    return df.withColumn(out, F.when(F.col(group).isNotNull(), w.otherwise(0.0)))
