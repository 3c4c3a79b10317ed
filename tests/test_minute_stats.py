"""Statistics of minutes against numpy on a small table, and cases worked out by hand."""

import math

import numpy as np
import pytest

from quantloom.operators import minute_stats as M

A = [3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0]
B = [2.0, 2.0, 1.0, 5.0, 3.0, 4.0, 2.0]


@pytest.fixture(scope="module")
def minutes(spark):
    rows = [(1, "d", k, k, a, b) for k, (a, b) in enumerate(zip(A, B))] + [(2, "d", 0, 0, 7.0, 1.0), (3, "d", 0, 0, None, 1.0), (3, "d", 1, 1, 2.0, None)]
    return spark.createDataFrame(rows, "instrument int, date string, ts int, seq int, a double, b double")


def one(df, instrument=1):
    return df.filter(f"instrument = {instrument}").first()


def test_single(minutes):
    r, a = one(M.single(minutes)), np.array(A)
    d = a - a.mean()
    m2 = (d**2).mean()
    x0, x1 = a[:-1], a[1:]
    expected = {
        "mean": a.mean(), "std": a.std(ddof=1), "median": 2.0, "sum": 13.0, "max": 9.0, "min": -5.0, "range": 14.0, "first": 3.0, "last": 2.0, "momentum": -1 / 3, "ret": -1 / 3,
        "zscore": (2 - a.mean()) / a.std(ddof=1), "range_position": 0.5, "skew": (d**3).mean() / m2**1.5, "kurt": (d**4).mean() / m2**2 - 3,
        "autocorr": np.corrcoef(x0, x1)[0, 1], "zero_cross": 4 / 6,
    }
    for name, v in expected.items():
        assert math.isclose(r[name], v, rel_tol=1e-6), name
    bins = np.clip(((a + 5) / 14 * 9.99).astype(int), 0, 9)
    p = np.unique(bins, return_counts=True)[1] / 7
    assert math.isclose(r["entropy"], -(p * np.log(p)).sum(), rel_tol=1e-6)
    lone = one(M.single(minutes), 2)
    assert (lone["n"], lone["std"], lone["zscore"], lone["zero_cross"], lone["momentum"], lone["range_position"]) == (1, None, None, None, 0.0, None)


def test_pair(minutes):
    r, a, b = one(M.pair(minutes)), np.array(A), np.array(B)
    cov = ((a - a.mean()) * (b - b.mean())).mean()
    za, zb = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    slope = cov / b.var()
    ra, rb = np.argsort(np.argsort(a, kind="stable")), np.argsort(np.argsort(b, kind="stable"))
    expected = {
        "cov": cov, "corr": cov / (a.std() * b.std()), "slope": slope, "euc_dist": np.sqrt(((za - zb) ** 2).mean()), "cos_sim": (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()),
        "wmean": (a * b).sum() / b.sum(), "rank_corr": np.corrcoef(ra, rb)[0, 1], "residual_std": (a - slope * b).std(), "diff_std": a.std() - b.std(), "ratio_mean": a.mean() / b.mean(),
    }
    for name, v in expected.items():
        assert math.isclose(r[name], v, rel_tol=1e-6), name
    apart = one(M.pair(minutes), 3)  # never both: no pairs, but each has a mean
    assert (apart["n"], apart["corr"], apart["residual_std"], apart["diff_mean"]) == (0, None, None, 1.0)
    ahead = one(M.pair(minutes, -2))
    assert ahead["n"] == 5 and math.isclose(ahead["cov"], np.cov(a[:5], b[2:], ddof=0)[0, 1], rel_tol=1e-9)


def test_short_against_long(minutes):
    r, a = one(M.short_against_long(minutes, 3)), np.array(A)
    assert math.isclose(r["mean_ratio"], 2.0 / a.mean()) and math.isclose(r["zscore_anchor"], (2 - a.mean()) / a.std(ddof=1), rel_tol=1e-6)
    assert math.isclose(r["std_normalized_diff"], (2.0 - a.mean()) / a.std(ddof=1), rel_tol=1e-6)


def test_buckets_by_count(minutes):
    got = {(r.instrument, r.bucket): (r.level, r.key, r.gain) for r in M.sorted_buckets(minutes, 4).collect()}
    # seven rows: ranks 0 | 1 2 | 3 4 | 5 6 in order of b (1, 2, 2, 2, 3, 4, 5); one row: the last bucket
    assert got[1, 0] == (4.0, 1.0, 4.0) and got[1, 1] == (1.0, 2.0, 3.0) and got[1, 3] == (5.0, 4.5, 10.0) and got[2, 3] == (7.0, 1.0, 7.0)
    r = one(M.bucket_stats(M.sorted_buckets(minutes, 4), 4))
    levels = [4.0, 1.0, (2 - 5) / 2, 5.0]
    assert math.isclose(r["path_length"], 1.0 / (3 + 2.5 + 6.5), rel_tol=1e-6) and r["first_last_diff"] == 1.0
    assert math.isclose(r["early_late_diff"], np.mean(levels[2:]) - np.mean(levels[:2])) and math.isclose(r["slope"], np.polyfit(range(4), levels, 1)[0], rel_tol=1e-6)
    assert math.isclose(r["top_share"], 10 / 19, rel_tol=1e-6) and math.isclose(r["dispersion"], np.std(levels, ddof=1))
    lone = one(M.bucket_stats(M.sorted_buckets(minutes, 4), 4), 2)
    assert (lone["slope"], lone["path_length"], lone["first_last_diff"], lone["early_late_diff"]) == (None, None, None, None)


def test_buckets_by_volume(minutes):
    got = {r.bucket: r.level for r in M.clock_buckets(minutes, 4).filter("instrument = 1").collect()}
    # |b| reached: 2 4 5 10 13 17 19 of 19; the row that reaches a share belongs to it
    assert got == {0: 1.0, 1: 4.0, 2: -2.0, 3: 5.5}
