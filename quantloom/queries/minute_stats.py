"""Statistics of minutes per period, and their SQL, written from the definitions: sums, counts and central moments by name."""

from __future__ import annotations

from quantloom.operators import minute_stats as M
from quantloom.queries.common import add, r
from quantloom.queries.intraday import MIN, minutes

K = "instrument, date"
P = f"PARTITION BY {K}"
EPS = "1e-8"
TIME = f"({P} ORDER BY ts, seq)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > {EPS} THEN ({a})::DOUBLE / ({b}) END)"


def when(test: str, e: str) -> str:
    return f"(CASE WHEN {test} THEN {e} END)"


def columns(**e: str) -> str:
    return ",\n    ".join(r(x, name) for name, x in e.items())


_LAST, _FIRST = "arg_max(a, (ts, seq))", "arg_min(a, (ts, seq))"
_MOVED = div(f"{_LAST} - {_FIRST}", f"abs({_FIRST}) + {EPS}")
_SINGLE = columns(
    mean="avg(a)",
    std="stddev_samp(a)",
    median="median(a)",
    sum="sum(a)",
    max="max(a)",
    min="min(a)",
    range="max(a) - min(a)",
    first=_FIRST,
    last=_LAST,
    zscore=div(f"{_LAST} - avg(a)", f"stddev_samp(a) + {EPS}"),
    momentum=_MOVED,
    ret=_MOVED,
    range_position=div(f"{_LAST} - min(a)", f"max(a) - min(a) + {EPS}"),
    skew=when("count(a) >= 3", f"avg(dev * dev * dev) / (pow(sqrt(avg(dev * dev) + {EPS}), 3) + {EPS})"),
    kurt=when("count(a) >= 4", f"avg(dev * dev * dev * dev) / (pow(avg(dev * dev), 2) + {EPS}) - 3"),
    autocorr=when("count(prev) >= 5", f"covar_pop(prev, cur) / (sqrt(var_pop(prev) + {EPS}) * sqrt(var_pop(cur) + {EPS}) + {EPS})"),
    entropy="any_value(entropy)",
    zero_cross=div("count(*) FILTER (WHERE sign(prev) <> sign(cur))", "count(prev)"),
)
add(
    "m04_single_variable_statistics",
    lambda s, d: M.single(minutes(s, d)),
    f"""WITH {MIN}, q AS (SELECT *, lag(a) OVER {TIME} AS prev, CASE WHEN lag(a) OVER {TIME} IS NOT NULL THEN a END AS cur, a - avg(a) OVER ({P}) AS dev,
      least(greatest(floor((a - min(a) OVER ({P})) / (max(a) OVER ({P}) - min(a) OVER ({P}) + {EPS}) * 9.99), 0), 9) AS bin FROM m),
    c AS (SELECT {K}, bin, count(*) AS k FROM q GROUP BY ALL), s AS (SELECT *, k / sum(k) OVER ({P}) AS p FROM c), h AS (SELECT {K}, -sum(p * ln(p + {EPS})) AS entropy FROM s GROUP BY ALL)
    SELECT {K}, count(a) AS n, {_SINGLE} FROM q JOIN h USING ({K}) GROUP BY ALL""",
)

_CORR = "covar_pop({0}, {1}) / (sqrt(var_pop({0}) * var_pop({1})) + 1e-8)"
_CLIPPED = "greatest(least({0}, 1), {1})"
_SLOPE = f"(covar_pop(x, y) / (var_pop(y) + {EPS}))"
_PAIR = columns(
    corr=when("count(x) >= 5", _CLIPPED.format(_CORR.format("x", "y"), -1)),
    slope=when("count(x) >= 5", _SLOPE),
    intercept=when("count(x) >= 5", f"avg(x) - {_SLOPE} * avg(y)"),
    r2=when("count(x) >= 5", _CLIPPED.format(f"pow({_CORR.format('x', 'y')}, 2)", 0)),
    euc_dist=when("count(x) >= 5", "sqrt(sum((zx - zy) * (zx - zy)) / count(x))"),
    cov=when("count(x) >= 5", "avg(x * y) - avg(x) * avg(y)"),
    cos_sim=div("sum(x * y)", f"sqrt(sum(x * x) + {EPS}) * sqrt(sum(y * y) + {EPS})"),
    wmean=div("sum(x * greatest(y, 0))", "sum(greatest(y, 0))"),
    rank_corr=when("count(x) >= 5", _CLIPPED.format(_CORR.format("rx", "ry"), -1)),
    beta=when("count(x) >= 5", _SLOPE),
    residual_std="stddev_pop(x - slope * y)",
    diff_mean="avg(a) - avg(b)",
    diff_std="stddev_pop(a) - stddev_pop(b)",
    ratio_mean=div("avg(a)", "avg(b)"),
    ratio_std=div("stddev_pop(a)", "stddev_pop(b)"),
)
for _name, _shift, _b in (("m05_pair_statistics", 0, "b"), ("m05_pair_statistics_shifted", 2, f"lag(b, 2) OVER {TIME}"), ("m05_pair_statistics_ahead", -3, f"lead(b, 3) OVER {TIME}")):
    add(
        _name,
        lambda s, d, k=_shift: M.pair(minutes(s, d), k),
        f"""WITH {MIN}, v AS (SELECT {K}, ts, seq, a, {_b} AS b FROM m), u AS (SELECT *, CASE WHEN b IS NOT NULL THEN a END AS x, CASE WHEN a IS NOT NULL THEN b END AS y FROM v),
        k AS (SELECT *, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + {EPS}) AS zx, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + {EPS}) AS zy,
              CASE WHEN x IS NOT NULL THEN row_number() OVER ({P} ORDER BY x NULLS LAST, ts, seq) END AS rx, CASE WHEN x IS NOT NULL THEN row_number() OVER ({P} ORDER BY y NULLS LAST, ts, seq) END AS ry,
              covar_pop(x, y) OVER w / (var_pop(y) OVER w + {EPS}) AS slope FROM u WINDOW w AS ({P}))
        SELECT {K}, count(x) AS n, {_PAIR} FROM k GROUP BY ALL""",
    )

_SHORT = columns(
    mean_ratio=div("avg(s)", "avg(a)"),
    std_ratio=div("stddev_samp(s)", "stddev_samp(a)"),
    mean_diff="avg(s) - avg(a)",
    zscore_anchor=div(f"{_LAST} - avg(a)", f"stddev_samp(a) + {EPS}"),
    std_normalized_diff=div("avg(s) - avg(a)", f"stddev_samp(a) + {EPS}"),
)
add(
    "m06_short_against_long",
    lambda s, d: M.short_against_long(minutes(s, d), 3),
    f"WITH {MIN}, l AS (SELECT *, CASE WHEN row_number() OVER ({P} ORDER BY ts DESC, seq DESC) <= 3 THEN a END AS s FROM m) SELECT {K}, {_SHORT} FROM l GROUP BY ALL",
)

G = 4


def _bucket_sql(bucket: str, names: list[str]) -> str:
    """Bucket means as a table of all G buckets, empty ones null, and the statistics over them."""
    path = "sum(abs(level - before))"
    all_ = {
        "slope": when("count(level) >= 2", f"sum((level - mu) * (bucket - mb)) / (sum((bucket - mb) * (bucket - mb)) + {EPS})"),
        "dispersion": when("count(level) >= 2", "stddev_samp(level)"),
        "early_late_diff": f"avg(level) FILTER (WHERE bucket >= {G // 2}) - avg(level) FILTER (WHERE bucket < {G // 2})",
        "top_share": when(f"sum(gain) > {EPS}", f"max(gain) / (sum(gain) + {EPS})"),
        "corr": when("count(level) >= 3", _CLIPPED.format(_CORR.format("level", "key"), -1)),
        "beta": when("count(level) >= 3", f"covar_pop(level, key) / (var_pop(key) + {EPS})"),
        "skew": when("count(level) >= 3", f"avg(pow(level - mu, 3)) / (pow(avg(pow(level - mu, 2)), 1.5) + {EPS})"),
        "path_length": when(f"{path} > {EPS}", f"abs(max(level) FILTER (WHERE bucket = {G - 1}) - max(level) FILTER (WHERE bucket = 0)) / ({path} + {EPS})"),
        "jump_ratio": when("count(level) >= 3", f"count(*) FILTER (WHERE abs(level - mu) > sd + {EPS})::DOUBLE / count(level)"),
        "first_last_diff": f"max(level) FILTER (WHERE bucket = {G - 1}) - max(level) FILTER (WHERE bucket = 0)",
    }
    return f"""l AS (SELECT *, {bucket} AS bucket FROM m), f AS (SELECT {K}, bucket, avg(a) AS level, avg(b) AS key, sum(greatest(a, 0)) AS gain FROM l GROUP BY ALL),
    every AS (SELECT {K}, unnest(range(0, {G})) AS bucket FROM (SELECT DISTINCT {K} FROM f)), g AS (SELECT * FROM every LEFT JOIN f USING ({K}, bucket)),
    k AS (SELECT *, lag(level) OVER ({P} ORDER BY bucket) AS before, avg(level) OVER ({P}) AS mu, stddev_pop(level) OVER ({P}) AS sd, avg(CASE WHEN level IS NOT NULL THEN bucket END) OVER ({P}) AS mb_all FROM g),
    z AS (SELECT *, CASE WHEN level IS NOT NULL THEN mb_all END AS mb FROM k)
    SELECT {K}, {columns(**{n: all_[n] for n in names})} FROM z GROUP BY ALL"""


_PLACE = f"(SELECT max(g)::INT FROM (SELECT unnest(range(0, {G})) AS g) WHERE (n * g) // {G} <= place AND place < (n * (g + 1)) // {G})"
add(
    "m07_sorted_bucket_statistics",
    lambda s, d: M.bucket_stats(M.sorted_buckets(minutes(s, d), G), G),
    f"WITH {MIN.replace('m AS', 'm0 AS')}, m AS (SELECT *, row_number() OVER ({P} ORDER BY b, ts, seq) - 1 AS place, count(*) OVER ({P}) AS n FROM m0), {_bucket_sql(_PLACE, M.BUCKETS)}",
)
_CLOCK = ["dispersion", "slope", "path_length", "early_late_diff"]
_REACHED = f"(sum(abs(b)) OVER ({P} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / (sum(abs(b)) OVER ({P}) + {EPS}))"
add(
    "m08_volume_clock_statistics",
    lambda s, d: M.bucket_stats(M.clock_buckets(minutes(s, d), G), G).select("instrument", "date", *_CLOCK),
    f"WITH {MIN}, {_bucket_sql(f'least(greatest(trunc({_REACHED} * {G}), 0), {G - 1})::INT', _CLOCK)}",
)
