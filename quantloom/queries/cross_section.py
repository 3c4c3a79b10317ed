"""Cross-section operators over the monthly factor panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import views
from quantloom.functions.scalar import nearest
from quantloom.operators import cross_section as X, rolling as R
from quantloom.queries.common import add, r

D = "(PARTITION BY date)"


def cell(name, make, expr, stages="", table="panel"):
    add(
        name,
        lambda spark, d: make(views.factor_panel(spark, d)).select("instrument", "date", F.col("value").cast("double").alias("value")),
        f"WITH {views.FACTOR_PANEL}{stages} SELECT instrument, date, {r(expr)} FROM {table}",
    )


def avg_rank(x):
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0 END)"


def pct(x):
    return f"({avg_rank(x)} / count({x}) OVER {D})"


def unit(x):
    return f"CASE WHEN count({x}) OVER {D} > 1 THEN 2 * ({avg_rank(x)} - 1) / (count({x}) OVER {D} - 1) - 1 WHEN {x} IS NOT NULL THEN 0 END"


def zs(x):
    return f"CASE WHEN count({x}) OVER {D} > 1 AND stddev_pop({x}) OVER {D} > 1e-12 THEN ({x} - avg({x}) OVER {D}) / stddev_pop({x}) OVER {D} END"


def median_stages(x):
    return f", m AS (SELECT *, quantile_cont({x}, 0.5) OVER {D} AS m FROM panel), d AS (SELECT *, quantile_cont(abs({x} - m), 0.5) OVER {D} AS d FROM m)"


_CLIP = "CASE WHEN d >= 1e-12 THEN greatest(least(x, m + 3.0 * 1.4826 * d), m - 3.0 * 1.4826 * d) ELSE x END"
cell("t32_cs_rank", lambda p: p.withColumn("value", X.cs_rank("x")), pct("x"))
cell("t33_cs_scale", lambda p: p.withColumn("value", 2 * (F.col("x") - F.min("x").over(X.by_date())) / (F.max("x").over(X.by_date()) - F.min("x").over(X.by_date()) + 1e-12) - 1), f"2 * (x - min(x) OVER {D}) / (max(x) OVER {D} - min(x) OVER {D} + 1e-12) - 1")
cell("t34_cs_zscore", lambda p: p.withColumn("value", (F.col("x") - F.avg("x").over(X.by_date())) / (F.stddev_samp("x").over(X.by_date()) + 1e-12)), f"(x - avg(x) OVER {D}) / (stddev_samp(x) OVER {D} + 1e-12)")
cell("r01_winsorize_mad", lambda p: X.winsorize_mad(p, "x"), _CLIP, median_stages("x"), "d")
cell("r02_rank_to_unit", lambda p: p.withColumn("value", X.rank_to_unit("x")), unit("x"))
_E = f", e AS (SELECT *, CASE WHEN eligible THEN x END AS q FROM panel), m AS (SELECT *, quantile_cont(q, 0.5) OVER {D} AS m FROM e), d AS (SELECT *, quantile_cont(abs(q - m), 0.5) OVER {D} AS d FROM m), k AS (SELECT *, {_CLIP.replace('(x,', '(q,').replace('ELSE x', 'ELSE q')} AS k0 FROM d), k2 AS (SELECT *, CASE WHEN q IS NOT NULL THEN k0 END AS k FROM k)"
cell("r03_mad_rank", lambda p: X.mad_rank(p, "x", eligible="eligible"), unit("k"), _E, "k2")
_R4 = f""", u AS (SELECT *, label - avg(label) OVER {D} AS b, x - avg(x) OVER {D} AS p, y - avg(y) OVER {D} AS q FROM panel WHERE label IS NOT NULL),
  g AS (SELECT date, count(*) AS n, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(p * b) AS pb, sum(q * b) AS qb FROM u GROUP BY date),
  o AS (SELECT l.instrument, l.date, CASE WHEN u.instrument IS NOT NULL AND n >= 4 AND abs(pp * qq - pq * pq) > 1e-14 THEN
    u.b - ((pb * qq - qb * pq) * u.p + (qb * pp - pb * pq) * u.q) / (pp * qq - pq * pq) END AS v
    FROM panel l LEFT JOIN u ON u.instrument = l.instrument AND u.date = l.date LEFT JOIN g ON g.date = l.date)"""
cell("r04_ols_residual", lambda p: X.regress(p, "label", ["x", "y"]), "v", _R4, "o")
_BETA = f"covar_pop(x, y) OVER {D} / var_pop(x) OVER {D}"
cell("r05_neutralize", lambda p: p.withColumn("value", X.neutralize("y", "x")), f"CASE WHEN count(y) OVER {D} >= 3 THEN y - (avg(y) OVER {D} + coalesce(CASE WHEN var_pop(x) OVER {D} > 1e-12 THEN {_BETA} END, 0) * (x - avg(x) OVER {D})) END")
cell("r07_winsor_zscore", lambda p: X.winsor_zscore(p, "x"), zs("c"), f", q AS (SELECT *, greatest(least(x, quantile_cont(x, 0.95) OVER {D}), quantile_cont(x, 0.05) OVER {D}) AS c FROM panel)", "q")
cell(
    "r10_normalize_cross_section", lambda p: X.normalize(p, "x", -1),
    f"CASE WHEN stddev_pop(k) OVER {D} > 1e-12 THEN (k - avg(k) OVER {D}) / stddev_pop(k) OVER {D} ELSE 0 END",
    f", a AS (SELECT *, -x AS q, list_sort(list(-x) OVER {D}) AS a FROM panel), b AS (SELECT *, greatest(least(q, a[(floor(0.975 * (len(a) - 1)) + 1)::INT]), a[(floor(0.025 * (len(a) - 1)) + 1)::INT]) AS b FROM a), k AS (SELECT *, {pct('b')} - 0.5 AS k FROM b)", "k",
)
cell("r12_composite_score", lambda p: X.composite(p, {"x": 0.7, "y": 0.3}), "0.7 * zx + 0.3 * zy", f", s AS (SELECT *, coalesce({zs('x')}, 0) AS zx, coalesce({zs('y')}, 0) AS zy FROM panel)", "s")
cell("r13_rank_panel", lambda p: p.withColumn("value", X.rank_to_unit("label")), unit("label"))
cell("r14_robust_standardise", lambda p: X.robust_zscore(p, "x"), "CASE WHEN d > 1e-8 THEN (x - m) / d ELSE 0 END", median_stages("x"), "d")
_P = "greatest(least(p, 0.99), 0.01)"
_T = f"sqrt(-2 * ln(least({_P}, 1 - {_P})))"
_Q = f"({_T} - (2.515517 + {_T} * (0.802853 + {_T} * 0.010328)) / (1 + {_T} * (1.432788 + {_T} * (0.189269 + {_T} * 0.001308))))"
cell("r15_rank_gaussian", lambda p: p.withColumn("value", X.rank_gaussian("x")), f"CASE WHEN {_P} >= 0.5 THEN {_Q} ELSE -{_Q} END", f", g AS (SELECT *, {pct('x')} AS p FROM panel)", "g")
cell("r16_dispersion_power", lambda p: p.withColumn("value", X.dispersion_power("label")), "sign(label) * pow(abs(label), 1.5)")
_GROUP = f"CASE WHEN count(x) OVER {D} >= 5 THEN ((row_number() OVER (PARTITION BY date ORDER BY x, instrument) - 1) * 5 // count(x) OVER {D}) + 1 END"
cell("r17_assign_groups", lambda p: X.assign_groups(p, "x"), _GROUP)
add(
    "r18_fractional_group_weights",
    lambda spark, d: X.fractional_weights(views.factor_panel(spark, d).withColumn("x", F.round("y", 1)), "x"),
    f"""WITH {views.FACTOR_PANEL}, t AS (SELECT instrument, date, round(y, 1) AS x FROM panel), s AS (SELECT *, {_GROUP} AS grp FROM t),
    b AS (SELECT date, x, grp, count(*) AS k FROM s WHERE grp IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, k::DOUBLE / sum(k) OVER (PARTITION BY date, grp) / sum(k) OVER (PARTITION BY date, x) AS weight FROM b)
    SELECT s.date, s.instrument, w.grp, {r('w.weight', 'weight')} FROM s JOIN w ON s.date = w.date AND s.x = w.x WHERE s.grp IS NOT NULL""",
)
_G = f", g AS (SELECT *, {_GROUP} AS g FROM panel)"
for _mode, _dir, _best, _worst in (("long_short", 1, 5, 1), ("long_short", -1, 1, 5), ("long_only", 1, 5, 0)):
    _size = 0.5 if _mode == "long_short" else 1.0
    cell(
        f"r19_target_weights_{_mode}{'_reversed' if _dir < 0 else ''}", lambda p, m=_mode, k=_dir: X.target_weights(X.assign_groups(p, "x", 5, "g"), "g", m, 5, k),
        f"CASE WHEN g = {_best} THEN {_size} / count(*) FILTER (WHERE g = {_best}) OVER {D} WHEN g = {_worst} THEN -{_size} / count(*) FILTER (WHERE g = {_worst}) OVER {D} WHEN g IS NOT NULL THEN 0 END",
        _G, "g",
    )
cell("m13_demean", lambda p: p.withColumn("value", F.col("x") - F.avg("x").over(X.by_date())), f"x - avg(x) OVER {D}")
cell("m13_tail_rank", lambda p: p.withColumn("value", X.tail_rank("x")), f"CASE WHEN {pct('x')} <= 0.2 OR {pct('x')} > 0.8 THEN {pct('x')} - 0.5 ELSE 0 END")
cell("m13_group_rank", lambda p: p.withColumn("value", F.ceil(X.cs_rank("x") * 5 - 1e-9) / 5), f"ceil({pct('x')} * 5 - 1e-9) / 5")
cell("n11_step_if_else", lambda p: p.withColumn("value", F.when(F.col("x") > F.avg("x").over(X.by_date()), F.col("y")).otherwise(F.col("w"))), f"CASE WHEN x > avg(x) OVER {D} THEN y ELSE w END")
cell("n13_dense_minmax_rank", lambda p: p.withColumn("q", nearest("y", 2)).withColumn("k", F.dense_rank().over(X.by_date().orderBy("q"))).withColumn("value", F.when(F.max("k").over(X.by_date()) > 1, (F.col("k") - 1) / (F.max("k").over(X.by_date()) - 1)).otherwise(0.0)), f"CASE WHEN max(k) OVER {D} > 1 THEN (k - 1)::DOUBLE / (max(k) OVER {D} - 1) ELSE 0 END", ", t AS (SELECT *, round(y, 2) AS q FROM panel), k AS (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY q) AS k FROM t)", "k")
cell("n15_sector_demean", lambda p: p.withColumn("value", X.sector_demean("x")), "x - avg(x) OVER (PARTITION BY date, sector)")
cell("n09_scale", lambda p: p.withColumn("value", F.col("label") / F.sum(F.abs("label")).over(X.by_date())), f"label / sum(abs(label)) OVER {D}")
add(
    "r11_orthogonalize",
    lambda spark, d: X.orthogonalize(views.factor_panel(spark, d), ["x", "y"]).select("instrument", "date", "orth_x", "orth_y"),
    # of two columns the inverse root of [[a, b], [b, c]] is ([[c, -b], [-b, a]] + s I) / (s t), s = sqrt(ac - bb), t = sqrt(a + c + 2 s)
    f"""WITH {views.FACTOR_PANEL}, g AS (SELECT date, count(*) AS n, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM panel GROUP BY date),
    s AS (SELECT *, sqrt(a * c - b * b) AS s, sqrt(a + c + 2 * sqrt(a * c - b * b)) AS t FROM g)
    SELECT instrument, p.date, {r('CASE WHEN n > 2 THEN (x * (c + s) - y * b) / (s * t) ELSE x END', 'orth_x')}, {r('CASE WHEN n > 2 THEN (y * (a + s) - x * b) / (s * t) ELSE y END', 'orth_y')}
    FROM panel p JOIN s USING (date)""",
)
add(
    "r20_latest_day_groups",
    lambda spark, d: X.assign_groups(views.factor_panel(spark, d).withColumn("last", F.max("date").over(F_all())).filter("date = last"), "x", 5, "grp").groupBy("grp").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean")),
    f"WITH {views.FACTOR_PANEL}, l AS (SELECT * FROM panel WHERE date = (SELECT max(date) FROM panel)), g AS (SELECT *, {_GROUP} AS grp FROM l) SELECT grp, count(*) AS n, {r('min(x)', 'low')}, {r('max(x)', 'high')}, {r('avg(x)', 'mean')} FROM g GROUP BY grp",
)
add(
    "r21_token_performance",
    lambda spark, d: views.factor_panel(spark, d).groupBy("instrument").agg(F.stddev_samp("x").alias("sd"), F.max_by("x", "date").alias("last_x"), (F.covar_samp("x", "label") / (F.stddev_samp(F.when(F.col("label").isNotNull(), F.col("x"))) * F.stddev_samp("label"))).alias("corr")),
    f"WITH {views.FACTOR_PANEL} SELECT instrument, {r('stddev_samp(x)', 'sd')}, {r('max_by(x, date)', 'last_x')}, {r('corr(x, label)', 'corr')} FROM panel GROUP BY instrument",
)
_STYLES = {"size": "w", "turnover": "y", "range": "x"}
add(
    "r08_daily_alpha_style_correlation",
    lambda spark, d: _style_table(views.factor_panel(spark, d)),
    f"""WITH {views.FACTOR_PANEL}, u AS (SELECT date, 'size' AS style, w AS s, label FROM panel WHERE label IS NOT NULL UNION ALL SELECT date, 'turnover', y, label FROM panel WHERE label IS NOT NULL UNION ALL SELECT date, 'range', x, label FROM panel WHERE label IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY date, style ORDER BY s) + (count(*) OVER (PARTITION BY date, style, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY date, style ORDER BY label) + (count(*) OVER (PARTITION BY date, style, label) - 1) / 2.0 AS rl FROM u)
    SELECT date, style, count(*) AS n, {r('corr(s, label)', 'pearson')}, {r('corr(rs, rl)', 'spearman')} FROM k GROUP BY date, style HAVING count(*) >= 10""",
)
add(
    "r06_style_exposures",
    lambda spark, d: _exposures(views.factor_panel(spark, d)),
    f"""WITH {views.FACTOR_PANEL}, m AS (SELECT *, avg(ret) OVER {D} AS mkt FROM panel), b AS (SELECT instrument, date, w AS size,
      {r('ln(quote_volume / volume)', 'liquidity')}, {r("CASE WHEN count(ret) OVER q >= 10 THEN covar_samp(ret, CASE WHEN ret IS NOT NULL THEN mkt END) OVER q / var_samp(CASE WHEN ret IS NOT NULL THEN mkt END) OVER q END", 'beta')},
      {r('CASE WHEN count(ret) OVER q >= 20 THEN sum(ret) OVER q END', 'momentum')}, {r('-ret', 'reversal')},
      {r('CASE WHEN count(ret) OVER q >= 20 THEN stddev_samp(ret) OVER q * sqrt(365) END', 'volatility')}
      FROM m WINDOW q AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT instrument, date, {r('size', 'size')}, liquidity, beta, momentum, reversal, volatility FROM b""",
)


def F_all():  # noqa: N802
    from pyspark.sql import Window

    return Window.partitionBy()


def _style_table(p):
    """Per date and style: Pearson and Spearman correlation with the label, from 10 pairs on."""
    from pyspark.sql import Window

    styles = F.explode(F.array(*[F.struct(F.lit(n).alias("style"), F.col(c).alias("s")) for n, c in _STYLES.items()]))
    u = p.filter("label is not null").select("date", "label", styles.alias("e")).select("date", "label", "e.style", "e.s")
    w = Window.partitionBy("date", "style")
    avg = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("date", "style", c)) - 1) / 2
    u = u.withColumn("rs", avg("s")).withColumn("rl", avg("label"))
    pearson = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return u.groupBy("date", "style").agg(F.count("*").alias("n"), pearson("s", "label").alias("pearson"), pearson("rs", "rl").alias("spearman")).filter("n >= 10")


def _exposures(p):
    """Style exposures of each cell against the date's mean return."""
    p = p.withColumn("mkt", F.avg("ret").over(X.by_date()))
    return p.select(
        "instrument", "date", F.col("w").alias("size"), F.log(F.col("quote_volume") / F.col("volume")).alias("liquidity"), R.ts_beta("ret", "mkt", 20, 10).alias("beta"),
        R.ts_sum("ret", 20).alias("momentum"), (-F.col("ret")).alias("reversal"), (R.ts_std("ret", 20) * F.sqrt(F.lit(365.0))).alias("volatility"),
    )
