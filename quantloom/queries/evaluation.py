"""Evaluation aggregates over the monthly factor panel, daily bars and events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quantloom import views
from quantloom.functions.scalar import divide, natural_log
from quantloom.operators import cross_section as X, evaluation as E, joins as J, portfolio as P, rolling as R
from quantloom.queries.common import add, r

FP, BE, FL, ME = views.FACTOR_PANEL, views.BARS_EV, views.FLOWS_EV, views.MEMBERS_EV
D = "(PARTITION BY date)"


def fp(s, d):
    return views.factor_panel(s, d)


def be(s, d):
    return views.bars_ev(s, d)


def market(s, d):
    """One return series: the mean of each month's returns."""
    return fp(s, d).filter("ret is not null").groupBy("date").agg(F.round(F.avg("ret"), 9).alias("ret"))


MARKET = f"{FP}, series AS (SELECT date, round(avg(ret), 9) AS ret FROM panel WHERE ret IS NOT NULL GROUP BY date)"
_OK = "count(*) >= 3 AND min(x) < max(x) AND min(label) < max(label)"
IC = f"""{FP}, v AS (SELECT * FROM panel WHERE x IS NOT NULL AND label IS NOT NULL),
  k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl FROM v),
  ic AS (SELECT date, count(*) AS n, CASE WHEN {_OK} THEN corr(x, label) END AS ic, CASE WHEN {_OK} THEN corr(rx, rl) END AS rank_ic FROM k GROUP BY date)"""


def ic(s, d):
    return E.daily_ic(fp(s, d))


def all_ic(s, d):
    """Daily rank ICs of three factors: factor, date, ic."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in ("x", "y", "w")]))
    long = fp(s, d).select("instrument", "date", "label", e.alias("e")).select("instrument", "date", "label", "e.factor", "e.x")
    return E.daily_ic(long, by=["factor"]).select("factor", "date", F.round("rank_ic", 9).alias("ic"))


ALL_IC = f"""{FP}, l AS (SELECT instrument, date, label, unnest(['x', 'y', 'w']) AS factor, unnest([x, y, w]) AS v FROM panel),
  k AS (SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY v) + (count(*) OVER (PARTITION BY factor, date, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor, date ORDER BY label) + (count(*) OVER (PARTITION BY factor, date, label) - 1) / 2.0 AS rl FROM l WHERE v IS NOT NULL AND label IS NOT NULL),
  ics AS (SELECT factor, date, round(CASE WHEN count(*) >= 3 AND min(v) < max(v) AND min(label) < max(label) THEN corr(rx, rl) END, 9) AS ic FROM k GROUP BY factor, date)"""

add("a01_funding_daily", lambda s, d: E.funding_daily(views.flows_ev(s, d).withColumn("rate", F.when(F.col("event_id") % 50 > 0, F.col("rate")))), f"""WITH {FL}, e AS (SELECT *, CASE WHEN event_id % 50 > 0 THEN rate END AS q FROM flows)
  SELECT instrument, date, {r('CASE WHEN bool_and(q IS NOT NULL) THEN sum(q) END', 'rate_sum')}, {r('CASE WHEN bool_and(q IS NOT NULL) THEN avg(q) END', 'rate_mean')}, {r('CASE WHEN bool_and(q IS NOT NULL) THEN max_by(q, (ts, event_id)) END', 'rate_last')},
  count(*) AS event_count, count(*) FILTER (WHERE q <= 0.005) AS invalid_price_count FROM e GROUP BY instrument, date""")
_CADENCE = f"""{FL}, p AS (SELECT instrument, date, count(*) AS n FROM flows GROUP BY ALL HAVING count(*) BETWEEN 3 AND 24),
  c AS (SELECT instrument, n, count(*) AS days, min(date) AS first_seen FROM p GROUP BY ALL), best AS (SELECT instrument, n AS daily_count, days, first_seen FROM c QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY days DESC, first_seen, n) = 1)"""
add("a02_funding_cadence", lambda s, d: E.cadence(views.flows_ev(s, d)), f"WITH {_CADENCE} SELECT * FROM best")
add(
    "a03_expected_schedule_grid",
    lambda s, d: be(s, d).select("instrument", "date", "trade_count").join(E.cadence(views.flows_ev(s, d)).select("instrument", "daily_count"), "instrument", "left").select("instrument", "date", F.when(F.col("trade_count").between(3, 24), F.col("trade_count")).otherwise(F.coalesce("daily_count", F.lit(0))).alias("expected")),
    f"WITH {_CADENCE}, b AS (SELECT instrument, date, count(*) AS k FROM flows GROUP BY ALL) SELECT b.instrument, b.date, CASE WHEN k BETWEEN 3 AND 24 THEN k ELSE coalesce(daily_count, 0) END AS expected FROM b LEFT JOIN best USING (instrument)",
)
add("a04_daily_top_ranking", lambda s, d: E.top_n_by_date(be(s, d), "volume", 10).select("instrument", "date", "position", "volume"), f"WITH {BE} SELECT instrument, date, row_number() OVER (PARTITION BY date ORDER BY volume DESC, instrument) AS position, {r('volume', 'volume')} FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, instrument) <= 10")
add(
    "a05_token_window_universe",
    lambda s, d: be(s, d).withColumn("seen", F.explode(F.sequence(F.col("day"), F.col("day") + 6))).groupBy(F.col("seen").alias("day")).agg(F.count_distinct("instrument").alias("n_tokens")),
    f"WITH {BE}, s AS (SELECT instrument, unnest(range(day, day + 7)) AS day FROM bars) SELECT day, count(DISTINCT instrument) AS n_tokens FROM s GROUP BY day",
)
add("a06_daily_ic", ic, f"WITH {IC} SELECT date, n, {r('ic', 'ic')}, {r('rank_ic', 'rank_ic')} FROM ic")
add("a07_daily_spearman", lambda s, d: all_ic(s, d), f"WITH {ALL_IC} SELECT factor, date, {r('ic', 'ic')} FROM ics")
add("a08_ic_summary", lambda s, d: E.ic_summary(ic(s, d)), f"WITH {IC} SELECT count(rank_ic) AS n, {r('avg(rank_ic)', 'mean')}, {r('stddev_samp(rank_ic)', 'sd')}, {r('avg(rank_ic) / stddev_samp(rank_ic)', 'ir')}, {r('avg(rank_ic) / stddev_samp(rank_ic) * sqrt(365)', 'ir_year')}, {r('avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(rank_ic)))', 't')}, {r('avg((rank_ic > 0)::INT)', 'positive')} FROM ic")
_DECAY = f"""{FP}, h AS (SELECT instrument, unnest(range(1, 11)) AS h, day AS t, x FROM panel WHERE x IS NOT NULL), p AS (SELECT h.h, h.x, q.ret AS label FROM h JOIN panel q ON q.instrument = h.instrument AND q.day = h.t + h.h WHERE q.ret IS NOT NULL),
  k AS (SELECT *, rank() OVER (PARTITION BY h ORDER BY x) + (count(*) OVER (PARTITION BY h, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY h ORDER BY label) + (count(*) OVER (PARTITION BY h, label) - 1) / 2.0 AS rl FROM p),
  decay AS (SELECT h, count(*) AS n, corr(rx, rl) AS rank_ic FROM k GROUP BY h)"""
add("a09_ic_decay", lambda s, d: E.ic_decay(fp(s, d), "x", "ret", range(1, 11)), f"WITH {_DECAY} SELECT h::INT AS h, n, {r('rank_ic', 'rank_ic')} FROM decay")
add("a10_ic_autocorrelation", lambda s, d: E.autocorrelation(ic(s, d).withColumn("day", F.year("date") * 12 + F.month("date")), "rank_ic", range(1, 21)), f"WITH {IC}, s AS (SELECT year(date) * 12 + month(date) AS t, rank_ic FROM ic), lags AS (SELECT unnest(range(1, 21)) AS lag) SELECT lag::INT AS lag, count(*) AS n, {r('corr(a.rank_ic, b.rank_ic)', 'autocorrelation')} FROM lags, s a JOIN s b ON b.t = a.t + lag WHERE a.rank_ic IS NOT NULL AND b.rank_ic IS NOT NULL GROUP BY lag")
add("a11_half_life", lambda s, d: E.half_life(E.ic_decay(fp(s, d), "x", "ret", range(1, 11))), f"WITH {_DECAY} SELECT min(h)::INT AS half_life FROM decay WHERE abs(rank_ic) <= 0.5 * (SELECT abs(rank_ic) FROM decay WHERE h = 1)")
add("a12_label_coverage", lambda s, d: E.label_coverage(fp(s, d)), f"WITH {FP}, p AS (SELECT date, count(x) AS v, count(label) AS l FROM panel GROUP BY date) SELECT {r('avg(l::DOUBLE / v)', 'coverage')}, count(*) AS n_days FROM p WHERE v > 0")
add(
    "a13_sample_split_purge",
    lambda s, d: fp(s, d).select(F.when(F.add_months("date", 2) <= F.to_date(F.lit("1997-06-01")), "in").when(F.add_months("date", 1) > F.to_date(F.lit("1997-06-01")), "out").otherwise("purged").alias("part"), "date").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("date").alias("n_dates")),
    f"WITH {FP} SELECT CASE WHEN date + INTERVAL 2 MONTH <= DATE '1997-06-01' THEN 'in' WHEN date + INTERVAL 1 MONTH > DATE '1997-06-01' THEN 'out' ELSE 'purged' END AS part, count(*) AS n, count(DISTINCT date) AS n_dates FROM panel GROUP BY 1",
)


def summary_sql(by, source, periods=365):
    p = f"PARTITION BY {by}" if by else ""
    c, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""n AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS nav FROM {source} WINDOW w AS ({p} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      q AS (SELECT *, greatest(max(nav) OVER ({p} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS peak FROM n)
      SELECT {c}count(ret) AS n, {r('exp(sum(ln(1 + ret))) - 1', 'total_return')}, {r(f'pow(exp(sum(ln(1 + ret))), {periods}.0 / count(ret)) - 1', 'annual_return')}, {r(f'stddev_samp(ret) * sqrt({periods})', 'volatility')},
      {r(f'CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt({periods}) END', 'sharpe')}, {r('min(nav / peak - 1)', 'max_drawdown')}, {r('avg((ret > 0)::INT)', 'win_rate')}, {r('avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END)', 'profit_loss')} FROM q {g}"""


add("a14_return_summary", lambda s, d: E.return_summary(market(s, d), periods=12), f"WITH {MARKET}, {summary_sql('', 'series', 12)}")
add(
    "a15_simple_metrics",
    lambda s, d: market(s, d).agg((F.pow(1 + F.avg("ret"), F.lit(12.0)) - 1).alias("annual_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("volatility")),
    f"WITH {MARKET} SELECT {r('pow(1 + avg(ret), 12) - 1', 'annual_return')}, {r('stddev_samp(ret) * sqrt(12)', 'volatility')} FROM series",
)
add(
    "a16_nav_metrics",
    lambda s, d: E.return_summary(fp(s, d).filter("ret is not null").select("instrument", "date", F.greatest("ret", F.lit(-0.9)).alias("ret")), ["instrument"], periods=12),
    f"WITH {FP}, t AS (SELECT instrument, date, greatest(ret, -0.9) AS ret FROM panel WHERE ret IS NOT NULL), {summary_sql('instrument', 't', 12)}",
)
add("a18_quarterly_slices", lambda s, d: E.quarterly(market(s, d)), f"""WITH {MARKET}, n AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS nav, date_trunc('quarter', date)::DATE AS quarter FROM series),
  q AS (SELECT quarter, count(*) AS n_days, exp(sum(ln(1 + ret))) - 1 AS qr, max_by(nav, date) AS e FROM n GROUP BY quarter), o AS (SELECT *, coalesce(lag(e) OVER (ORDER BY quarter), 1) AS b FROM q)
  SELECT quarter, n_days, {r('qr', 'quarter_return')}, {r('e', 'end_wealth')}, {r('b', 'start_wealth')}, abs(e / b - 1 - qr) < 1e-9 AS reconciles FROM o""")
add(
    "a19_net_stability",
    lambda s, d: _stability(E.quarterly(market(s, d))),
    f"""WITH {MARKET}, q AS (SELECT date_trunc('quarter', date)::DATE AS quarter, exp(sum(ln(1 + ret))) - 1 AS qr FROM series GROUP BY 1)
    SELECT count(*) AS n_quarters, count_if(qr > 0) AS n_positive, max_by(quarter, (qr, -(quarter - DATE '1970-01-01'))) AS best_quarter, {r('max(qr) / sum(CASE WHEN qr > 0 THEN qr ELSE 0 END)', 'concentration')},
    {r('exp(sum(ln(1 + qr)) - max(ln(1 + qr))) - 1', 'without_best')}, {r('min(qr)', 'worst')} FROM q""",
)


def _stability(q):
    r_, gain = F.col("quarter_return"), F.sum(F.when(F.col("quarter_return") > 0, F.col("quarter_return")).otherwise(0.0))
    return q.agg(
        F.count("*").alias("n_quarters"), F.count_if(r_ > 0).alias("n_positive"), F.max_by("quarter", F.struct(r_, -F.unix_date("quarter"))).alias("best_quarter"), (F.max(r_) / gain).alias("concentration"),
        (F.exp(F.sum(F.log1p(r_)) - F.max(F.log1p(r_))) - 1).alias("without_best"), F.min(r_).alias("worst"),
    )


_Q = f"{MARKET}, q AS (SELECT date_trunc('quarter', date)::DATE AS quarter, exp(sum(ln(1 + ret))) - 1 AS qr FROM series GROUP BY 1)"
add(
    "a20_segment_score",
    lambda s, d: E.quarterly(market(s, d)).agg((F.percentile("quarter_return", F.lit(0.5)) - 0.5 * F.stddev_pop("quarter_return") - 0.3 * F.greatest(-F.min("quarter_return"), F.lit(0.0))).alias("score")),
    f"WITH {_Q} SELECT {r('quantile_cont(qr, 0.5) - 0.5 * stddev_pop(qr) - 0.3 * greatest(-min(qr), 0)', 'score')} FROM q",
)
add(
    "a21_training_score",
    lambda s, d: ic(s, d).withColumn("quarter", F.to_date(F.date_trunc("quarter", "date"))).groupBy("quarter").agg(F.avg("rank_ic").alias("mean"), F.count("rank_ic").alias("n"), F.count_if(F.col("rank_ic") > 0).alias("n_positive")),
    f"WITH {IC} SELECT date_trunc('quarter', date)::DATE AS quarter, {r('avg(rank_ic)', 'mean')}, count(rank_ic) AS n, count_if(rank_ic > 0) AS n_positive FROM ic GROUP BY 1",
)
add("a22_return_moments", lambda s, d: E.moments(fp(s, d).filter("ret is not null"), by=["instrument"]), f"WITH {FP} SELECT instrument, count(ret) AS n, {r('avg(ret) / stddev_samp(ret)', 'sharpe')}, {r('skewness(ret)', 'skew')}, {r('kurtosis(ret) + 3', 'kurtosis')} FROM panel WHERE ret IS NOT NULL GROUP BY instrument")
add(
    "a23_deflated_sharpe",
    lambda s, d: _deflated(E.moments(fp(s, d).filter("ret is not null"), by=["instrument"])),
    None,
)


def _deflated(m):
    """Chance that a Sharpe ratio beats the best of k trials of no skill, for several k."""
    from quantloom.functions.scalar import normal_cdf, normal_quantile

    spread = m.agg(F.stddev_samp("sharpe").alias("sd"))
    g = 0.5772156649
    rows = m.crossJoin(F.broadcast(spread)).withColumn("trials", F.explode(F.array(*[F.lit(float(k)) for k in (10, 100, 1000)])))  # one row
    best = F.col("sd") * ((1 - g) * normal_quantile(1 - 1 / F.col("trials")) + g * normal_quantile(1 - 1 / (F.col("trials") * 2.718281828459045)))
    wide = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.pow("sharpe", F.lit(2.0)), F.lit(1e-12)))
    return rows.select("instrument", "trials", normal_cdf((F.col("sharpe") - best) * F.sqrt(F.col("n") - 1) / wide).alias("probability"))


add(
    "a25_behaviour_cells",
    lambda s, d: fp(s, d).withColumn("cell", F.when(F.col("label").isNull(), -1).when(F.col("label") < -0.2, 0).when(F.col("label") < 0.0, 1).when(F.col("label") < 0.2, 2).otherwise(3)).groupBy("cell").agg(F.count("*").alias("n")),
    f"WITH {FP} SELECT CASE WHEN label IS NULL THEN -1 WHEN label < -0.2 THEN 0 WHEN label < 0 THEN 1 WHEN label < 0.2 THEN 2 ELSE 3 END AS cell, count(*) AS n FROM panel GROUP BY 1",
)


def outer_weights(panel, x="x"):
    return X.target_weights(X.assign_groups(panel, x, 5, "g"), "g").filter("value <> 0").select("date", "instrument", F.col("value").alias("weight"))


def top_weights(s, d, x="x"):
    return outer_weights(fp(s, d), x)


def _weights_sql(x):
    return f"(SELECT date, instrument, CASE WHEN g = 5 THEN 0.5 / count(*) FILTER (WHERE g = 5) OVER {D} WHEN g = 1 THEN -0.5 / count(*) FILTER (WHERE g = 1) OVER {D} END AS weight FROM (SELECT *, CASE WHEN count({x}) OVER {D} >= 5 THEN ((row_number() OVER (PARTITION BY date ORDER BY {x}, instrument) - 1) * 5 // count({x}) OVER {D}) + 1 END AS g FROM panel) QUALIFY g IN (1, 5))".replace("QUALIFY g IN (1, 5)", "")


WX, WY = _weights_sql("x"), _weights_sql("y")
add(
    "a26_trading_similarity",
    lambda s, d: top_weights(s, d).select("date", "instrument", F.signum("weight").alias("a")).join(top_weights(s, d, "y").select("date", "instrument", F.signum("weight").alias("b")), ["date", "instrument"], "full_outer").groupBy("date").agg((2 * F.count_if(F.col("a") == F.col("b")) / (F.count("a") + F.count("b"))).alias("overlap")),
    f"WITH {FP}, a AS (SELECT date, instrument, sign(weight) AS a FROM {WX} WHERE weight IS NOT NULL), b AS (SELECT date, instrument, sign(weight) AS b FROM {WY} WHERE weight IS NOT NULL) SELECT date, {r('2.0 * count_if(a = b) / (count(a) + count(b))', 'overlap')} FROM a FULL JOIN b USING (date, instrument) GROUP BY date",
)
add(
    "a27_equal_capital_sleeves",
    lambda s, d: P.sleeves_to_returns(fp(s, d).filter("ret is not null").groupBy(F.col("sector").alias("sleeve"), "date").agg(F.round(F.avg("ret"), 9).alias("ret"))),
    f"""WITH {FP}, s AS (SELECT sector, date, round(avg(ret), 9) AS ret FROM panel WHERE ret IS NOT NULL GROUP BY ALL), w AS (SELECT date, exp(sum(ln(1 + ret)) OVER (PARTITION BY sector ORDER BY date)) AS w FROM s), m AS (SELECT date, avg(w) AS wealth FROM w GROUP BY date)
    SELECT date, {r('wealth', 'wealth')}, {r('wealth / coalesce(lag(wealth) OVER (ORDER BY date), 1) - 1', 'ret')} FROM m""",
)
_GRP = f"SELECT *, CASE WHEN count(x) OVER {D} >= 5 THEN ((row_number() OVER (PARTITION BY date ORDER BY x, instrument) - 1) * 5 // count(x) OVER {D}) + 1 END AS grp FROM panel"
add("a28_group_mean_returns", lambda s, d: E.group_returns(X.assign_groups(fp(s, d), "x", 5, "grp")), f"WITH {FP}, g AS ({_GRP}) SELECT date, grp, count(*) AS n, {r('avg(label)', 'mean_return')} FROM g WHERE grp IS NOT NULL AND label IS NOT NULL GROUP BY date, grp")
add("a29_group_ic", lambda s, d: X.assign_groups(fp(s, d), "x", 5, "grp").filter("grp is not null and label is not null").groupBy("grp").agg(E.pearson("x", "label").alias("ic")), f"WITH {FP}, g AS ({_GRP}) SELECT grp, {r('corr(x, label)', 'ic')} FROM g WHERE grp IS NOT NULL AND label IS NOT NULL GROUP BY grp")
add("a30_style_summary", lambda s, d: E.ic_summary(all_ic(s, d), "ic", ["factor"]), f"WITH {ALL_IC} SELECT factor, count(ic) AS n, {r('avg(ic)', 'mean')}, {r('stddev_samp(ic)', 'sd')}, {r('avg(ic) / stddev_samp(ic)', 'ir')}, {r('avg(ic) / stddev_samp(ic) * sqrt(365)', 'ir_year')}, {r('avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))', 't')}, {r('avg((ic > 0)::INT)', 'positive')} FROM ics GROUP BY factor")
_LONG = f"{FP}, l AS (SELECT instrument, date, unnest(['x', 'y', 'w']) AS f, unnest([x, y, w]) AS v FROM panel)"
add("a31_factor_correlation_matrix", lambda s, d: _correlations(s, d), f"WITH {_LONG} SELECT a.f AS factor_a, b.f AS factor_b, count(*) AS n, {r('corr(a.v, b.v)', 'corr')} FROM l a JOIN l b ON a.instrument = b.instrument AND a.date = b.date AND a.f < b.f GROUP BY ALL HAVING count(*) >= 30")


def long_table(s, d):
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in ("x", "y", "w")]))
    return fp(s, d).select("instrument", "date", e.alias("e")).select("instrument", "date", "e.factor", "e.value")


def _correlations(s, d):
    a, b = (long_table(s, d).select("instrument", "date", F.col("factor").alias(f"factor_{k}"), F.col("value").alias(k)) for k in "ab")
    return a.join(b, ["instrument", "date"]).filter("factor_a < factor_b").groupBy("factor_a", "factor_b").agg(F.count("*").alias("n"), E.pearson("a", "b").alias("corr")).filter("n >= 30")


add(
    "a32_cluster_representative",
    lambda s, d: long_table(s, d).groupBy("factor").agg(F.count("value").alias("covered")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("covered"), "factor"))),
    f"WITH {_LONG}, c AS (SELECT f AS factor, count(v) AS covered FROM l GROUP BY f) SELECT factor, covered, row_number() OVER (ORDER BY covered DESC, factor) AS place FROM c",
)
WIDE = ("x", "y", "w", "ret", "funding", "volume", "quote_volume")


def _clustered(s, d):
    """The factor of most values in each cluster of like ones; rows at the driver are factors and pairs of factors."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in WIDE]))
    long = fp(s, d).select("instrument", "date", e.alias("e")).select("instrument", "date", "e.factor", "e.value").filter("value is not null")
    covered = {r_.factor: r_.n for r_ in long.groupBy("factor").agg(F.count("*").alias("n")).collect()}
    a, b = (long.select("instrument", "date", F.col("factor").alias(f"factor_{k}"), F.col("value").alias(k)) for k in "ab")
    pairs = a.join(b, ["instrument", "date"]).filter("factor_a < factor_b").groupBy("factor_a", "factor_b").agg(E.pearson("a", "b").alias("c")).collect()
    groups = P.average_linkage(list(covered), {(p.factor_a, p.factor_b): p.c for p in pairs}, 0.5)
    rows = [(k, f, covered[f], f == min(g, key=lambda n: (-covered[n], n))) for k, g in enumerate(groups) for f in g]
    return s.createDataFrame(rows, "cluster int, factor string, covered long, represents boolean")


add("a32_clusters_by_linkage", _clustered)
add("a33_greedy_decorrelation", lambda s, d: _greedy(s, d), f"WITH {_LONG}, c AS (SELECT a.f AS a, b.f AS b, abs(corr(a.v, b.v)) AS c FROM l a JOIN l b ON a.instrument = b.instrument AND a.date = b.date AND a.f < b.f GROUP BY ALL) SELECT f AS factor FROM (SELECT unnest(['w', 'x', 'y']) AS f) q WHERE f = 'w' OR f = 'x' AND (SELECT c FROM c WHERE a = 'w' AND b = 'x') < 0.3 OR f = 'y' AND (SELECT c FROM c WHERE a = 'w' AND b = 'y') < 0.3 AND ((SELECT c FROM c WHERE a = 'x' AND b = 'y') < 0.3 OR (SELECT c FROM c WHERE a = 'w' AND b = 'x') >= 0.3)")


def _greedy(s, d):
    """Factors kept in name order; the pair table has a row per pair of factors and is all that reaches the driver."""
    pairs = {(x.factor_a, x.factor_b): x["corr"] for x in _correlations(s, d).collect()}
    names = sorted({n for p in pairs for n in p})
    return s.createDataFrame([(n,) for n in P.greedy_decorrelation(names, pairs, 0.3)], "factor string")


add(
    "a34_ic_stability_selection",
    lambda s, d: all_ic(s, d).filter("ic is not null").withColumn("period", F.ntile(4).over(Window.partitionBy("factor").orderBy("date"))).groupBy("factor", "period").agg(F.avg("ic").alias("mean")).groupBy("factor").agg(F.avg((F.col("mean") > 0).cast("int")).alias("share_positive"), F.max_by("mean", "period").alias("recent")),
    f"WITH {ALL_IC}, p AS (SELECT *, ntile(4) OVER (PARTITION BY factor ORDER BY date) AS period FROM ics WHERE ic IS NOT NULL), m AS (SELECT factor, period, avg(ic) AS mean FROM p GROUP BY ALL) SELECT factor, {r('avg((mean > 0)::INT)', 'share_positive')}, {r('max_by(mean, period)', 'recent')} FROM m GROUP BY factor",
)
add(
    "a35_in_sample_filter",
    lambda s, d: all_ic(s, d).filter("date <= date'1997-06-01'").groupBy("factor").agg(F.count("ic").alias("n"), (F.avg("ic") / F.stddev_samp("ic")).alias("ir")).filter("n >= 20").withColumn("direction", F.signum("ir").cast("int")),
    f"WITH {ALL_IC} SELECT factor, count(ic) AS n, {r('avg(ic) / stddev_samp(ic)', 'ir')}, sign(avg(ic) / stddev_samp(ic))::INT AS direction FROM ics WHERE date <= DATE '1997-06-01' GROUP BY factor HAVING count(ic) >= 20",
)
add(
    "a36_missing_reasons",
    lambda s, d: E.missing_reasons(be(s, d).withColumn("n", F.count("*").over(R.past())), "rate", [("first_days", F.col("n") <= 2), ("thin", F.col("trade_count") < 2), ("no_taker", F.col("taker_volume") == 0)]),
    f"WITH {BE}, n AS (SELECT *, count(*) OVER (PARTITION BY instrument ORDER BY day) AS n FROM bars) SELECT CASE WHEN n <= 2 THEN 'first_days' WHEN trade_count < 2 THEN 'thin' WHEN taker_volume = 0 THEN 'no_taker' ELSE 'other' END AS reason, count(*) AS n FROM n WHERE rate IS NULL GROUP BY 1",
)
_ISL = f"{BE}, i AS (SELECT instrument, day, day - row_number() OVER (PARTITION BY instrument ORDER BY day) AS i FROM bars), runs AS (SELECT instrument, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM i GROUP BY instrument, i)"
add("a37_gap_islands", lambda s, d: E.islands(be(s, d).select("instrument", "day"), ["instrument"]), f"WITH {_ISL} SELECT * FROM runs")
add("a38_longest_prefix", lambda s, d: E.longest_prefix(be(s, d).select("instrument", "day"), ["instrument"]), f"WITH {_ISL} SELECT * FROM runs QUALIFY first_day = min(first_day) OVER (PARTITION BY instrument)")
add(
    "a39_complete_snapshot",
    lambda s, d: be(s, d).groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("instrument").alias("n_distinct"), F.bool_and(F.col("volume").isNotNull() & (F.col("instrument") >= 0)).alias("valid")).withColumn("complete", F.col("valid") & (F.col("n") == F.col("n_distinct")) & (F.col("n") >= 130)),
    f"WITH {BE} SELECT date, count(*) AS n, count(DISTINCT instrument) AS n_distinct, bool_and(volume IS NOT NULL AND instrument >= 0) AS valid, bool_and(volume IS NOT NULL AND instrument >= 0) AND count(*) = count(DISTINCT instrument) AND count(*) >= 130 AS complete FROM bars GROUP BY date",
)
add(
    "a40_validation_report",
    lambda s, d: E.checks_bars(be(s, d)),
    f"""WITH {BE}, c AS (SELECT count_if(volume < 0) AS a, count_if(high < low) AS b, count_if(close > high OR close < low) AS c, count_if(volume = 0 AND open = close AND high = low) AS d, count_if(high = low) AS e, count_if(rate IS NULL) AS f, count(*) - count(DISTINCT (instrument, date)) AS g FROM bars)
    SELECT unnest(['negative_volume', 'high_below_low', 'close_outside_range', 'placeholder', 'flat_bar', 'missing_rate', 'duplicate_key']) AS code, unnest(['error', 'error', 'error', 'warning', 'warning', 'warning', 'error']) AS level, unnest([a, b, c, d, e, f, g]) AS n FROM c""",
)
add("a40_overlapping_intervals", lambda s, d: E.overlapping(views.members_ev(s, d).withColumn("effective_end_date", F.date_add("effective_date", F.pmod("instrument", F.lit(9)).cast("int")))).select("instrument", "effective_date"), f"WITH {ME}, m AS (SELECT instrument, effective_date, effective_date + (instrument % 9)::INT AS e FROM members) SELECT instrument, effective_date FROM m QUALIFY max(e) OVER (PARTITION BY instrument ORDER BY effective_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= effective_date")
add(
    "a41_readiness_report",
    lambda s, d: be(s, d).groupBy("date").agg(F.count("*").alias("active"), F.count_if(F.col("high") > F.col("low")).alias("complete")).withColumn("ready", F.col("complete") >= 90),
    f"WITH {BE} SELECT date, count(*) AS active, count_if(high > low) AS complete, count_if(high > low) >= 90 AS ready FROM bars GROUP BY date",
)
add("a42_cell_counts", lambda s, d: fp(s, d).agg(F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("ineligible"), F.count_if(F.col("eligible") & F.col("label").isNull()).alias("missing"), F.count_if(F.col("eligible") & F.col("label").isNotNull()).alias("valid")), f"WITH {FP} SELECT count_if(eligible) AS eligible, count_if(NOT eligible) AS ineligible, count_if(eligible AND label IS NULL) AS missing, count_if(eligible AND label IS NOT NULL) AS valid FROM panel")
_TOPM = f"{FP}, t AS (SELECT date, label FROM panel WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY x DESC, instrument) <= 10), series AS (SELECT date, round(avg(label), 9) AS ret FROM t GROUP BY date)"
add("a43_top_k_yearly", lambda s, d: E.return_summary(E.top_n_by_date(fp(s, d).filter("label is not null"), "x", 10).groupBy("date").agg(F.round(F.avg("label"), 9).alias("ret")).withColumn("year", F.year("date")), ["year"], periods=12), f"WITH {_TOPM}, y AS (SELECT *, year(date) AS year FROM series), {summary_sql('year', 'y', 12)}")
add(
    "a44_factor_quality_guard",
    lambda s, d: fp(s, d).groupBy("date").agg(F.count("x").alias("n"), F.count_if(F.col("x") != 0).alias("nonzero"), F.count_distinct("x").alias("n_distinct")).agg(F.count_if(F.col("n") >= 20).alias("days_covered"), F.count_if(F.col("nonzero") >= 20).alias("days_nonzero"), F.count_if(F.col("n_distinct") >= 20).alias("days_distinct")),
    f"WITH {FP}, p AS (SELECT date, count(x) AS n, count_if(x <> 0) AS z, count(DISTINCT x) AS k FROM panel GROUP BY date) SELECT count_if(n >= 20) AS days_covered, count_if(z >= 20) AS days_nonzero, count_if(k >= 20) AS days_distinct FROM p",
)
add(
    "a46_rank_ic_novelty",
    lambda s, d: all_ic(s, d).filter("factor = 'x'").select("date", F.col("ic").alias("c")).join(all_ic(s, d).filter("factor <> 'x'"), "date").filter("c is not null and ic is not null").groupBy("factor").agg(F.count("*").alias("n"), F.abs(E.pearson("c", "ic")).alias("corr")).agg(F.when(F.max("n") < 60, -1e6).otherwise(1 - F.max(F.when(F.col("n") >= 60, F.col("corr")))).alias("novelty")),
    f"WITH {ALL_IC}, c AS (SELECT b.factor, count(*) AS n, abs(corr(a.ic, b.ic)) AS c FROM ics a JOIN ics b ON a.date = b.date AND a.factor = 'x' AND b.factor <> 'x' WHERE a.ic IS NOT NULL AND b.ic IS NOT NULL GROUP BY b.factor) SELECT {r('CASE WHEN max(n) < 60 THEN -1e6 ELSE 1 - max(CASE WHEN n >= 60 THEN c END) END', 'novelty')} FROM c",
)
add("a47_residual_rank_ic", lambda s, d: E.daily_ic(X.regress(fp(s, d), "x", ["w"], out="res").withColumn("res", F.round("res", 9)), "res").select("date", "n", "rank_ic"), f"""WITH {FP}, u AS (SELECT *, round(x - (avg(x) OVER {D} + covar_pop(x, w) OVER {D} / var_pop(w) OVER {D} * (w - avg(w) OVER {D})), 9) AS res FROM panel),
  k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY res) + (count(*) OVER (PARTITION BY date, res) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS b FROM u WHERE res IS NOT NULL AND label IS NOT NULL)
  SELECT date, count(*) AS n, {r('CASE WHEN count(*) >= 3 THEN corr(a, b) END', 'rank_ic')} FROM k GROUP BY date""")
add(
    "a48_shortcoming_multiplier",
    lambda s, d: _shortcoming(fp(s, d).groupBy("instrument").agg(F.round(F.avg("x"), 9).alias("a"), F.round(F.avg("y"), 9).alias("b"))),
    f"WITH {FP}, m AS (SELECT instrument, round(avg(x), 9) AS a, round(avg(y), 9) AS b FROM panel GROUP BY instrument) SELECT instrument, {r('(0.5 + 0.5 * row_number() OVER (ORDER BY a, instrument) / count(*) OVER ()) * (0.5 + 0.5 * row_number() OVER (ORDER BY b, instrument) / count(*) OVER ())', 'multiplier')} FROM m",
)


def _shortcoming(m):
    n = F.count("*").over(Window.partitionBy())
    part = lambda c: 0.5 + 0.5 * F.row_number().over(Window.orderBy(c, "instrument")) / n
    return m.select("instrument", (part("a") * part("b")).alias("multiplier"))


add(
    "a49_behaviour_signature",
    lambda s, d: top_weights(s, d).groupBy("instrument").agg(F.count_if(F.col("weight") > 0).alias("n_long"), F.count_if(F.col("weight") < 0).alias("n_short")),
    f"WITH {FP} SELECT instrument, count_if(weight > 0) AS n_long, count_if(weight < 0) AS n_short FROM {WX} WHERE weight IS NOT NULL GROUP BY instrument",
)
add("a50_tail_overlap", lambda s, d: E.overlap_of_tails(fp(s, d), "x", "y"), f"WITH {FP}, t AS (SELECT date, percent_rank() OVER (PARTITION BY date ORDER BY x) >= 1 - 0.2 AS a, percent_rank() OVER (PARTITION BY date ORDER BY y) >= 1 - 0.2 AS b FROM panel) SELECT date, count_if(a) AS n_a, count_if(b) AS n_b, {r('CASE WHEN least(count_if(a), count_if(b)) > 0 THEN count_if(a AND b)::DOUBLE / least(count_if(a), count_if(b)) END', 'overlap')} FROM t GROUP BY date")
add("a52_feature_admission", lambda s, d: be(s, d).agg(F.avg(F.col("rate").isNotNull().cast("int")).alias("coverage"), F.count_distinct("rate").alias("n_distinct")).withColumn("admitted", (F.col("coverage") >= 0.3) & (F.col("n_distinct") > 1)), f"WITH {BE} SELECT {r('avg((rate IS NOT NULL)::INT)', 'coverage')}, count(DISTINCT rate) AS n_distinct, avg((rate IS NOT NULL)::INT) >= 0.3 AND count(DISTINCT rate) > 1 AS admitted FROM bars")
add("a53_prediction_coverage", lambda s, d: fp(s, d).filter("eligible").groupBy("date").agg((F.count("label") / F.count("*")).alias("coverage")), f"WITH {FP} SELECT date, {r('count(label)::DOUBLE / count(*)', 'coverage')} FROM panel WHERE eligible GROUP BY date")
add("a54_candidate_ranking", lambda s, d: E.candidate_order(fp(s, d).groupBy("instrument").agg(F.round(F.avg("x"), 9).alias("a"), F.round(F.avg("y"), 9).alias("b")), {"a": 0.6, "b": 0.4}, "instrument").select("instrument", "score", "place"), f"""WITH {FP}, m AS (SELECT instrument, round(avg(x), 9) AS a, round(avg(y), 9) AS b FROM panel GROUP BY instrument),
  s AS (SELECT instrument, 0.6 * (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 - 0.5) / count(*) OVER () + 0.4 * (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 - 0.5) / count(*) OVER () AS score FROM m)
  SELECT instrument, {r('score', 'score')}, row_number() OVER (ORDER BY score DESC, instrument) AS place FROM s""")
add(
    "a55_multi_horizon_excess",
    lambda s, d: _horizons(fp(s, d)),
    f"""WITH {FP}, h AS (SELECT unnest([1, 3, 6]) AS h), f AS (SELECT h, date, x, instrument, (SELECT 1) AS one, p.day FROM panel p, h), g AS (SELECT f.h, f.date, f.x, f.instrument, q.close / p.close - 1 AS r FROM f JOIN panel p ON p.instrument = f.instrument AND p.day = f.day JOIN panel q ON q.instrument = f.instrument AND q.day = f.day + f.h),
    k AS (SELECT *, percent_rank() OVER (PARTITION BY h, date ORDER BY x) AS pr FROM g), e AS (SELECT h, date, avg(CASE WHEN pr >= 0.8 THEN r END) - avg(r) AS excess FROM k GROUP BY h, date) SELECT h, count(excess) AS n, {r('avg(excess)', 'excess')} FROM e GROUP BY h""",
)


def _horizons(p):
    """Mean excess return of the top fifth over all, per horizon."""
    a = p.select("instrument", "date", "day", "x", "close", F.explode(F.array(*[F.lit(h) for h in (1, 3, 6)])).alias("h"))
    b = p.select("instrument", F.col("day").alias("later"), F.col("close").alias("close_later"))
    j = a.withColumn("later", F.col("day") + F.col("h")).join(b, ["instrument", "later"]).withColumn("r", F.col("close_later") / F.col("close") - 1)
    j = j.withColumn("pr", F.percent_rank().over(Window.partitionBy("h", "date").orderBy("x")))
    e = j.groupBy("h", "date").agg((F.avg(F.when(F.col("pr") >= 0.8, F.col("r"))) - F.avg("r")).alias("excess"))
    return e.groupBy("h").agg(F.count("excess").alias("n"), F.avg("excess").alias("excess"))


add("a60_yearly_metrics", lambda s, d: E.return_summary(market(s, d).withColumn("year", F.year("date")), ["year"], periods=12), f"WITH {MARKET}, y AS (SELECT *, year(date) AS year FROM series), {summary_sql('year', 'y', 12)}")
add(
    "a61_factor_style_r2",
    lambda s, d: X.regress(fp(s, d), "x", ["w", "y"], out="res").filter("res is not null").groupBy("date").agg(F.count("*").alias("n"), (1 - F.var_pop("res") / F.var_pop("x")).alias("r2")).filter("n >= 30"),
    f"""WITH {FP}, u AS (SELECT date, x - avg(x) OVER {D} AS b, w - avg(w) OVER {D} AS p, y - avg(y) OVER {D} AS q FROM panel),
    g AS (SELECT date, count(*) AS n, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(p * b) AS pb, sum(q * b) AS qb, sum(b * b) AS bb FROM u GROUP BY date)
    SELECT date, n, {r('((pb * qq - qb * pq) * pb + (qb * pp - pb * pq) * qb) / (pp * qq - pq * pq) / bb', 'r2')} FROM g WHERE n >= 30""",
)

# labels, weights, ledgers
add("b01_make_labels", lambda s, d: P.make_labels(be(s, d)).select("instrument", "date", "label"), f"WITH {BE} SELECT instrument, date, {r('max(open) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) / max(open) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - 1', 'label')} FROM bars")
add("b02_future_return_log", lambda s, d: be(s, d).select("instrument", "date", natural_log(divide(R.lead("close", 1), "close")).alias("value")), f"WITH {BE} SELECT instrument, date, {r('ln(max(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close)')} FROM bars")
add(
    "b03_ic_ir_weights", lambda s, d: P.ic_weights(all_ic(s, d), 12).select("factor", "date", "weight"),
    f"""WITH {ALL_IC}, w AS (SELECT *, avg(ic) OVER p AS m, stddev_samp(ic) OVER p AS sd, count(ic) OVER p AS k FROM ics WINDOW p AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, CASE WHEN k < 2 THEN 0 WHEN sd > 1e-12 THEN m / sd ELSE m END AS raw FROM w)
    SELECT factor, date, {r(f'CASE WHEN sum(abs(raw)) OVER {D} > 1e-12 THEN raw / sum(abs(raw)) OVER {D} ELSE 1.0 / count(*) OVER {D} END', 'weight')} FROM q""",
)
add(
    "b04_synthesize", lambda s, d: long_table(s, d).join(P.ic_weights(all_ic(s, d), 12), ["factor", "date"]).groupBy("instrument", "date").agg(F.sum(F.col("value") * F.col("weight")).alias("score")),
    f"""WITH {ALL_IC}, w AS (SELECT *, avg(ic) OVER p AS m, stddev_samp(ic) OVER p AS sd, count(ic) OVER p AS k FROM ics WINDOW p AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, CASE WHEN k < 2 THEN 0 WHEN sd > 1e-12 THEN m / sd ELSE m END AS raw FROM w), z AS (SELECT factor, date, CASE WHEN sum(abs(raw)) OVER {D} > 1e-12 THEN raw / sum(abs(raw)) OVER {D} ELSE 1.0 / count(*) OVER {D} END AS weight FROM q)
    SELECT instrument, date, {r('sum(v * weight)', 'score')} FROM l JOIN z USING (factor, date) GROUP BY ALL""",
)
LIMITS = {"gross": 0.8, "single": 0.02, "net": 0.3}
add(
    "b06_combine_and_limit", lambda s, d: P.limit_targets(P.combine(top_weights(s, d).withColumn("sleeve", F.lit("a")).unionByName(top_weights(s, d, "y").withColumn("sleeve", F.lit("b"))), {"a": 0.7, "b": 0.3}), LIMITS).select("date", "instrument", "weight", "scale", "binding"),
    f"""WITH {FP}, t AS (SELECT date, instrument, 0.7 * weight AS w FROM {WX} WHERE weight IS NOT NULL UNION ALL SELECT date, instrument, 0.3 * weight FROM {WY} WHERE weight IS NOT NULL), c AS (SELECT date, instrument, sum(w) AS w FROM t GROUP BY ALL),
    e AS (SELECT date, 0.8 / sum(abs(w)) AS g, 0.02 / max(abs(w)) AS s, CASE WHEN abs(sum(w)) > 1e-12 THEN 0.3 / abs(sum(w)) ELSE 'Infinity'::DOUBLE END AS n FROM c GROUP BY date), k AS (SELECT *, least(1, g, s, n) AS scale FROM e)
    SELECT c.date, instrument, {r('w * scale', 'weight')}, {r('scale', 'scale')}, CASE WHEN scale >= 1 THEN 'none' WHEN g <= scale THEN 'gross' WHEN s <= scale THEN 'single' WHEN n <= scale THEN 'net' END AS binding FROM c JOIN k USING (date)""",
)
add("b05_member_targets", lambda s, d: P.member_targets(fp(s, d), "label", 60, top_weights(s, d)).select("date", "instrument", "weight", "reason"), f"WITH {FP}, q AS (SELECT date, CASE WHEN count(label) < 60 THEN 'too_few' WHEN coalesce(max(label) - min(label), 0) <= 1e-12 THEN 'no_spread' ELSE 'valid' END AS reason FROM panel GROUP BY date) SELECT date, instrument, {r('CASE WHEN reason = ' + chr(39) + 'valid' + chr(39) + ' THEN weight ELSE 0 END', 'weight')}, reason FROM {WX} JOIN q USING (date) WHERE weight IS NOT NULL")
add("b07_composite_targets", lambda s, d: X.target_weights(X.assign_groups(X.composite(fp(s, d), {"x": 0.5, "y": 0.5}, "c").withColumn("c", F.round("c", 9)), "c", 5, "g"), "g").filter("value <> 0").select("date", "instrument", F.col("value").alias("weight")), f"WITH {FP}, z AS (SELECT *, round(0.5 * (x - avg(x) OVER {D}) / stddev_pop(x) OVER {D} + 0.5 * (y - avg(y) OVER {D}) / stddev_pop(y) OVER {D}, 9) AS c FROM panel) SELECT date, instrument, {r('weight', 'weight')} FROM {_weights_sql('c').replace('FROM panel', 'FROM z')} WHERE weight IS NOT NULL")
add("b10_exposure_map", lambda s, d: fp(s, d).select("instrument", "date", P.exposure("label", 0.2, 1.0).alias("exposure")), f"WITH {FP} SELECT instrument, date, {r('CASE WHEN label IS NOT NULL THEN greatest(least(0.2 + 0.8 * (label + 1) / 2, 1.0), 0.2) END', 'exposure')} FROM panel")
_TURN = f"""{FP}, t AS (SELECT date, row_number() OVER (ORDER BY date) AS turn FROM (SELECT DISTINCT date FROM {WX} WHERE weight IS NOT NULL)), w AS (SELECT turn, instrument, weight FROM {WX} JOIN t USING (date) WHERE weight IS NOT NULL),
  mv AS (SELECT coalesce(a.turn, b.turn + 1) AS turn, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS move FROM w a FULL JOIN w b ON b.turn + 1 = a.turn AND b.instrument = a.instrument),
  tv AS (SELECT date, t.turn, sum(abs(move)) AS turnover, count_if(abs(move) > 1e-12) AS n_traded FROM mv JOIN t USING (turn) GROUP BY ALL)"""
add("b13_turnover_fees", lambda s, d: P.turnover(top_weights(s, d)).withColumn("fee", F.col("turnover") * 0.0005).drop("turn"), f"WITH {_TURN} SELECT date, {r('turnover', 'turnover')}, n_traded, {r('turnover * 0.0005', 'fee')} FROM tv")
_LEDGER = f"""{_TURN}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel)), h AS (SELECT d.k + 1 AS k, x.instrument, x.weight FROM {WX} x JOIN d USING (date) WHERE weight IS NOT NULL),
  gr AS (SELECT h.k, sum(weight * coalesce(ret, 0)) AS gross FROM h JOIN d USING (k) LEFT JOIN panel p ON p.date = d.date AND p.instrument = h.instrument GROUP BY h.k),
  lg AS (SELECT d.date, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover FROM d LEFT JOIN gr USING (k) LEFT JOIN tv ON tv.date = d.date), n AS (SELECT *, gross - turnover * 0.0015 AS net FROM lg), wl AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY date)) AS wealth FROM n)"""
add("b14_return_ledger", lambda s, d: P.ledger(top_weights(s, d), fp(s, d).select("date", "instrument", "ret"), 0.0015), f"WITH {_LEDGER} SELECT date, {r('gross', 'gross')}, {r('turnover', 'turnover')}, {r('turnover * 0.0015', 'cost')}, {r('net', 'net')}, {r('wealth', 'wealth')}, {r('wealth / greatest(max(wealth) OVER (ORDER BY date), 1) - 1', 'drawdown')} FROM wl")
add("a17_mean_turnover", lambda s, d: P.ledger(top_weights(s, d), fp(s, d).select("date", "instrument", "ret"), 0.0015).agg(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))).alias("mean_turnover"), F.sum("cost").alias("total_cost")), f"WITH {_LEDGER} SELECT {r('avg(CASE WHEN turnover > 0 THEN turnover END)', 'mean_turnover')}, {r('sum(turnover * 0.0015)', 'total_cost')} FROM wl")
add("a51_cost_totals_by_scenario", lambda s, d: P.ledger(top_weights(s, d), fp(s, d).select("date", "instrument", "ret"), 1.0).withColumn("scenario", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)]))).groupBy("scenario").agg((F.sum("turnover") * F.max("scenario") * 0.0015).alias("cost")), f"WITH {_LEDGER} SELECT s AS scenario, {r('sum(turnover) * max(s) * 0.0015', 'cost')} FROM lg, (SELECT unnest([1, 2, 3]) AS s) GROUP BY s")
add(
    "a56_stressed_costs",
    lambda s, d: P.ledger(top_weights(s, d), fp(s, d).select("date", "instrument", "ret"), 0.0).withColumn("stress", F.explode(F.array(*[F.lit(x) for x in (1.0, 2.0)]))).withColumn("ret", F.round(F.col("gross") - F.col("turnover") * 0.0015 * F.col("stress"), 9)).groupBy("stress").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("total_return"), F.count_if(F.col("ret") > 0).alias("n_positive")),
    f"WITH {_LEDGER}, s AS (SELECT s AS stress, round(gross - turnover * 0.0015 * s, 9) AS ret FROM lg, (SELECT unnest([1.0, 2.0])::DOUBLE AS s)) SELECT {r('stress', 'stress')}, {r('exp(sum(ln(1 + ret))) - 1', 'total_return')}, count_if(ret > 0) AS n_positive FROM s GROUP BY stress",
)
add("b15_orders", lambda s, d: P.orders(top_weights(s, d), fp(s, d).select("instrument", "date", "close"), 0.0005, 0.001), f"""WITH {FP}, q AS (SELECT x.date, x.instrument, close, weight / close AS q FROM {WX} x JOIN panel USING (date, instrument) WHERE weight IS NOT NULL), o AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY instrument ORDER BY date), 0) AS o FROM q)
  SELECT date, instrument, CASE WHEN o > 0 THEN 'buy' ELSE 'sell' END AS side, {r('o', 'order_quantity')}, {r('abs(o) * close', 'notional')}, {r('abs(o) * close * 0.0005', 'fee')}, {r('abs(o) * close * 0.001', 'slippage')} FROM o WHERE abs(o) > 1e-12""")
add("b16_funding_on_weights", lambda s, d: top_weights(s, d).join(fp(s, d).select("date", "instrument", "funding"), ["date", "instrument"]).groupBy("date").agg(F.sum(-F.col("weight") * F.col("funding")).alias("cash")), f"WITH {FP} SELECT x.date, {r('sum(-weight * funding)', 'cash')} FROM {WX} x JOIN panel USING (date, instrument) WHERE weight IS NOT NULL GROUP BY x.date")
add("b17_benchmark_comparison", lambda s, d: fp(s, d).filter("ret is not null").select("instrument", "date", F.col("ret").alias("own")).join(market(s, d).withColumnRenamed("ret", "benchmark"), "date").withColumn("excess", F.col("own") - F.col("benchmark")), f"WITH {MARKET} SELECT p.instrument, p.date, {r('p.ret', 'own')}, {r('s.ret', 'benchmark')}, {r('p.ret - s.ret', 'excess')} FROM panel p JOIN series s USING (date) WHERE p.ret IS NOT NULL")
add(
    "b18_signal_export", lambda s, d: top_weights(s, d).withColumn("last", F.max("date").over(Window.partitionBy())).filter("date = last").select("instrument", F.lit("rebalance").alias("action"), "weight", F.sha2(F.concat_ws("|", F.col("date").cast("string"), F.col("instrument").cast("string")), 256).alias("content_id")),
    f"WITH {FP}, w AS (SELECT * FROM {WX} WHERE weight IS NOT NULL) SELECT instrument, 'rebalance' AS action, {r('weight', 'weight')}, sha256(date::VARCHAR || '|' || instrument::VARCHAR) AS content_id FROM w WHERE date = (SELECT max(date) FROM w)",
)

# sorts, top-k, sets, utilities
add("k02_top_n_equal_weight", lambda s, d: P.top_n_equal(fp(s, d), "x", 10, 3, "eligible"), f"WITH {FP}, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM panel)), c AS (SELECT date, instrument FROM panel JOIN t USING (date) WHERE k % 3 = 0 AND eligible QUALIFY row_number() OVER (PARTITION BY date ORDER BY x DESC, instrument) <= 10) SELECT date, instrument, {r(f'1.0 / count(*) OVER {D}', 'weight')} FROM c")
add("k03_short_list", lambda s, d: P.short_list(fp(s, d), {"x": 1, "y": -1}, 10).select("date", "instrument", "score", "place"), f"WITH {FP}, s AS (SELECT date, instrument, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 + rank() OVER (PARTITION BY date ORDER BY -y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS score FROM panel) SELECT date, instrument, {r('score', 'score')}, row_number() OVER (PARTITION BY date ORDER BY score, instrument) AS place FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY score, instrument) <= 10")
add("k05_quantile_membership", lambda s, d: fp(s, d).withColumn("p", F.percent_rank().over(Window.partitionBy("date").orderBy("x"))).withColumn("n", F.count("*").over(X.by_date())).filter("p >= 0.9 and n >= 10").select("date", "instrument"), f"WITH {FP} SELECT date, instrument FROM panel QUALIFY percent_rank() OVER (PARTITION BY date ORDER BY x) >= 0.9 AND count(*) OVER {D} >= 10")
add("k06_dedupe_keep_latest", lambda s, d: views.flows_ev(s, d).groupBy("instrument", "date").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")), f"WITH {FL} SELECT instrument, date, max_by(event_id, (ts, event_id)) AS event_id FROM flows GROUP BY ALL")
_AVG = f"{FP}, m AS (SELECT instrument, round(avg(x), 9) AS a, round(avg(y), 9) AS b FROM panel GROUP BY instrument), front AS (SELECT * FROM m p WHERE NOT EXISTS (SELECT 1 FROM m q WHERE q.a >= p.a AND q.b >= p.b AND (q.a > p.a OR q.b > p.b)))"


def front(s, d):
    return E.pareto_front(fp(s, d).groupBy("instrument").agg(F.round(F.avg("x"), 9).alias("a"), F.round(F.avg("y"), 9).alias("b")), "instrument", ["a", "b"])


add("k07_pareto_front", lambda s, d: front(s, d).select("instrument", "a", "b"), f"WITH {_AVG} SELECT instrument, {r('a', 'a')}, {r('b', 'b')} FROM front")
add("k07_crowding_distance", lambda s, d: P.crowding(front(s, d), ["a", "b"], "instrument").select("instrument", F.least("crowding", F.lit(1e9)).alias("crowding")), f"WITH {_AVG} SELECT instrument, {r('least(coalesce((lead(a) OVER (ORDER BY a, instrument) - lag(a) OVER (ORDER BY a, instrument)) / (max(a) OVER () - min(a) OVER ()), 1e9) + coalesce((lead(b) OVER (ORDER BY b, instrument) - lag(b) OVER (ORDER BY b, instrument)) / (max(b) OVER () - min(b) OVER ()), 1e9), 1e9)', 'crowding')} FROM front")
add("k11_union", lambda s, d: be(s, d).filter("day % 2 = 0").select("instrument", "date").unionByName(be(s, d).filter("day % 2 = 1").select("instrument", "date")), f"WITH {BE} SELECT instrument, date FROM bars")
add("k12_intersection", lambda s, d: be(s, d).filter("trade_count > 1").select("instrument", "date").intersect(be(s, d).filter("rate is not null").select("instrument", "date")), f"WITH {BE} SELECT instrument, date FROM bars WHERE trade_count > 1 INTERSECT SELECT instrument, date FROM bars WHERE rate IS NOT NULL")
add("k13_difference", lambda s, d: be(s, d).select("instrument", "date").exceptAll(be(s, d).filter("rate is not null").select("instrument", "date")), f"WITH {BE} SELECT instrument, date FROM bars WHERE rate IS NULL")
add("k01_stable_sort_position", lambda s, d: be(s, d).select("instrument", "date", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("volume"), "date")).alias("position")), f"WITH {BE} SELECT instrument, date, row_number() OVER (PARTITION BY instrument ORDER BY volume DESC, date) AS position FROM bars")
add("k04_universe_head", lambda s, d: E.top_n_by_date(views.members_ev(s, d).select("instrument", F.col("effective_date").alias("date"), "score"), "score", 50).select("instrument", "date", "position"), f"WITH {ME} SELECT instrument, effective_date AS date, row_number() OVER (PARTITION BY effective_date ORDER BY score DESC, instrument) AS position FROM members QUALIFY row_number() OVER (PARTITION BY effective_date ORDER BY score DESC, instrument) <= 50")
_SPINE = f"{BE}, spine AS (SELECT instrument, date FROM (SELECT DISTINCT instrument FROM bars), (SELECT unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY))::DATE AS date))"
add("u01_calendar_spine", lambda s, d: P.calendar_spine(be(s, d)).join(be(s, d).select("instrument", "date", "close"), ["instrument", "date"], "left"), f"WITH {_SPINE} SELECT instrument, date, {r('close', 'close')} FROM spine LEFT JOIN bars USING (instrument, date)")
add("u02_forward_fill", lambda s, d: P.calendar_spine(be(s, d)).join(be(s, d).select("instrument", "date", "close"), ["instrument", "date"], "left").select("instrument", "date", F.last("close", ignorenulls=True).over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("close")), f"WITH {_SPINE} SELECT instrument, date, {r('last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'close')} FROM spine LEFT JOIN bars USING (instrument, date)")
add("u03_exact_table_equality", lambda s, d: (a := be(s, d).select("instrument", "date", "close", "rate")).exceptAll(be(s, d).filter("day % 11 > 0").select("instrument", "date", "close", "rate")).agg(F.count("*").alias("n_differ")), f"WITH {BE} SELECT count(*) AS n_differ FROM bars WHERE day % 11 = 0")
add("u04_panel_fingerprint", lambda s, d: E.fingerprint(be(s, d)), None)
add(
    "u06_cutoff_replay",
    lambda s, d: J.compare_prefix(
        be(s, d).select("instrument", "date", R.ts_mean("close", 5).alias("value")).filter("date <= date'2024-01-20'"),
        be(s, d).filter("date <= date'2024-01-20'").select("instrument", "date", R.ts_mean("close", 5).alias("value")), ["instrument", "date"],
    ),
    f"WITH {BE} SELECT count(*) AS n_keys, 0::BIGINT AS n_one_side, 0::BIGINT AS n_null_mismatch, 0::BIGINT AS n_value_mismatch, CASE WHEN count(*) > 0 THEN {r('0', 'max_difference').split(' AS ')[0]} END AS max_difference FROM bars WHERE date <= DATE '2024-01-20'",
)
