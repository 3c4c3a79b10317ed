"""Further jobs: masks and audits, selection gates, stability of parameters and horizons, path-dependent states."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quantloom import views
from quantloom.ml import panel as L
from quantloom.operators import cross_section as X, evaluation as E, intraday as M, joins as J, portfolio as P, rolling as R
from quantloom.plans import catalogue, formula
from quantloom.queries.common import add, over, r
from quantloom.queries.evaluation import ALL_IC, D, FP, WX, _LEDGER, _weights_sql, all_ic, fp, outer_weights, top_weights
from quantloom.queries.tables import FACTORS, model_data
from quantloom.sources import tables
from quantloom.streaming import jobs

BE, FL, MO = views.BARS_EV, views.FLOWS_EV, views.BARS_MO


def be(s, d):
    return views.bars_ev(s, d)


_SPINE = f"{BE}, spine AS (SELECT instrument, date FROM (SELECT DISTINCT instrument FROM bars), (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-15', INTERVAL 1 DAY))::DATE AS date))"
add("p01_field_on_calendar", lambda s, d: P.calendar_spine(be(s, d)).filter("date between date'2024-01-05' and date'2024-01-15'").join(be(s, d).select("instrument", "date", "close"), ["instrument", "date"], "left"), f"WITH {_SPINE} SELECT instrument, date, {r('close', 'close')} FROM spine LEFT JOIN bars USING (instrument, date)")
add("p02_daily_funding_field", lambda s, d: be(s, d).select("instrument", "date", (F.col("rate") / F.col("trade_count")).alias("value")), f"WITH {BE} SELECT instrument, date, {r('rate / trade_count')} FROM bars")
add("p03_mask_after_windows", lambda s, d: be(s, d).withColumn("m", R.ts_mean("close", 3)).select("instrument", "date", F.when(F.col("trade_count") > 1, F.col("m")).alias("value")), f"WITH {BE} SELECT instrument, date, {r(f'CASE WHEN trade_count > 1 THEN CASE WHEN count(close) OVER {over(3)} >= 3 THEN avg(close) OVER {over(3)} END END')} FROM bars")
add("p04_quality_mask", lambda s, d: be(s, d).select("instrument", "date", (F.coalesce(F.col("rate") > 0.05, F.lit(False)) & ~F.coalesce(F.col("high") == F.col("low"), F.lit(True))).alias("good")), f"WITH {BE} SELECT instrument, date, coalesce(rate > 0.05, false) AND NOT coalesce(high = low, true) AS good FROM bars")
add("p06_price_validity", lambda s, d: views.flows_ev(s, d).select("event_id", (F.col("rate").isNotNull() & ~F.isnan("rate") & (F.col("rate") > 0.001)).alias("valid")), f"WITH {FL} SELECT event_id, rate IS NOT NULL AND rate > 0.001 AS valid FROM flows")
add("p07_asset_exclusion", lambda s, d: views.read(s, d, "customer").join(views.read(s, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
add("p10_date_clip", lambda s, d: views.flows_ev(s, d).filter("ts >= timestamp'2024-01-03 12:00:00' and ts <= timestamp'2024-01-09 00:00:00'").select("event_id"), f"WITH {FL} SELECT event_id FROM flows WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts <= TIMESTAMP '2024-01-09 00:00:00'")
add("p14_conditional", lambda s, d: be(s, d).select("instrument", "date", F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(-F.col("volume")).alias("value")), f"WITH {BE} SELECT instrument, date, {r('CASE WHEN close > open THEN volume ELSE -volume END')} FROM bars")
add("s11_factor_csvs", lambda s, d: _csv(s, d), f"WITH {FP} SELECT date, instrument, {r('x', 'factor')} FROM panel")


def _csv(s, d):
    """Write a factor as CSV files and scan them with a schema."""
    at = tables.scratch(s, "factor-csv")
    fp(s, d).select("date", "instrument", F.col("x").alias("factor"), F.lit("more").alias("extra")).write.csv(at, header=True)
    return tables.read_csvs(s, at, "date date, instrument long, factor double, extra string").select("date", "instrument", "factor")


add(
    "s08_upsert_business_columns",
    lambda s, d: tables.upsert(be(s, d).select("instrument", "date", "close", F.lit(1).alias("source")), be(s, d).filter("day % 2 = 0").select("instrument", "date", F.when(F.col("day") % 4 == 0, F.col("close") + 1).otherwise(F.col("close")).alias("close"), F.lit(2).alias("source")), ["instrument", "date"], ["close"]),
    f"WITH {BE} SELECT instrument, date, {r('CASE WHEN day % 4 = 0 THEN close + 1 ELSE close END', 'close')}, CASE WHEN day % 4 = 0 THEN 2 ELSE 1 END AS source FROM bars",
)
add("s23_partitioned_predictions_sink", lambda s, d: _sink(s, d), f"WITH {FP} SELECT date_trunc('quarter', date)::DATE AS quarter, count(*) AS n, {r('sum(x)', 'total')} FROM panel GROUP BY 1")


def _sink(s, d):
    """Predictions by quarter into immutable partitions, then one partition-pruned aggregate."""
    at = tables.scratch(s, "predictions")
    p = fp(s, d).withColumn("quarter", F.to_date(F.date_trunc("quarter", "date")))
    p.select("instrument", "date", "x", "quarter").write.partitionBy("quarter").mode("errorifexists").parquet(at)
    return s.read.parquet(at).groupBy("quarter").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


add("s24_absent_optional_field", lambda s, d: _optional(be(s, d), ["close", "open_interest"]), f"WITH {BE} SELECT instrument, date, {r('close', 'close')}, {r('NULL', 'open_interest')} FROM bars")


def _optional(df, fields):
    """Fields that a table may lack come as nulls."""
    return df.select("instrument", "date", *[F.col(f).cast("double").alias(f) if f in df.columns else F.lit(None).cast("double").alias(f) for f in fields])


add(
    "j21_order_table_comparison",
    lambda s, d: (o := P.orders(top_weights(s, d), fp(s, d).select("instrument", "date", "close"), 0.0005, 0.001)).select("date", "instrument", "side", F.col("notional").alias("a")).join(o.filter("notional > 0.001").select("date", "instrument", "side", (F.col("notional") + 0.0001).alias("b")), ["date", "instrument", "side"], "full_outer").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.abs(F.col("a") - F.col("b")) > 0.01).alias("differ")),
    f"WITH {FP}, q AS (SELECT x.date, x.instrument, close, weight / close AS q FROM {WX} x JOIN panel USING (date, instrument) WHERE weight IS NOT NULL), o AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY instrument ORDER BY date), 0) AS o FROM q) SELECT count(*) FILTER (WHERE abs(o) * close <= 0.001) AS missing, 0::BIGINT AS differ FROM o WHERE abs(o) > 1e-12",
)
add("r22_market_model_residual_volatility", lambda s, d: formula.evaluate(views.bars_mo(s, d), {"value": catalogue.FACTORS["idio_vol"].formula}), formula.sql(MO, {"value": catalogue.FACTORS["idio_vol"].formula}))
add("r23_extreme_days_split", lambda s, d: formula.evaluate(views.bars_mo(s, d), {"value": catalogue.FACTORS["momentum_volume_extreme"].formula}), formula.sql(MO, {"value": catalogue.FACTORS["momentum_volume_extreme"].formula}))
_RES = f"u AS (SELECT *, round(x - (avg(x) OVER {D} + covar_pop(x, w) OVER {D} / var_pop(w) OVER {D} * (w - avg(w) OVER {D})), 9) AS res FROM panel)"


def _two_ics(p, a, b):
    """Mean rank ICs by quarter of two factors on the cells that both have."""
    p = p.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("label").isNotNull())
    x, y = E.daily_ic(p, a).select("date", F.col("rank_ic").alias("raw")), E.daily_ic(p, b).select("date", F.col("rank_ic").alias("residual"))
    return x.join(y, "date").groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("quarter")).agg(F.avg("raw").alias("raw"), F.avg("residual").alias("residual"))


add(
    "r09_exposure_residual_assessment", lambda s, d: _two_ics(X.regress(fp(s, d), "x", ["w"], out="res").withColumn("res", F.round("res", 9)), "x", "res"),
    f"""WITH {FP}, {_RES}, v AS (SELECT * FROM u WHERE res IS NOT NULL AND label IS NOT NULL), k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY res) + (count(*) OVER (PARTITION BY date, res) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl FROM v),
    i AS (SELECT date, corr(rx, rl) AS a, corr(rr, rl) AS b FROM k GROUP BY date) SELECT date_trunc('quarter', date)::DATE AS quarter, {r('avg(a)', 'raw')}, {r('avg(b)', 'residual')} FROM i GROUP BY 1""",
)
add("m12_style_residual_features", lambda s, d: X.regress(fp(s, d), "ret", ["x", "y", "w"], ridge=1e-6).select("instrument", "date", "value"))
add(
    "a45_five_objective_score",
    lambda s, d: _objectives(s, d),
    f"""WITH {_LEDGER}, k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl FROM panel WHERE label IS NOT NULL), i AS (SELECT date, corr(rx, rl) AS ic FROM k GROUP BY date HAVING count(*) >= 20)
    SELECT (SELECT {r('avg(ic)', 'v').removesuffix(' AS v')} FROM i) AS rank_ic, (SELECT {r('avg(ic) / stddev_samp(ic)', 'v').removesuffix(' AS v')} FROM i) AS ic_ir, {r('greatest(0, avg(turnover) - 0.5)', 'turnover_excess')}, {r('avg(net) / stddev_samp(net)', 'sharpe')}, {r('1 + min(dd)', 'one_less_drawdown')} FROM (SELECT *, wealth / greatest(max(wealth) OVER (ORDER BY date), 1) - 1 AS dd FROM wl)""",
)


def _objectives(s, d):
    """Rank IC, its ratio, excess turnover, net Sharpe ratio and one less the drawdown of a long-short factor: one row."""
    ic = E.daily_ic(fp(s, d)).filter("n >= 20").agg(F.avg("rank_ic").alias("rank_ic"), F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("ic_ir"))
    led = P.ledger(top_weights(s, d), fp(s, d).select("date", "instrument", "ret"), 0.0015)
    m = led.agg(F.greatest(F.lit(0.0), F.avg("turnover") - 0.5).alias("turnover_excess"), F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sharpe"), (1 + F.min("drawdown")).alias("one_less_drawdown"))
    return ic.crossJoin(m)  # a row and a row


add(
    "a58_score_with_all_costs",
    lambda s, d: P.ledger(top_weights(s, d), fp(s, d).select("date", "instrument", "ret"), 0.0015).groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("quarter")).agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("net_return"), F.sum("cost").alias("cost")),
    f"WITH {_LEDGER} SELECT date_trunc('quarter', date)::DATE AS quarter, {r('exp(sum(ln(1 + net))) - 1', 'net_return')}, {r('sum(turnover * 0.0015)', 'cost')} FROM wl GROUP BY 1",
)
add(
    "a59_horizon_execution",
    lambda s, d: _by_interval(s, d, (1, 2, 3)),
    f"""WITH {FP}, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM panel)), c AS (SELECT s.step, p.date, avg(label) AS r FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY date ORDER BY x DESC, instrument) <= 10) p JOIN t USING (date), (SELECT unnest([1, 2, 3]) AS step) s WHERE t.k % s.step = 0 GROUP BY ALL)
    SELECT step, count(r) AS n, {r('avg(r)', 'mean')} FROM c GROUP BY step""",
)


def _by_interval(s, d, steps):
    """Mean next return of the ten largest, held from every step-th date."""
    p = fp(s, d)
    dates = p.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)
    top = p.withColumn("n", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("x"), "instrument"))).filter("n <= 10").join(F.broadcast(dates), "date")  # a row per date
    top = top.withColumn("step", F.explode(F.array(*[F.lit(x) for x in steps]))).filter("k % step = 0")
    return top.groupBy("step", "date").agg(F.avg("label").alias("r")).groupBy("step").agg(F.count("r").alias("n"), F.avg("r").alias("mean"))


add(
    "k09_validation_gates",
    lambda s, d: all_ic(s, d).groupBy("factor").agg(F.avg("ic").alias("m"), F.count("ic").alias("n"), F.avg((F.col("ic") > 0).cast("int")).alias("p")).select("factor", F.array_join(F.filter(F.array(F.when(F.col("m") <= 0, "negative"), F.when(F.col("n") < 60, "few_days"), F.when(F.col("p") < 0.5, "unsteady")), lambda x: x.isNotNull()), ",").alias("reasons")).withColumn("accepted", F.col("reasons") == ""),
    f"WITH {ALL_IC}, m AS (SELECT factor, avg(ic) AS m, count(ic) AS n, avg((ic > 0)::INT) AS p FROM ics GROUP BY factor), q AS (SELECT factor, concat_ws(',', CASE WHEN m <= 0 THEN 'negative' END, CASE WHEN n < 60 THEN 'few_days' END, CASE WHEN p < 0.5 THEN 'unsteady' END) AS reasons FROM m) SELECT factor, reasons, reasons = '' AS accepted FROM q",
)
add(
    "k10_farthest_points", lambda s, d: _farthest(s, d, 3),
    f"""WITH {ALL_IC}, g AS (SELECT a.factor AS f, b.factor AS o, sqrt(sum((a.ic - b.ic) * (a.ic - b.ic))) AS gap FROM ics a JOIN ics b USING (date) GROUP BY ALL), one AS (SELECT min(f) AS f FROM g),
    two AS (SELECT f FROM g WHERE o = (SELECT f FROM one) AND f <> o ORDER BY gap DESC, f DESC LIMIT 1)
    SELECT 0 AS place, f AS factor FROM one UNION ALL SELECT 1, f FROM two UNION ALL SELECT 2, f FROM (SELECT DISTINCT f FROM g) WHERE f NOT IN (SELECT f FROM one UNION ALL SELECT f FROM two)""",
)


def _farthest(s, d, k):
    """Factors whose daily ICs lie farthest apart, one after another; the distance table has a row per pair of factors."""
    a, b = (all_ic(s, d).select("date", F.col("factor").alias(f"f{x}"), F.col("ic").alias(x)) for x in "ab")
    gap = {(r_.fa, r_.fb): r_.g for r_ in a.join(b, "date").groupBy("fa", "fb").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("g")).collect()}
    names = sorted({x for p in gap for x in p})
    chosen = names[:1]
    while len(chosen) < min(k, len(names)):
        chosen.append(max((n for n in names if n not in chosen), key=lambda n: (min(gap[n, c] or 0 for c in chosen), n)))
    return s.createDataFrame(list(enumerate(chosen)), "place int, factor string")


add(
    "g28_walk_forward_folds", lambda s, d: _folds(s, d),
    f"""WITH {FP}, q AS (SELECT unnest(generate_series(date_trunc('quarter', (SELECT min(date) FROM panel)), (SELECT max(date) FROM panel), INTERVAL 3 MONTH))::DATE AS q),
    f AS (SELECT q AS test_from, (q - INTERVAL 36 MONTH)::DATE AS train_from FROM q WHERE q - INTERVAL 36 MONTH >= (SELECT min(q) FROM q))
    SELECT train_from, test_from, count(*) FILTER (WHERE date < test_from) AS n_train, count(*) FILTER (WHERE date >= test_from) AS n_test FROM f JOIN panel ON date >= train_from AND date < test_from + INTERVAL 3 MONTH GROUP BY ALL""",
)


def _folds(s, d):
    """Rows of each walk-forward fold over the panel's range: the folds are a small table, the counts a range join on dates."""
    b = fp(s, d).agg(F.min("date"), F.max("date")).first()
    folds = s.createDataFrame(L.quarter_folds(str(b[0]), str(b[1]), 12), "train_from string, test_from string, test_to string").select(*[F.to_date(c).alias(c) for c in ("train_from", "test_from", "test_to")])
    dates = fp(s, d).groupBy("date").agg(F.count("*").alias("k"))
    j = dates.join(F.broadcast(folds), (F.col("date") >= F.col("train_from")) & (F.col("date") <= F.col("test_to")))  # a row per quarter
    return j.groupBy("train_from", "test_from").agg(F.sum(F.when(F.col("date") < F.col("test_from"), F.col("k")).otherwise(0)).alias("n_train"), F.sum(F.when(F.col("date") >= F.col("test_from"), F.col("k")).otherwise(0)).alias("n_test"))


add("x01_high_watermark", lambda s, d: E.longest_prefix(_full_days(be(s, d))).select(F.date_add(F.date_from_unix_date(F.col("last_day").cast("int")), 1).alias("next_fetch"), "n_days"), f"WITH {BE}, c AS (SELECT day, count(*) AS n FROM bars GROUP BY day), g AS (SELECT day FROM c WHERE n >= 0.9 * (SELECT avg(n) FROM c)), i AS (SELECT day, day - row_number() OVER (ORDER BY day) AS i FROM g), q AS (SELECT min(day) AS a, max(day) AS b, count(*) AS n_days FROM i GROUP BY i) SELECT DATE '1970-01-01' + b + 1 AS next_fetch, n_days FROM q WHERE a = (SELECT min(day) FROM g)")


def _full_days(bars):
    """Days with at least nine tenths of the mean number of bars: one row per day at any size."""
    n = bars.groupBy("day").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).filter("n >= 0.9 * mean").select("day")  # one row


add("x08_stream_checkpoints", lambda s, d: _checkpoints(s, d), "SELECT user_id AS instrument, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id")


def _checkpoints(s, d):
    """Per-symbol progress kept by a stream: each batch writes a snapshot of it, from the one before."""
    at = jobs.run_batches(jobs.source(s, f"{d}/events.parquet").select("user_id", "event_id"), "progress", jobs.progress)
    return jobs.newest(s, at, jobs.PROGRESS)


add("l06_prepare_fold", lambda s, d: model_data(s, d).filter("date < date'1997-01-01' and target is not null and present").groupBy("date").agg(F.count("*").alias("n")).filter("n >= 20"), f"WITH {FP}, t AS (SELECT *, CASE WHEN count(label) OVER {D} >= 20 THEN label END AS target FROM panel) SELECT date, count(*) AS n FROM t WHERE eligible AND target IS NOT NULL AND date < DATE '1997-01-01' GROUP BY date HAVING count(*) >= 20")
add(
    "l12_symbol_features",
    lambda s, d: formula.evaluate(views.bars_mo(s, d), {k: formula.call("lag", catalogue.FACTORS[k].formula, params=(1,)) for k in ("rsi_quote", "ma_cross_trend", "price_path_efficiency", "intraday_accumulation_distribution")}),
    formula.sql(MO, {k: formula.call("lag", catalogue.FACTORS[k].formula, params=(1,)) for k in ("rsi_quote", "ma_cross_trend", "price_path_efficiency", "intraday_accumulation_distribution")}),
)
add(
    "l14_ic_stability_selector",
    lambda s, d: all_ic(s, d).withColumn("year", F.year("date")).groupBy("factor", "year").agg(F.avg("ic").alias("m")).groupBy("factor").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.avg((F.col("m") > 0).cast("int")).alias("positive")),
    f"WITH {ALL_IC}, y AS (SELECT factor, year(date) AS y, avg(ic) AS m FROM ics GROUP BY ALL) SELECT factor, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'sd')}, {r('avg((m > 0)::INT)', 'positive')} FROM y GROUP BY factor",
)
add(
    "l17_stage_audit",
    lambda s, d: be(s, d).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("close", "rate")], F.count_if(F.col("high") == F.col("low")).alias("flat"), F.count_if(F.col("day") < 19728).alias("warmup")),
    f"WITH {BE} SELECT count(*) AS n_rows, count(*) FILTER (WHERE close IS NULL) AS missing_close, count(*) FILTER (WHERE rate IS NULL) AS missing_rate, count(*) FILTER (WHERE high = low) AS flat, count(*) FILTER (WHERE day < 19728) AS warmup FROM bars",
)
add("l11_expanding_splits", lambda s, d: fp(s, d).withColumn("split", F.explode(F.array(*[F.lit(y) for y in (1995, 1996, 1997)]))).groupBy("split").agg(F.count_if(F.year("date") < F.col("split")).alias("n_train"), F.count_if(F.year("date") == F.col("split")).alias("n_test")), f"WITH {FP} SELECT k.split, count(*) FILTER (WHERE year(date) < k.split) AS n_train, count(*) FILTER (WHERE year(date) = k.split) AS n_test FROM panel, (SELECT unnest([1995, 1996, 1997]) AS split) k GROUP BY k.split")


def _validated(s, d):
    p = tables.staged(fp(s, d).select("date", "instrument", "x", "y", "label", "ret"), "panel")
    cells = lambda x: p.select("date", "instrument", "label", F.col(x).alias("factor")).withColumn("factor", F.when(F.col("instrument") % 50 > 0, F.col("factor")))
    returns = p.select("date", "instrument", "ret")
    one, two = (L.score_validation(cells(x), returns, tables.staged(outer_weights(p, x), "weights"), 0.0015, 0.9, x) for x in ("x", "y"))
    return one.unionByName(two)


def _validated_sql(x):
    return f"""SELECT * FROM (WITH {_LEDGER.replace(WX, _weights_sql(x))}, cov AS (SELECT min(c) AS min_coverage FROM (SELECT count(*) FILTER (WHERE instrument % 50 > 0 AND {x} IS NOT NULL)::DOUBLE / count(*) AS c FROM panel GROUP BY date)),
    v AS (SELECT date, {x} AS v, label FROM panel WHERE instrument % 50 > 0 AND {x} IS NOT NULL AND label IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl FROM v),
    ic AS (SELECT avg(c) AS mean_rank_ic FROM (SELECT CASE WHEN count(*) >= 3 AND min(v) < max(v) AND min(label) < max(label) THEN corr(rx, rl) END AS c FROM k GROUP BY date)), sh AS (SELECT avg(net) / stddev_samp(net) AS sharpe FROM wl),
    g AS (SELECT *, CASE WHEN min_coverage < 0.9 THEN 'coverage' WHEN NOT coalesce(mean_rank_ic > 0, false) THEN 'ic' ELSE 'none' END AS rejected_by FROM cov, ic, sh)
    SELECT '{x}' AS candidate, {r('min_coverage', 'min_coverage')}, {r('mean_rank_ic', 'mean_rank_ic')}, {r('sharpe', 'sharpe')}, rejected_by, {r("CASE WHEN rejected_by = 'none' THEN sharpe END", 'score')} FROM g)"""


add("l08_score_validation", _validated, f"{_validated_sql('x')} UNION ALL {_validated_sql('y')}")


def _evaluation_tables(s, d):
    """The evaluation's tables written, read again and joined."""
    at, ic = tables.scratch(s, "evaluation"), all_ic(s, d)
    tables.save_tables({"ic": ic, "summary": ic.groupBy("factor").agg(F.avg("ic").alias("mean"), F.count("ic").alias("n"))}, at)
    return s.read.parquet(f"{at}/ic").join(s.read.parquet(f"{at}/summary"), "factor").select("factor", "date", (F.col("ic") - F.col("mean")).alias("centred"), "n")


add("s20_evaluation_tables", _evaluation_tables, f"WITH {ALL_IC} SELECT factor, date, {r('ic - avg(ic) OVER (PARTITION BY factor)', 'centred')}, count(ic) OVER (PARTITION BY factor) AS n FROM ics")


def _dated_csv(s, d):
    at = tables.scratch(s, "dated")
    tables.save_dated_csv(fp(s, d).select("date", "instrument", F.col("x").alias("factor")), at)
    return tables.read_csvs(s, at, "instrument long, factor double, date date")


add("s21_dated_factor_csv", _dated_csv, f"WITH {FP} SELECT instrument, date, {r('x', 'factor')} FROM panel")


def _style_outputs(s, d):
    """The residual factor as Parquet, the exposures as CSV, both read again."""
    at = tables.scratch(s, "style")
    p = X.regress(fp(s, d), "x", ["w"], out="res")
    tables.save_tables({"residual": p.select("date", "instrument", F.col("res").alias("factor"))}, at)
    p.select("date", "instrument", F.col("w").alias("exposure")).write.csv(f"{at}/exposures", header=True)
    return s.read.parquet(f"{at}/residual").join(tables.read_csvs(s, f"{at}/exposures", "date date, instrument long, exposure double"), ["date", "instrument"])


add("s22_style_outputs", _style_outputs, f"WITH {FP}, {_RES} SELECT date, instrument, {r('res', 'factor')}, {r('w', 'exposure')} FROM u")
add(
    "x03_timestamp_drift",
    lambda s, d: _drifted(s, d).withColumn("second", tables.same_second(F.col("ts"))).dropDuplicates(["user_id", "second", "value"]).groupBy("user_id").agg(F.count("*").alias("n")),
    "SELECT user_id, count(DISTINCT (date_trunc('second', ts), value)) AS n FROM events GROUP BY user_id",
)


def _drifted(s, d):
    """Events on the full second, and once more up to 0.4 seconds early or late."""
    e = views.read(s, d, "events").select("user_id", "value", "event_id", F.date_trunc("second", "ts").alias("ts"))
    late = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 400 milliseconds")).otherwise(F.col("ts") - F.expr("interval 400 milliseconds"))
    return e.unionByName(e.withColumn("ts", late))
