"""Joins over daily bars, memberships and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import views
from quantloom.operators import evaluation as E, joins as J
from quantloom.queries.common import add, r

_MEMBERS = f"""WITH {views.BARS_EV}, {views.MEMBERS_EV}, days AS (
  SELECT DISTINCT m.instrument, d.date FROM members m JOIN (SELECT DISTINCT date FROM (SELECT unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY))::DATE AS date)) d
  ON d.date >= greatest(m.effective_date, m.decision_date) AND (m.effective_end_date IS NULL OR d.date <= m.effective_end_date)
)"""


def _bars(spark, d):
    return views.bars_ev(spark, d)


def _members(spark, d):
    return J.members_by_date(views.members_ev(spark, d), J.calendar_bounds(_bars(spark, d)))


def _merged(bars):
    """Bars of 40 groups of instruments."""
    return bars.groupBy(F.pmod("instrument", F.lit(40)).alias("instrument"), "date").agg(F.max("close").alias("close"), F.sum("volume").alias("volume"))


add("j01_membership_by_date", _members, f"{_MEMBERS} SELECT instrument, date FROM days")
add("j02_history_of_members", lambda s, d: J.history_of_members(_bars(s, d), _members(s, d)).select("instrument", "date", "close"), f"{_MEMBERS} SELECT instrument, date, {r('close', 'close')} FROM bars WHERE instrument IN (SELECT instrument FROM days)")
add(
    "j03_complete_universe_days",
    lambda s, d: J.complete_days(_merged(_bars(s, d)), _members(s, d).select(F.pmod("instrument", F.lit(40)).alias("instrument"), "date").distinct(), F.col("volume") > 20).select("instrument", "date", "close"),
    f"""{_MEMBERS}, b AS (SELECT instrument % 40 AS instrument, date, max(close) AS close, sum(volume) AS volume FROM bars GROUP BY ALL), m AS (SELECT DISTINCT instrument % 40 AS instrument, date FROM days),
    ok AS (SELECT m.date FROM m LEFT JOIN b ON b.instrument = m.instrument AND b.date = m.date GROUP BY m.date HAVING bool_and(coalesce(b.volume > 20, false)))
    SELECT b.instrument, b.date, {r('b.close', 'close')} FROM b SEMI JOIN m ON b.instrument = m.instrument AND b.date = m.date WHERE b.date IN (SELECT date FROM ok)""",
)
add("j04_filter_factor_output", lambda s, d: J.of_members(_bars(s, d), _members(s, d)).select("instrument", "date", "close"), f"{_MEMBERS} SELECT b.instrument, b.date, {r('close', 'close')} FROM bars b SEMI JOIN days USING (instrument, date)")
_WEEKLY = "u AS (SELECT instrument, effective_date AS date FROM members)"
add(
    "j05_nearest_earlier_universe",
    lambda s, d: J.nearest_earlier(_bars(s, d), views.members_ev(s, d).select("instrument", F.col("effective_date").alias("date"))).select("instrument", "date", "close"),
    f"""WITH {views.BARS_EV}, {views.MEMBERS_EV}, {_WEEKLY}, l AS (SELECT b.*, (SELECT max(u.date) FROM u WHERE u.date <= b.date) AS ud FROM bars b)
    SELECT l.instrument, l.date, {r('close', 'close')} FROM l JOIN u ON u.date = l.ud AND u.instrument = l.instrument""",
)
add(
    "j06_as_of_same_month",
    lambda s, d: J.as_of(_bars(s, d).select("instrument", "date", "day"), _bars(s, d).filter("rate is not null").select("instrument", "day", F.struct("day", "rate").alias("found")), "instrument", "found")
    .select("instrument", "date", F.col("found.rate").alias("rate"), F.coalesce(F.month(F.date_from_unix_date("found.day")) == F.month("date"), F.lit(False)).alias("same_month")),
    f"""WITH {views.BARS_EV} SELECT a.instrument, a.date, {r('b.rate', 'rate')}, coalesce(month(b.date) = month(a.date), false) AS same_month
    FROM bars a ASOF LEFT JOIN (SELECT * FROM bars WHERE rate IS NOT NULL) b ON a.instrument = b.instrument AND a.day >= b.day""",
)
add(
    "j07_latest_value_or_prior",
    lambda s, d: J.as_of(_bars(s, d).select("instrument", "date", "day"), _bars(s, d).select("instrument", "day", "rate"), "instrument", "rate", default=0.01).select("instrument", "date", "rate"),
    f"""WITH {views.BARS_EV} SELECT a.instrument, a.date, {r('coalesce(b.rate, 0.01)', 'rate')}
    FROM bars a ASOF LEFT JOIN (SELECT * FROM bars WHERE rate IS NOT NULL) b ON a.instrument = b.instrument AND a.day >= b.day""",
)
add(
    "j08_outer_align_factors",
    lambda s, d: J.align({"fast": _bars(s, d).withColumn("value", F.col("close")), "slow": _bars(s, d).filter("day % 5 = 0").withColumn("value", F.col("volume"))}),
    f"""WITH {views.BARS_EV}, w AS (SELECT instrument, date, close AS fast, CASE WHEN day % 5 = 0 THEN volume END AS slow FROM bars)
    SELECT instrument, date, {r('last_value(fast IGNORE NULLS) OVER p', 'fast')}, {r('last_value(slow IGNORE NULLS) OVER p', 'slow')} FROM w
    WINDOW p AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
add(
    "j09_weights_by_date",
    lambda s, d: J.weighted_by_date(
        _bars(s, d), _bars(s, d).groupBy("date").agg(F.when(F.dayofmonth("date") % 3 > 0, F.avg("rate")).alias("w_close"), F.when(F.dayofmonth("date") % 3 > 0, 1 - F.avg("rate")).alias("w_open")), ["close", "open"]
    ).select("instrument", "date", "value"),
    f"""WITH {views.BARS_EV}, w AS (SELECT date, CASE WHEN day(date) % 3 > 0 THEN avg(rate) END AS a FROM bars GROUP BY date)
    SELECT instrument, date, {r('CASE WHEN a IS NULL THEN (close + open) / 2 ELSE a * close + (1 - a) * open END')} FROM bars JOIN w USING (date)""",
)
add(
    "j11_research_panel",
    lambda s, d: J.research_panel(_members(s, d), _bars(s, d), E.funding_daily(views.flows_ev(s, d).filter("kind = 'error'"))),
    f"""{_MEMBERS}, f AS (SELECT user_id AS instrument, ts::DATE AS date, sum(value / 1000) AS rate_sum, count(*) AS event_count FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT d.instrument, d.date, {r('b.close', 'close')}, {r('b.volume', 'volume')}, {r('rate_sum', 'rate_sum')}, coalesce(event_count, 0) AS event_count, b.date IS NOT NULL AS has_bar, f.date IS NOT NULL AS has_funding
    FROM days d LEFT JOIN bars b USING (instrument, date) LEFT JOIN f USING (instrument, date)""",
)


def _schedule(s, d):
    """The day's click times as expected, a second late where ids are odd, and one short on every fourth day."""
    e = views.flows_ev(s, d).filter("kind = 'click'")
    late = F.when(F.col("event_id") % 2 == 1, F.col("ts") + F.expr("interval 900 milliseconds")).otherwise(F.col("ts"))
    want = e.filter("not (day % 4 = 0 and event_id % 3 = 0)").groupBy("instrument", "date").agg(F.array_sort(F.collect_list(late)).alias("expected_times"))
    return J.schedule_status(want, e)


add(
    "j12_funding_schedule_match",
    _schedule,
    f"""WITH {views.FLOWS_EV}, e AS (SELECT * FROM flows WHERE kind = 'click'),
    w AS (SELECT instrument, date, list_sort(list(CASE WHEN event_id % 2 = 1 THEN ts + INTERVAL 900 MILLISECOND ELSE ts END)) AS want FROM e WHERE NOT (day % 4 = 0 AND event_id % 3 = 0) GROUP BY ALL),
    g AS (SELECT instrument, date, list_sort(list(ts)) AS got FROM e GROUP BY ALL)
    SELECT w.instrument, w.date, CASE WHEN len(want) = len(got) AND len(list_filter(range(1, len(want) + 1), lambda i: abs(epoch_us(want[i]) - epoch_us(got[i])) > 1000000)) = 0 THEN 'complete'
      WHEN len(got) < len(want) THEN 'missing' ELSE 'schedule_mismatch' END AS status, len(got) AS n_times FROM w JOIN g USING (instrument, date)""",
)
def _snapshots(s, d):
    """Shipments as snapshots: a part is an id, its supplier the symbol, the price its weight."""
    return views.read(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("instrument"), F.col("l_suppkey").alias("symbol"), F.col("l_extendedprice").alias("weight"))


add(
    "j13_monthly_universe",
    lambda s, d: J.monthly_universe(_snapshots(s, d), 20).select("date", "instrument", "weight", "position"),
    f"""WITH l AS (SELECT l_shipdate::DATE AS date, l_partkey AS instrument, l_suppkey AS symbol, sum(l_extendedprice) AS weight FROM lineitem GROUP BY ALL), f AS (SELECT min(date) AS date FROM l GROUP BY date_trunc('month', date)),
    u AS (SELECT * FROM l SEMI JOIN f USING (date) QUALIFY count(*) OVER (PARTITION BY date, instrument) = 1 AND count(*) OVER (PARTITION BY date, symbol) = 1), e AS (SELECT instrument, min(date) AS seen FROM l GROUP BY instrument)
    SELECT date, instrument, {r('weight', 'weight')}, row_number() OVER (PARTITION BY date ORDER BY weight DESC, instrument) AS position FROM u JOIN e USING (instrument) WHERE seen < date QUALIFY row_number() OVER (PARTITION BY date ORDER BY weight DESC, instrument) <= 20""",
)


add("j14_interval_ends", lambda s, d: J.interval_ends(views.members_ev(s, d)).select("instrument", "effective_date", "interval_end"), f"WITH {views.MEMBERS_EV}, n AS (SELECT effective_date, lead(effective_date) OVER (ORDER BY effective_date) - 1 AS interval_end FROM (SELECT DISTINCT effective_date FROM members)) SELECT instrument, effective_date, interval_end FROM members JOIN n USING (effective_date)")
add(
    "j15_mapping_with_fallback",
    lambda s, d: J.fallback_map(
        views.read(s, d, "customer").select("c_custkey", "c_nationkey"),
        [views.read(s, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("order")), views.read(s, d, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("order"))],
        "c_custkey", "order",
    ).select("c_custkey", "order", "source"),
    """WITH a AS (SELECT o_custkey AS c_custkey, min(o_orderkey) AS x FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS y FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
    SELECT c_custkey, coalesce(x, y) AS "order", CASE WHEN x IS NOT NULL THEN 0 WHEN y IS NOT NULL THEN 1 END AS source FROM customer LEFT JOIN a USING (c_custkey) LEFT JOIN b USING (c_custkey)""",
)
add(
    "j16_funding_settlement",
    lambda s, d: J.settle_funding(
        _bars(s, d).select("instrument", "date", (F.col("volume") / 100).alias("quantity")),
        views.flows_ev(s, d).filter("kind = 'error'").select("instrument", "date", "event_id", "rate", F.when(F.col("event_id") % 3 > 0, F.col("rate") * 500).otherwise(0.0).alias("mark_price")),
        _bars(s, d).filter("day % 2 = 0").select("instrument", "date", "open"),
    ),
    f"""WITH {views.BARS_EV}, {views.FLOWS_EV}, e AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN rate * 500 ELSE 0 END AS mark FROM flows WHERE kind = 'error')
    SELECT b.instrument, b.date, event_id, CASE WHEN mark > 0 THEN 'mark' WHEN b.day % 2 = 0 AND open > 0 THEN 'open' ELSE 'unresolved' END AS price_source,
    {r('-(b.volume / 100) * CASE WHEN mark > 0 THEN mark WHEN b.day % 2 = 0 AND open > 0 THEN open END * e.rate', 'cash')} FROM bars b JOIN e USING (instrument, date)""",
)
add(
    "j17_coverage_of_intervals",
    lambda s, d: _members(s, d).join(_schedule(s, d).select("instrument", "date", "status"), ["instrument", "date"], "left").groupBy("instrument").agg(F.count("*").alias("n_days"), F.count_if(F.col("status") == "complete").alias("n_complete"), F.count_if(F.col("status").isNull()).alias("n_unknown")),
    f"""{_MEMBERS}, {views.FLOWS_EV}, e AS (SELECT * FROM flows WHERE kind = 'click'),
    w AS (SELECT instrument, date, count(*) AS want FROM e WHERE NOT (day % 4 = 0 AND event_id % 3 = 0) GROUP BY ALL),
    g AS (SELECT instrument, date, count(*) AS got FROM e GROUP BY ALL)
    SELECT d.instrument, count(*) AS n_days, count_if(want = got) AS n_complete, count_if(want IS NULL) AS n_unknown FROM days d LEFT JOIN w USING (instrument, date) LEFT JOIN g USING (instrument, date) GROUP BY d.instrument""",
)
add(
    "j18_previous_day_times_reappear",
    lambda s, d: _reappear(views.flows_ev(s, d)),
    f"""WITH {views.FLOWS_EV}, t AS (SELECT instrument, day, list(DISTINCT hour(ts)) AS h FROM flows GROUP BY ALL)
    SELECT a.instrument, a.day, list_has_all(a.h, b.h) AS reappear FROM t a JOIN t b ON b.instrument = a.instrument AND b.day = a.day - 1""",
)


def _reappear(flows):
    """Per cell with a day before: do all of that day's hours appear again."""
    t = flows.groupBy("instrument", "day").agg(F.collect_set(F.hour("ts")).alias("h"))
    before = t.select("instrument", (F.col("day") + 1).alias("day"), F.col("h").alias("p"))
    return t.join(before, ["instrument", "day"]).select("instrument", "day", (F.size(F.array_except("p", "h")) == 0).alias("reappear"))


add(
    "j19_axis_intersection",
    lambda s, d: _bars(s, d).filter("trade_count >= 3").join(_bars(s, d).filter("rate is not null").select("instrument", "date"), ["instrument", "date"], "left_semi").select("instrument", "date", "close"),
    f"WITH {views.BARS_EV} SELECT instrument, date, {r('close', 'close')} FROM bars WHERE trade_count >= 3 AND rate IS NOT NULL",
)
add(
    "j20_prefix_comparison",
    lambda s, d: J.compare_prefix(_bars(s, d).select("instrument", "date", F.col("rate").alias("value")), _bars(s, d).filter("day % 7 > 0").select("instrument", "date", F.when(F.col("day") % 5 > 0, F.col("rate") + (F.col("day") % 3) / 1000).alias("value")), ["instrument", "date"]),
    f"""WITH {views.BARS_EV}, b AS (SELECT instrument, date, CASE WHEN day % 5 > 0 THEN rate + (day % 3) / 1000.0 END AS v, TRUE AS here FROM bars WHERE day % 7 > 0)
    SELECT count(*) AS n_keys, count_if(here IS NULL) AS n_one_side, count_if(here AND (rate IS NULL) <> (v IS NULL)) AS n_null_mismatch, count_if(abs(rate - v) > 1e-9) AS n_value_mismatch, {r('max(abs(rate - v))', 'max_difference')}
    FROM bars LEFT JOIN b USING (instrument, date)""",
)
add(
    "j22_factor_pairs",
    lambda s, d: J.factor_pairs(_long(views.factor_panel(s, d))),
    f"""WITH {views.FACTOR_PANEL}, l AS (SELECT instrument, date, unnest(['x', 'y', 'w']) AS f, unnest([x, y, w]) AS v FROM panel),
    k AS (SELECT *, rank() OVER (PARTITION BY f, date ORDER BY v) + (count(*) OVER (PARTITION BY f, date, v) - 1) / 2.0 AS rk FROM l WHERE v IS NOT NULL),
    p AS (SELECT a.f AS factor_a, b.f AS factor_b, a.date, a.v AS va, b.v AS vb, a.rk AS ra, b.rk AS rb FROM k a JOIN k b ON a.instrument = b.instrument AND a.date = b.date AND a.f < b.f),
    d AS (SELECT factor_a, factor_b, date, corr(ra, rb) AS s FROM p GROUP BY ALL HAVING count(*) >= 3)
    SELECT factor_a, factor_b, n_days, mean_spearman, {r('corr(va, vb)', 'pooled_pearson')} FROM p JOIN (SELECT factor_a, factor_b, count(s) AS n_days, {r('avg(s)', 'mean_spearman')} FROM d GROUP BY ALL) USING (factor_a, factor_b) GROUP BY ALL""",
)


def _long(p):
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in ("x", "y", "w")]))
    return p.select("instrument", "date", e.alias("e")).select("instrument", "date", "e.factor", "e.value")


add(
    "j23_basket_symmetric_difference",
    lambda s, d: J.basket_change(E.top_n_by_date(_bars(s, d), "volume", 10).select((F.col("day") - 19700).alias("turn"), "instrument")),
    f"""WITH {views.BARS_EV}, b AS (SELECT day - 19700 AS turn, instrument FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, instrument) <= 10)
    SELECT turn, count_if(p IS NULL) AS entered, count_if(n IS NULL) AS left_out FROM (SELECT coalesce(a.turn, b.turn + 1) AS turn, a.turn AS n, b.turn AS p FROM b a FULL JOIN b ON b.turn + 1 = a.turn AND b.instrument = a.instrument) GROUP BY turn""",
)
add(
    "j24_drop_flagged",
    lambda s, d: _bars(s, d).join(_bars(s, d).filter("high > 2 * low and trade_count > 2").select("instrument", "date"), ["instrument", "date"], "left_anti").select("instrument", "date", "close"),
    f"WITH {views.BARS_EV} SELECT instrument, date, {r('close', 'close')} FROM bars WHERE NOT (high > 2 * low AND trade_count > 2)",
)
add(
    "j25_merge_forward_fill",
    lambda s, d: _bars(s, d).select("instrument", "date", F.coalesce(J.F.last("rate", ignorenulls=True).over(_past()), F.lit(0.0)).alias("rate")),
    f"WITH {views.BARS_EV} SELECT instrument, date, {r('coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 'rate')} FROM bars",
)


def _past():
    from quantloom.operators.rolling import past

    return past()


add(
    "j10_label_attach",
    lambda s, d: (p := views.factor_panel(s, d)).select("instrument", "date", "x").join(p.select("instrument", "date", "label"), ["instrument", "date"], "left"),
    f"WITH {views.FACTOR_PANEL} SELECT instrument, date, {r('x', 'x')}, {r('label', 'label')} FROM panel",
)
