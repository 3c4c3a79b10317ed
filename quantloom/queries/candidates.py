"""Candidates against the market, their neighbours and each other, and the SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import views
from quantloom.operators import candidates as C, cross_section as X
from quantloom.plans import catalogue, formula
from quantloom.queries.common import add, r
from quantloom.queries.evaluation import FP, fp, top_weights
from quantloom.sources import tables

MO = views.BARS_MO
FEE = 0.0015


def _weights(long):
    """Longs and shorts of the outer fifths of x per variant and date."""
    keyed = long.withColumn("date", F.struct("variant", "date"))
    g = X.target_weights(X.assign_groups(keyed, "x", 5, "g"), "g").filter("value <> 0")
    return g.select("date.variant", "date.date", "instrument", F.col("value").alias("weight"))


def _weights_sql(source: str) -> str:
    return f"""(SELECT variant, date, instrument, CASE WHEN g = 5 THEN 0.5 / count(*) FILTER (WHERE g = 5) OVER v WHEN g = 1 THEN -0.5 / count(*) FILTER (WHERE g = 1) OVER v END AS weight
    FROM (SELECT *, CASE WHEN count(x) OVER (PARTITION BY variant, date) >= 5 AND x IS NOT NULL THEN ((row_number() OVER (PARTITION BY variant, date ORDER BY x, instrument) - 1) * 5 // count(x) OVER (PARTITION BY variant, date)) + 1 END AS g FROM {source}) WINDOW v AS (PARTITION BY variant, date))"""


def _ledger_sql(source: str) -> str:
    """Stages up to `net` (variant, date, turnover, net) over weights of `source` (variant, date, instrument, x)."""
    return f"""turns AS (SELECT date, row_number() OVER (ORDER BY date) AS turn FROM (SELECT DISTINCT date FROM panel)), w AS (SELECT variant, turn, instrument, weight FROM {_weights_sql(source)} JOIN turns USING (date) WHERE weight IS NOT NULL),
    rt AS (SELECT turn, instrument, ret FROM panel JOIN turns USING (date)),
    mv AS (SELECT coalesce(a.variant, b.variant) AS variant, coalesce(a.turn, b.turn + 1) AS turn, coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.weight, 0) AS new, coalesce(b.weight, 0) AS old FROM w a FULL JOIN w b ON a.variant = b.variant AND a.turn = b.turn + 1 AND a.instrument = b.instrument),
    ce AS (SELECT variant, turn, sum(old * coalesce(ret, 0)) AS gross, sum(abs(new - old)) AS turnover FROM mv LEFT JOIN rt USING (turn, instrument) GROUP BY ALL),
    net AS (SELECT variant, date, coalesce(turnover, 0) AS turnover, coalesce(gross, 0) - coalesce(turnover, 0) * {FEE} AS net FROM (SELECT variant, turn, date FROM (SELECT DISTINCT variant FROM w), turns) q LEFT JOIN ce USING (variant, turn))"""


# stability of parameters: a hundredth is invested
_BASE = catalogue.FACTORS["tree_08"].formula
_TREES = {"base": _BASE, **{f"v{i}": n for i, n in enumerate(formula.neighbours(_BASE))}}


def _results(s, d):
    wide = formula.evaluate(views.bars_mo(s, d), _TREES)
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.round(k, 9).alias("x")) for k in _TREES]))
    w = _weights(wide.select("instrument", "date", e.alias("e")).select("instrument", "date", "e.variant", "e.x"))
    return C.results(C.ledgers(w.withColumn("weight", F.col("weight") / 100), fp(s, d).select("date", "instrument", "ret"), FEE))


_HUNDREDTH = _ledger_sql("l").replace("SELECT variant, turn, instrument, weight FROM", "SELECT variant, turn, instrument, weight / 100 AS weight FROM")
_RESULTS = f"""WITH {FP}, f AS ({formula.sql(MO, _TREES, places=9)}), l AS (SELECT instrument, date, unnest({list(_TREES)!r}) AS variant, unnest([{', '.join(_TREES)}]) AS x FROM f), {_HUNDREDTH},
  told AS (SELECT variant, product(1 + net) - 1 AS total_return, avg(net) / stddev_samp(net) AS sharpe FROM net GROUP BY variant)"""
add("a57_variant_results", _results, f"{_RESULTS} SELECT variant, {r('total_return', 'total_return')}, {r('sharpe', 'sharpe')} FROM told")
add(
    "a57_parameter_stability",
    lambda s, d: C.stability(_results(s, d), "base"),
    f"""{_RESULTS}, o AS (SELECT count(*) AS variant_count, avg((total_return > 0 AND sharpe > 0)::INT) AS positive_fraction, median(total_return) AS mr, median(sharpe) AS ms FROM told WHERE variant <> 'base'), b AS (SELECT * FROM told WHERE variant = 'base'),
    p AS (SELECT *, greatest(total_return - mr, 0) AS dr, greatest(sharpe - ms, 0) AS ds, greatest(0.5 - positive_fraction, 0) AS lack FROM o, b)
    SELECT variant_count, {r('positive_fraction', 'positive_fraction')}, {r('mr', 'median_return')}, {r('ms', 'median_sharpe')}, {r('dr', 'return_degradation')}, {r('ds', 'sharpe_degradation')}, {r('lack', 'shortfall')}, {r('dr + ds + lack', 'penalty')} FROM p""",
)


# behaviour
def _behaviour(s, d):
    net = C.ledgers(top_weights(s, d).withColumn("variant", F.lit("x")), fp(s, d).select("date", "instrument", "ret"), FEE)
    return C.behaviour(net, fp(s, d))


_PAST = "max({0}) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
add(
    "a24_behaviour_evidence",
    _behaviour,
    f"""WITH {FP}, l AS (SELECT instrument, date, 'x' AS variant, x FROM panel), {_ledger_sql('l')},
    mo AS (SELECT date, open / {_PAST.format('open')} - 1 AS move, {_PAST.format('eligible::INT')} AS member FROM panel), mk AS (SELECT date, avg(move) AS market FROM mo WHERE member = 1 GROUP BY date), j AS (SELECT * FROM net LEFT JOIN mk USING (date))
    SELECT count(*) FILTER (WHERE market IS NOT NULL) AS n_days, {r('regr_slope(net, market)', 'market_beta')}, {r('corr(net, market)', 'market_correlation')}, {r('avg(turnover)', 'turnover')}, min(date) AS period_start, max(date) AS period_end FROM j""",
)

# deduplication
_FACTORS = {"x": "x", "x_near": "x + y / 50", "y": "y", "y_mirror": "-y", "w": "w", "sparse": "CASE WHEN year(date) = 1996 THEN x * w END"}
_ORDER = ["w", "x", "y_mirror", "x_near", "y", "sparse"]


def _long(s, d):
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.round(F.expr(x), 9).alias("value")) for n, x in _FACTORS.items()]))
    return fp(s, d).select("instrument", "date", e.alias("e")).select("instrument", "date", "e.factor", "e.value")


def _deduplicated(s, d):
    told = C.deduplicate(_ORDER, C.daily_similarity(_long(s, d)), 40, 0.9, 3)
    return s.createDataFrame([(c, ok, "; ".join(why)) for c, ok, why in told], "factor string, accepted boolean, reasons string")


_AVG = "rank() OVER (PARTITION BY f, g, date ORDER BY {0}) + (count(*) OVER (PARTITION BY f, g, date, {0}) - 1) / 2.0"
_PAIRS = f"""WITH RECURSIVE {FP}, v AS (SELECT instrument, date, unnest({list(_FACTORS)!r}) AS factor, unnest([{', '.join(f'round({x}, 9)' for x in _FACTORS.values())}]) AS value FROM panel), n AS (SELECT * FROM v WHERE value IS NOT NULL),
  p AS (SELECT a.factor AS f, b.factor AS g, date, a.value AS x, b.value AS y FROM n a JOIN n b USING (instrument, date) WHERE a.factor < b.factor), k AS (SELECT f, g, date, {_AVG.format('x')} AS rx, {_AVG.format('y')} AS ry FROM p),
  c AS (SELECT f, g, date, abs(corr(rx, ry)) AS c FROM k GROUP BY ALL HAVING count(*) >= 20), alike AS (SELECT f, g, count(c) AS common_days, round(avg(c), 9) AS similarity FROM c GROUP BY ALL)"""
add("k08_daily_similarity", lambda s, d: C.daily_similarity(_long(s, d)), f"{_PAIRS} SELECT f, g, count(c) AS common_days, {r('avg(c)', 'similarity')} FROM c GROUP BY ALL")
add(
    "k08_deduplicate_candidates",
    _deduplicated,
    f"""{_PAIRS}, sides AS (SELECT f AS p, g AS q, common_days, similarity FROM alike UNION ALL SELECT g, f, common_days, similarity FROM alike), o AS (SELECT unnest({_ORDER!r}) AS factor, unnest(range(1, {len(_ORDER) + 1})) AS k),
    bad AS (SELECT o.factor, a.factor AS other, CASE WHEN coalesce(b.common_days, 0) < 40 THEN 'overlap with ' || a.factor WHEN b.similarity >= 0.9 THEN 'duplicate of ' || a.factor END AS why FROM o JOIN o a ON a.k < o.k LEFT JOIN sides b ON b.p = a.factor AND b.q = o.factor),
    why AS (SELECT factor, map_from_entries(list({{'k': other, 'v': why}} ORDER BY other)) AS m FROM bad GROUP BY factor),
    t AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS acc, NULL::VARCHAR AS factor, true AS ok, []::VARCHAR[] AS reasons
      UNION ALL SELECT k, CASE WHEN len(rs) = 0 THEN list_append(acc, factor) ELSE acc END, factor, len(rs) = 0, rs
      FROM (SELECT o.k, t.acc, o.factor, list_concat(list_filter(list_transform(t.acc, lambda a: m[a]), lambda z: z IS NOT NULL), CASE WHEN len(t.acc) >= 3 THEN ['no place left'] ELSE [] END) AS rs FROM t JOIN o ON o.k = t.k + 1 LEFT JOIN why ON why.factor = o.factor))
    SELECT factor, ok AS accepted, array_to_string(reasons, '; ') AS reasons FROM t WHERE k > 0""",
)

# net stability, score and gates: a hundredth is invested
_NODES = {k: formula.node_count(n) for k, n in _TREES.items()}


def _invested(s, d):
    """The ledger of all variants, once for all that is told about it (a row per variant and date)."""
    wide = formula.evaluate(views.bars_mo(s, d), _TREES)
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.round(k, 9).alias("x")) for k in _TREES]))
    w = _weights(wide.select("instrument", "date", e.alias("e")).select("instrument", "date", "e.variant", "e.x"))
    w, returns = tables.staged(w.withColumn("weight", F.col("weight") / 100), "weights"), tables.staged(fp(s, d).select("date", "instrument", "ret"), "returns")
    return tables.staged(C.ledgers(w, returns, FEE), "ledger")


def _gated(s, d):
    led = _invested(s, d)
    stressed = led.withColumn("net", F.col("gross") - F.col("turnover") * (FEE * 1.5))
    return C.cost_gates(C.net_stability(led, 12), C.net_stability(stressed, 12))


def _whole(name: str, source: str, by: str) -> str:
    return f"""{name}_w AS (SELECT *, product(1 + net) OVER (PARTITION BY {by} ORDER BY date) AS wealth FROM {source}), {name}_p AS (SELECT *, greatest(max(wealth) OVER (PARTITION BY {by} ORDER BY date), 1) AS peak FROM {name}_w),
    {name} AS (SELECT {by}, product(1 + net) - 1 AS total_return, avg(net) / nullif(stddev_samp(net), 0) * sqrt(12) AS sharpe, max(1 - wealth / peak) AS max_drawdown, count(*) AS n FROM {name}_p GROUP BY {by})"""


def _stability_sql(fee: float, p: str = "") -> str:
    """Stages up to `{p}stable`, from `invested` (variant, date, gross, turnover)."""
    return f"""{p}net AS (SELECT variant, date, year(date) || 'Q' || quarter(date) AS quarter, gross - turnover * {fee} AS net FROM invested), {p}run AS (SELECT *, product(1 + net) OVER (PARTITION BY variant ORDER BY date) AS after FROM {p}net),
    {_whole(p + 'q', p + 'net', 'variant, quarter')}, {p}gain AS (SELECT variant, quarter, arg_max(after, date) - arg_min(after / (1 + net), date) AS contribution FROM {p}run GROUP BY ALL), {p}quarters AS (SELECT * FROM {p}q JOIN {p}gain USING (variant, quarter)),
    {p}best AS (SELECT variant, arg_max(quarter, (contribution, quarter)) AS best_quarter FROM {p}quarters GROUP BY variant), {p}rest AS (SELECT * FROM {p}net JOIN {p}best USING (variant) WHERE quarter <> best_quarter), {_whole(p + 'r', p + 'rest', 'variant')}, {_whole(p + 'a', p + 'net', 'variant')},
    {p}told AS (SELECT variant, count(*) AS n_quarters, count(*) FILTER (WHERE contribution > 0) AS positive_quarters, count(*) FILTER (WHERE total_return > 0) AS rising_quarters, min(total_return) AS worst_quarter_return,
      CASE WHEN sum(greatest(contribution, 0)) > 0 THEN max(greatest(contribution, 0)) / sum(greatest(contribution, 0)) END AS concentration, median(sharpe) AS median_sharpe, stddev_pop(sharpe) AS sd_sharpe, min(sharpe) AS worst_sharpe, max(max_drawdown) AS worst_drawdown FROM {p}quarters GROUP BY variant),
    {p}stable AS (SELECT t.*, a.total_return, a.sharpe, a.max_drawdown, best_quarter, r.total_return AS remaining_return, r.sharpe AS remaining_sharpe FROM {p}told t JOIN {p}a a USING (variant) JOIN {p}best USING (variant) LEFT JOIN {p}r r USING (variant))"""


_INVESTED = f"""WITH {FP}, f AS ({formula.sql(MO, _TREES, places=9)}), l AS (SELECT instrument, date, unnest({list(_TREES)!r}) AS variant, unnest([{', '.join(_TREES)}]) AS x FROM f), {_HUNDREDTH.rsplit('net AS (', 1)[0]}
  invested AS (SELECT variant, date, coalesce(turnover, 0) AS turnover, coalesce(gross, 0) AS gross FROM (SELECT variant, turn, date FROM (SELECT DISTINCT variant FROM w), turns) q LEFT JOIN ce USING (variant, turn))"""
_TOLD = ["total_return", "sharpe", "max_drawdown", "worst_quarter_return", "concentration", "median_sharpe", "sd_sharpe", "worst_sharpe", "worst_drawdown", "remaining_return", "remaining_sharpe"]
add(
    "a19_net_stability_by_variant",
    lambda s, d: C.net_stability(_invested(s, d), 12).select("variant", "n_quarters", "positive_quarters", "rising_quarters", "best_quarter", *_TOLD),
    f"{_INVESTED}, {_stability_sql(FEE)} SELECT variant, n_quarters, positive_quarters, rising_quarters, best_quarter, {', '.join(r(c, c) for c in _TOLD)} FROM stable",
)
_SCORE = f"""(median_sharpe - 0.5 * sd_sharpe - greatest(-worst_sharpe, 0) - worst_drawdown - 0.001 * CASE variant {' '.join(f"WHEN '{k}' THEN {n}" for k, n in _NODES.items())} END - 0.5 * greatest(concentration - 0.6, 0) - 0.5 * greatest(-remaining_sharpe, 0))"""
add(
    "a20_cost_score",
    lambda s, d: C.cost_score(C.net_stability(_invested(s, d), 12), _NODES),
    f"""{_INVESTED}, {_stability_sql(FEE)}, s AS (SELECT *, CASE WHEN concentration IS NOT NULL AND remaining_sharpe IS NOT NULL THEN {_SCORE} END AS score FROM stable)
    SELECT variant, {r('score', 'score')}, concat_ws('; ', CASE WHEN total_return <= 0 THEN 'return is not positive' END, CASE WHEN sharpe <= 1 THEN 'sharpe is not above its bar' END,
      CASE WHEN rising_quarters * 2 <= n_quarters THEN 'no majority of rising quarters' END, CASE WHEN NOT coalesce(score > 0, false) THEN 'score is not positive' END) AS reasons FROM s""",
)
add(
    "a56_cost_gates",
    _gated,
    f"""{_INVESTED}, {_stability_sql(FEE)}, {_stability_sql(FEE * 1.5, 'h')}, g AS (SELECT s.*, h.total_return AS hard_return, h.sharpe AS hard_sharpe FROM stable s JOIN hstable h USING (variant)),
    z AS (SELECT variant, concat_ws('; ', CASE WHEN positive_quarters < 3 THEN 'too few quarters with a gain' END, CASE WHEN worst_quarter_return < -0.1 THEN 'a quarter loses too much' END,
      CASE WHEN NOT coalesce(remaining_return > 0, false) THEN 'little return without the best quarter' END, CASE WHEN NOT coalesce(remaining_sharpe > 0, false) THEN 'low sharpe without the best quarter' END,
      CASE WHEN NOT coalesce(hard_return > 0 AND hard_sharpe > 0, false) THEN 'lost under higher costs' END) AS reasons FROM g) SELECT variant, reasons = '' AS passed, reasons FROM z""",
)
