"""Choosing features and models over the monthly panel: components, importance and stability, candidates, and the walk forward."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quantloom import views
from quantloom.ml import panel as L, selection as S
from quantloom.queries.common import add, r
from quantloom.queries.evaluation import FP, fp
from quantloom.queries.tables import FACTORS, bounds
from quantloom.sources import tables

# principal components: SQL finds the two largest by power iteration on DuckDB's covariances
_STEP = "a.a{0} * v.v1 + a.b{0} * v.v2 + a.c{0} * v.v3"
_NORM = "sqrt(({0}) * ({0}) + ({1}) * ({1}) + ({2}) * ({2}))"


def _power(name: str, matrix: str) -> str:
    """The first eigenvector of a symmetric matrix (columns a1 to c3), its largest loading positive, and its eigenvalue."""
    steps = [_STEP.format(k) for k in (1, 2, 3)]
    norm = _NORM.format(*steps)
    return f"""{name}_i AS (SELECT 0 AS i, 0.6::DOUBLE AS v1, 0.5::DOUBLE AS v2, 0.7::DOUBLE AS v3 UNION ALL SELECT i + 1, ({steps[0]}) / {norm}, ({steps[1]}) / {norm}, ({steps[2]}) / {norm} FROM {name}_i v, {matrix} a WHERE i < 3000),
    {name}_s AS (SELECT *, CASE WHEN greatest(v1, v2, v3) >= -least(v1, v2, v3) THEN 1 ELSE -1 END AS s FROM {name}_i WHERE i = 3000),
    {name} AS (SELECT v1 * s AS v1, v2 * s AS v2, v3 * s AS v3, {norm} AS value FROM {name}_s v, {matrix} a)"""


_COV = """p AS (SELECT instrument, date, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE / 20 AS w FROM panel),
  q AS (SELECT x AS a, y AS b, w AS c FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL), mu AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM q),
  m AS (SELECT var_samp(a) AS a1, covar_samp(a, b) AS b1, covar_samp(a, c) AS c1, covar_samp(a, b) AS a2, var_samp(b) AS b2, covar_samp(b, c) AS c2, covar_samp(a, c) AS a3, covar_samp(b, c) AS b3, var_samp(c) AS c3 FROM q)"""
_LESS = ", ".join(f"m.{c}{k} - e1.value * e1.v{k} * e1.v{j} AS {c}{k}" for j, c in enumerate("abc", 1) for k in (1, 2, 3))


def _scaled(s, d):
    return fp(s, d).select("instrument", "date", "x", "y", (F.col("w") / 20).alias("w"))


add(
    "l13_principal_components",
    lambda s, d: S.components(S.moments(p := _scaled(s, d), ["x", "y", "w"]), most=2).project(p),
    f"""WITH RECURSIVE {FP}, {_COV}, {_power('e1', 'm')}, m2 AS (SELECT {_LESS} FROM m, e1), {_power('e2', 'm2')}
    SELECT instrument, date, {r('(x - ma) * e1.v1 + (y - mb) * e1.v2 + (w - mc) * e1.v3', 'pc1')}, {r('(x - ma) * e2.v1 + (y - mb) * e2.v2 + (w - mc) * e2.v3', 'pc2')} FROM p, mu, e1, e2""",
)
add(
    "l13_component_shares",
    lambda s, d: S.components(S.moments(_scaled(s, d), ["x", "y", "w"]), share=0.95).loadings(s).groupBy("component").agg(F.max("share").alias("share")),
    f"""WITH RECURSIVE {FP}, {_COV}, {_power('e1', 'm')}, m2 AS (SELECT {_LESS} FROM m, e1), {_power('e2', 'm2')},
    t AS (SELECT 1 AS component, e1.value / (a1 + b2 + c3) AS share FROM m, e1 UNION ALL SELECT 2, e2.value / (a1 + b2 + c3) FROM m, e2),
    u AS (SELECT 3 AS component, 1 - sum(share) AS share FROM t), a AS (SELECT * FROM t UNION ALL SELECT * FROM u), c AS (SELECT *, sum(share) OVER (ORDER BY component) - share AS before FROM a)
    SELECT component::INT AS component, {r('share', 'share')} FROM c WHERE before < 0.95""",
)


def _orthogonal(s, d):
    """Four features, two of them nearly the same: what is left of them."""
    p = fp(s, d).withColumn("x2", F.col("x") + F.col("y") / 1000)
    return s.createDataFrame([(f,) for f in S.orthogonalize(p, ["x", "x2", "y", "w"], "label", 0.95)[1]], "feature string")


add(
    "l13_pairs_by_target",
    _orthogonal,
    f"""WITH {FP}, p AS (SELECT x, x + y / 1000 AS x2, y, w, label FROM panel WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND label IS NOT NULL),
    c AS (SELECT abs(corr(x, label)) AS cx, abs(corr(x2, label)) AS cx2 FROM p) SELECT unnest([CASE WHEN cx >= cx2 THEN 'x' ELSE 'x2' END, 'y', 'w']) AS feature FROM c""",
)

# importance and its stability


def _features(s, d):
    """Ranked features with missing indicators, and a target, for months with enough of them."""
    t = L.targets(fp(s, d).select("instrument", "date", "eligible", *FACTORS, "label"), "label", 20)
    p = L.ranked(t, "eligible", FACTORS).select("instrument", "date", "target", *FACTORS)
    return L.features(p, FACTORS).filter("target is not null and present")


def _split_rows(s, d):
    data = _features(s, d).cache()
    return data.filter("date < date'1999-01-01'"), data.filter("date >= date'1999-01-01' and date < date'2000-07-01'")


def _importance(s, d):
    train, held = _split_rows(s, d)
    i = S.importance(train, held, FACTORS, repeats=1)
    rows = [(f, i.split[f], i.permuted[f], i.combined[f], f in i.kept) for f in i.split]
    return s.createDataFrame(rows, "feature string, split double, permuted double, combined double, kept boolean")


def _stable(windows):
    def run(s, d):
        train, held = _split_rows(s, d)
        dates = [x[0] for x in train.select("date").distinct().orderBy("date").collect()]  # a row per month
        shares = S.stability(train, held, FACTORS, windows(dates), repeats=1, model=S.boosted(8, 3))
        return s.createDataFrame(sorted(shares.items()), "feature string, share double")

    return run


add("l14_importance_selector", _importance)
add("l14_rolling_stability", _stable(lambda dates: S.date_windows(dates, 24, 12)))
add("l14_split_stability", _stable(lambda dates: S.expanding_windows(dates, 2)))

# candidates


def _assembled(s, d):
    """Rows of two features; a target is known a month after its date."""
    p = fp(s, d).filter("x is not null and w is not null").select("instrument", "date", F.add_months("date", 1).alias("exit_date"), "x", (F.col("w") / 10).alias("w"), "label", F.col("label").alias("target"), F.lit(True).alias("present"))
    return VectorAssembler(inputCols=["x", "w"], outputCol="features").transform(p)


_ROWS = f"{FP}, d AS (SELECT instrument, date, (date + INTERVAL 1 MONTH)::DATE AS exit_date, x::DOUBLE AS x, w::DOUBLE / 10 AS w, label::DOUBLE AS y FROM panel WHERE x IS NOT NULL AND w IS NOT NULL)"
_GRID = "g AS (SELECT * FROM (VALUES ('c000', 0.0001::DOUBLE), ('c001', 0.001), ('c002', 0.01), ('c003', 0.1), ('c004', 1.0)) t(candidate, alpha))"


def _ridge_sql(name: str, rows: str, by: str) -> str:
    """Ridge coefficients of every alpha over `rows` (x, w, y; grouped by `by`), from centred sums."""
    keys = f"{by}, " if by else ""
    sums = f"count(*) AS n, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, var_pop(x) AS sx, var_pop(w) AS sw, covar_pop(x, w) AS sxw, covar_pop(x, y) AS sxy, covar_pop(w, y) AS swy"
    det = "((sx + alpha) * (sw + alpha) - sxw * sxw)"
    bx, bw = f"((sxy * (sw + alpha) - swy * sxw) / {det})", f"((swy * (sx + alpha) - sxy * sxw) / {det})"
    return f"{name}_s AS (SELECT {keys}{sums} FROM {rows} {'GROUP BY ' + by if by else ''}), {name} AS (SELECT {keys}candidate, {bx} AS bx, {bw} AS bw, my - {bx} * mx - {bw} * mw AS b0 FROM {name}_s, g)"


def _ridge(s, d):
    data = _assembled(s, d).cache()
    train, ask = data.filter("exit_date < date'1998-01-01' and target is not null"), data.filter("date >= date'1998-01-01' and date < date'1999-01-01'")
    out = None
    for c in S.bank("ridge"):
        p = S.fit(c, train).model.transform(ask).select("instrument", "date", F.lit(c.name).alias("candidate"), "prediction")
        out = p if out is None else out.unionByName(p)
    return out


add(
    "l07_ridge_grid",
    _ridge,
    f"""WITH {_ROWS}, {_GRID}, t AS (SELECT x, w, y FROM d WHERE exit_date < DATE '1998-01-01' AND y IS NOT NULL), {_ridge_sql('f', 't', '')}
    SELECT instrument, date, candidate, {r('b0 + bx * x + bw * w', 'prediction')} FROM d, f WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01'""",
)


def _stopped(s, d):
    """The trees' grid, each with the number of trees at which validation stopped it."""
    data = _assembled(s, d).cache()
    part = S.parts(data, S.Fold("1999Q1", "1995-01-01", "1998-07-01", "1999-01-01", "1999-03-31"))
    rows = [(c.name, S.fit(c, part["fit"], part["validation"], most_rounds=12).rounds) for c in S.bank("trees")[:3]]
    return s.createDataFrame(rows, "candidate string, rounds int")


add("l07_early_stopping", _stopped)

# the walk forward


def _forward(s, d):
    data = _assembled(s, d).cache()
    fs = S.folds(*bounds(s, d), 24)
    return S.walk_forward(data, fs, S.bank("ridge"), tables.scratch(s, "walk"))


def _predicted(s, d):
    return _forward(s, d)[0].select("instrument", "date", "factor", "model_id", "quarter")


_AVG = "rank() OVER (PARTITION BY quarter, candidate, date ORDER BY {0}) + (count(*) OVER (PARTITION BY quarter, candidate, date, {0}) - 1) / 2.0"
_CHOSEN = f"""WITH {_ROWS}, {_GRID}, s AS (SELECT unnest(generate_series(date_trunc('quarter', (SELECT min(date) FROM panel)), (SELECT max(date) FROM panel), INTERVAL 3 MONTH))::DATE AS retrain),
  fold AS (SELECT year(retrain) || 'Q' || quarter(retrain) AS quarter, retrain, (retrain - INTERVAL 72 MONTH)::DATE AS history, (retrain - INTERVAL 6 MONTH)::DATE AS validation, (retrain + INTERVAL 3 MONTH)::DATE AS until
           FROM s WHERE retrain - INTERVAL 72 MONTH >= (SELECT min(retrain) FROM s)),
  known AS (SELECT * FROM fold JOIN d ON y IS NOT NULL AND date >= history AND exit_date < retrain),
  fitrows AS (SELECT * FROM known WHERE exit_date < validation), {_ridge_sql('f', 'fitrows', 'quarter')},
  v AS (SELECT quarter, candidate, date, round(b0 + bx * x + bw * w, 9) AS p, y FROM known JOIN f USING (quarter) WHERE date >= validation),
  k AS (SELECT quarter, candidate, date, {_AVG.format('p')} AS rp, {_AVG.format('y')} AS ry, p, y FROM v),
  i AS (SELECT quarter, candidate, date, CASE WHEN count(*) >= 3 AND min(p) < max(p) AND min(y) < max(y) THEN corr(rp, ry) END AS ic FROM k GROUP BY ALL),
  c AS (SELECT quarter, candidate, round(avg(ic), 9) AS mean_rank_ic FROM i GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY mean_rank_ic DESC, candidate) AS place FROM c WHERE mean_rank_ic > 0), {_ridge_sql('z', 'known', 'quarter')}"""
add(
    "l09_select_and_refit",
    _predicted,
    f"{_CHOSEN} SELECT instrument, date, {r('b0 + bx * x + bw * w', 'factor')}, 'ridge_' || quarter || '_' || candidate AS model_id, quarter FROM o JOIN z USING (quarter, candidate) JOIN fold USING (quarter) JOIN d ON date >= retrain AND date < until WHERE place = 1",
)
add(
    "l09_candidate_table",
    lambda s, d: _forward(s, d)[1].select("quarter", "candidate", "min_coverage", "mean_rank_ic", "rejected_by", "place"),
    f"""{_CHOSEN} SELECT c.quarter, c.candidate, 1.0::DOUBLE AS min_coverage, {r('c.mean_rank_ic', 'mean_rank_ic')}, CASE WHEN coalesce(c.mean_rank_ic > 0, false) THEN 'none' ELSE 'ic' END AS rejected_by, place::INT AS place
    FROM c LEFT JOIN o USING (quarter, candidate)""",
)


def _by_quarter(s, d):
    """The stitched predictions judged out of sample, by quarter: cells, coverage, pairs and mean rank IC."""
    from quantloom.operators.evaluation import daily_ic

    data, (p, _) = fp(s, d), _forward(s, d)
    met = p.join(data.select("instrument", "date", "label"), ["instrument", "date"])
    ic = daily_ic(met.withColumn("x", F.round("factor", 9)), "x", by=["quarter"]).groupBy("quarter").agg(F.count("rank_ic").alias("n_dates"), F.avg("rank_ic").alias("mean_rank_ic"), F.avg((F.col("rank_ic") > 0).cast("int")).alias("positive"))
    cells = met.groupBy("quarter").agg(F.count("*").alias("n_cells"), (F.count("label") / F.count("*")).alias("labelled"))
    return cells.join(ic, "quarter")


add(
    "l10_out_of_sample_by_quarter",
    _by_quarter,
    f"""{_CHOSEN}, out AS (SELECT quarter, candidate, date, round(b0 + bx * x + bw * w, 9) AS p, y FROM o JOIN z USING (quarter, candidate) JOIN fold USING (quarter) JOIN d ON date >= retrain AND date < until WHERE place = 1),
    r AS (SELECT quarter, date, p, y, {_AVG.format('p')} AS rp, {_AVG.format('y')} AS ry FROM out WHERE y IS NOT NULL),
    n AS (SELECT quarter, date, CASE WHEN count(*) >= 3 AND min(p) < max(p) AND min(y) < max(y) THEN corr(rp, ry) END AS ic FROM (SELECT * FROM r) GROUP BY ALL),
    m AS (SELECT quarter, count(ic) AS n_dates, avg(ic) AS mean_rank_ic, avg((ic > 0)::INT) AS positive FROM n GROUP BY quarter)
    SELECT quarter, count(*) AS n_cells, {r('count(y)::DOUBLE / count(*)', 'labelled')}, any_value(n_dates) AS n_dates, {r('any_value(mean_rank_ic)', 'mean_rank_ic')}, {r('any_value(positive)', 'positive')} FROM out JOIN m USING (quarter) GROUP BY quarter""",
)
