"""Formulas: medians inside a window's lambda are taken once, and windows of one kind are computed together."""

import random
import statistics

from quantloom.plans import catalogue, formula


def _changes(steps):
    kinds = [formula.OPS[n.op].kind for nodes in steps for n in nodes if n.op != "column"]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def test_rolling_mad_sorts_a_window_twice_a_row(spark):
    rng = random.Random(5)
    rows = [(i, d, rng.choice([None, 0.0, -1.5, rng.randrange(9) / 7])) for i in range(3) for d in range(60) if rng.random() < 0.95]
    p = spark.createDataFrame(rows, "instrument long, day int, close double").selectExpr("*", "date_add(date'2020-01-01', day) as date")
    got = formula.evaluate(p, {"value": formula.call("rolling_mad", formula.field("close"), params=(5,))})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 2 and "array_sort(" not in plan
    by = {(i, d): v for i, d, v in rows}
    told = {(r.instrument, (r.date - r.date.replace(2020, 1, 1)).days): r.value for r in got.collect()}
    assert told.keys() == by.keys()
    for i, d in by:
        w = [by[i, k] for k in range(d - 4, d + 1) if by.get((i, k)) is not None]
        want = statistics.median(abs(y - statistics.median(w)) for y in w) if len(w) >= 5 else None
        assert told[i, d] == want


def test_windows_of_a_kind_go_together():
    for f in catalogue.FACTORS.values():
        plan = formula._Plan({"value": f.formula})
        steps, done = plan.steps(), set()
        for nodes in steps:
            assert all(plan._inner(n) <= done for n in nodes)
            done.update(nodes)
        assert done == set(plan.names)
        assert _changes(steps) <= _changes([sorted(plan.levels[k], key=lambda n: formula.OPS[n.op].kind) for k in sorted(plan.levels)])
    ensemble = formula._Plan({"value": catalogue.FACTORS["lib_rv_residual_ensemble"].formula})
    assert _changes(ensemble.steps()) == 4  # rolling, market and ranks, rolling, residuals, rolling
