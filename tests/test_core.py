"""Formula trees, tables, payloads and selection rules."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import evaluation as E, portfolio as P
from quantloom.plans import catalogue, formula
from quantloom.plans.formula import call, field
from quantloom.sources import payloads, tables


def test_equal_formulas_have_equal_ids():
    a, b = field("close"), field("open")
    assert formula.formula_id(a + b) == formula.formula_id(b + a) != formula.formula_id(a - b)


def test_history_fields_and_count():
    f = call("rolling_mean", call("rolling_max", field("close"), params=(20,)), params=(5,))
    assert (formula.history_days(f), formula.required_fields(f), formula.node_count(f)) == (23, {"close"}, 3)
    assert all(f.warmup >= 0 and f.fields for f in catalogue.FACTORS.values())


def test_units_and_domains_are_checked():
    with pytest.raises(ValueError):
        formula.check(field("close") + field("volume"))
    with pytest.raises(ValueError):
        formula.check(call("rolling_std", field("close"), params=(1,)))
    with pytest.raises(ValueError):
        formula.check(call("rolling_hit_rate", field("close"), params=(5,)))
    formula.check(call("safe_div", field("close") - field("open"), field("open")))


def test_neighbours_change_one_window():
    f = call("rolling_mean", call("lag", field("close"), params=(10,)), params=(20,))
    assert {(n.params[0], n.args[0].params[0]) for n in formula.neighbours(f)} == {(16, 10), (24, 10), (20, 8), (20, 12)}


def test_shared_subtrees_become_one_column(spark):
    rows = [(1, d, f"2024-01-{d:02d}", float(d)) for d in range(1, 9)]
    panel = spark.createDataFrame(rows, "instrument long, day int, date string, close double")
    m = call("rolling_mean", field("close"), params=(3,))
    out = formula.evaluate(panel, {"a": m - field("close"), "b": m * 2.0})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1
    assert [r.b for r in out.orderBy("date").collect()][:4] == [None, None, 4.0, 6.0]


def test_conflicting_keys_are_errors(spark):
    rows = [("k", "a", 1), ("k", "b", 1)]
    df = spark.createDataFrame(rows, "key string, value string, n int").withColumn("updated_at", F.current_timestamp())
    with pytest.raises(Exception, match="differ under one key"):
        tables.normalize(tables.METADATA, df).collect()
    assert tables.normalize(tables.METADATA, df.limit(1).union(df.limit(1))).count() == 1
    with pytest.raises(ValueError):
        tables.normalize(tables.METADATA, df.drop("value"))


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.read_table(spark, tables.KLINES, str(tmp_path / "none"), "date > date'2024-01-01'").count() == 0


def test_saved_factor_must_not_change(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1, 0.5)], "date string, instrument long, factor double")
    tables.save_factor(df, str(tmp_path), "f", {"n": 1})
    with pytest.raises(ValueError):
        tables.save_factor(df.withColumn("factor", F.col("factor") + 1), str(tmp_path), "f", {"n": 1})
    assert tables.load_factor(spark, str(tmp_path), "f", {"n": 2}) is None


def test_payload_with_an_error_status(spark):
    bad = spark.createDataFrame([('{"status": {"error_code": 5}, "data": []}',)], "payload string")
    with pytest.raises(Exception, match="error status"):
        payloads.index_history(bad)[0].collect()
    broken = spark.createDataFrame([("S", '[["1704067200000","1","2","0.5","x","9","1704153599999","1","1","1","1","0"]]'), ("S", "not json")], "symbol string, payload string")
    row = payloads.klines(broken).collect()
    assert len(row) == 1 and row[0].close is None and row[0].open == 1.0


def test_pareto_front_against_pairs(spark):
    rows = [(i, float((i * 7) % 11), float((i * 5) % 13)) for i in range(60)]
    got = {r.k for r in E.pareto_front(spark.createDataFrame(rows, "k int, a double, b double"), "k", ["a", "b"]).collect()}
    assert got == {k for k, a, b in rows if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in rows)}


def test_greedy_decorrelation():
    assert P.greedy_decorrelation(["c", "a", "b"], {("a", "c"): 0.9, ("b", "c"): 0.1, ("a", "b"): 0.2}, 0.5) == ["c", "b"]


def test_reference_price_by_hand(spark):
    from quantloom.operators import cost_basis

    rows = [("a", k, float(p), t, float(p)) for k, (p, t) in enumerate([(10, 0.5), (20, 0.1), (30, None), (40, 0.0)])] + [("b", 0, 7.0, 0.3, 7.0)]
    df = spark.createDataFrame(rows, "instrument string, day int, p double, t double, c double").selectExpr("*", "date_from_unix_date(day) AS date")
    got = {(r.instrument, str(r.date)[-1]): r.reference for r in cost_basis.reference_price(df, "p", "t", "c").collect()}
    want = {("a", "1"): 10.0, ("a", "2"): 10.0, ("a", "3"): 10 * 0.9 + 20 * 0.1, ("a", "4"): 11.0, ("b", "1"): 7.0}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and len(got) == 5


def test_windows_are_the_defined_ones():
    from quantloom.plans.catalogue import FACTORS

    warm = {n: FACTORS[n].warmup for n in FACTORS}
    least = {"price_momentum_120": 120, "alpha_052": 140, "alpha_024": 59, "alpha_039": 90, "lib_heat_premium": 119, "lib_vol_squeeze_position": 139, "tree_01": 142, "tree_06": 166, "tree_02": 115}
    assert {n: warm[n] >= w for n, w in least.items()} == dict.fromkeys(least, True)


def test_equal_formulas_are_one_object():
    from quantloom.plans.formula import call, canonical, field, formula_id

    a, b = field("close") + field("volume"), field("volume") + field("close")
    assert a is field("close") + field("volume") and canonical(a) is canonical(b) and formula_id(a) == formula_id(b)
    deep = field("close")
    for _ in range(60):  # walked once each, not 2 ** 60 times
        deep = call("add", deep, deep)
    assert len(formula_id(deep)) == 16


def test_average_linkage_by_hand():
    from quantloom.operators.portfolio import average_linkage

    pairs = {("a", "b"): 0.9, ("a", "c"): -0.6, ("b", "c"): 0.4, ("c", "d"): 0.1, ("a", "d"): 0.2, ("b", "d"): None}
    assert average_linkage("dcba", pairs, 0.2) == [["a", "b"], ["c"], ["d"]]
    assert average_linkage("dcba", pairs, 0.5) == [["a", "b", "c"], ["d"]]  # c is 0.4 and 0.6 away: 0.5 on average
    assert average_linkage("dcba", pairs, 1.0) == [["a", "b", "c", "d"]]
    assert average_linkage([], {}, 0.5) == []
