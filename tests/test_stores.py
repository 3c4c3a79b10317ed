"""Planned scans, users' factors, stored values and the table of minutes."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from quantloom import views
from quantloom.plans import catalogue, registry, scan
from quantloom.queries import stores  # noqa: F401  (registers two users' factors)
from quantloom.sources import minutes, reuse

START, END = dt.date(1996, 3, 5), dt.date(1996, 4, 20)
NAMES = ["volatility_efficiency", "user_volume_weighted_move"]


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"  # the smallest one has a single instrument, with gaps


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bars") / "t")
    scan.write(views.bars_dy(spark, sf_dir).filter("date between date'1995-10-01' and date'1996-08-31'"), at)
    return at


def scan_node(df):
    """The file scan of a plan, with its filters and columns."""
    text = df._jdf.queryExecution().toString()
    return re.findall(r"FileScan parquet.*", text)[0]


def test_filters_and_columns_reach_the_scan(spark, stored):
    p = scan.plan(NAMES, START, END)
    history = max(registry.needs([n])[1] for n in NAMES)
    assert p.first == START - dt.timedelta(days=history) and history > 0
    assert set(p.fields) == {"close", "volume"} | set(catalogue.FACTORS["volatility_efficiency"].fields)
    node = scan_node(scan.evaluate(spark, stored, NAMES, START, END))
    assert "month#" in node and f">= {scan.month_of(p.first)})" in node.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert f"GreaterThanOrEqual(date,{p.first})" in node and f"LessThanOrEqual(date,{END})" in node
    read = re.search(r"ReadSchema: struct<([^>]*)>", node)[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"instrument", "date", *p.fields}


def test_a_range_equals_the_whole_history(spark, stored, sf_dir):
    whole = registry.evaluate(views.bars_dy(spark, sf_dir), NAMES).filter(F.col("date").between(F.lit(START), F.lit(END)))
    part = scan.evaluate(spark, stored, NAMES, START, END)
    key = lambda df: sorted((r[0], r[1], *[None if v is None else round(v, 9) for v in r[2:]]) for r in df.collect())
    assert key(part) == key(whole) and part.filter("volatility_efficiency is not null").count() > 20


def test_missing_fields(spark, stored):
    p = scan.ScanPlan(START, END, START, ("close", "spread"))
    with pytest.raises(ValueError, match="spread"):
        scan.read(spark, stored, p)
    assert scan.read(spark, stored, p, ["spread"]).filter("spread is not null").count() == 0
    with pytest.raises(ValueError):
        scan.plan(NAMES, END, START)


def test_what_cannot_be_registered():
    fn = lambda panel, params: F.col("close")
    for name, fields, warmup, how in [("tree_18", ["close"], 1, {}), ("date", ["close"], 1, {}), ("_x", ["close"], 1, {}), ("fine", [], 1, {}), ("fine", ["close"], -1, {}), ("fine", ["close"], True, {}), ("fine", ["close"], 1, {"direction": 0}), ("fine", ["close"], 1, {"preprocessing": "log"})]:
        fn.__name__ = name
        with pytest.raises(ValueError):
            registry.factor(fields, warmup, **how)(fn)
    assert "fine" not in registry.USER


def test_users_factors_see_their_fields_only(spark, sf_dir, monkeypatch):
    bars = views.bars_dy(spark, sf_dir)
    fields = frozenset({"close"})
    monkeypatch.setitem(registry.USER, "peeks", registry.UserFactor("peeks", lambda panel, params: F.col("volume"), fields, 0))
    with pytest.raises(Exception, match="volume"):
        registry.evaluate(bars, ["peeks"])
    monkeypatch.setitem(registry.USER, "wrong", registry.UserFactor("wrong", lambda panel, params: 1.0, fields, 0))
    with pytest.raises(TypeError):
        registry.evaluate(bars, ["wrong"])


def test_formulas_read_users_factors_and_share_stages(spark, sf_dir):
    bars = views.bars_dy(spark, sf_dir)
    both = registry.evaluate(bars, ["user_widest_range", "volatility_efficiency"])
    alone = [registry.evaluate(bars, [n]) for n in ("user_widest_range", "volatility_efficiency")]
    met = both.join(alone[0].withColumnRenamed("user_widest_range", "a"), ["instrument", "date"]).join(alone[1].withColumnRenamed("volatility_efficiency", "b"), ["instrument", "date"])
    assert met.filter("not (user_widest_range <=> a and volatility_efficiency <=> b)").count() == 0
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(both) == exchanges(alone[1])
    long = registry.prepared(both, ["user_widest_range"])
    assert long.agg(F.min("value"), F.max("value")).first()[:] == (-1.0, 1.0)


def test_output_check_finds_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "d", 1.0), (1, "d", 2.0), (2, "d", None), (3, "d", float("nan")), (4, "d", float("inf"))], "instrument int, date string, f double")
    assert tuple(registry.check_output(df, ["f"]).first()) == ("f", 5, 1, 1, 2)


def test_values_are_used_again_only_where_everything_is_the_same(spark, stored, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    serve = lambda names=NAMES, start=START, end=END, **how: reuse.serve(spark, stored, store, names, start, end, **how)
    first = serve()
    assert not first.reused
    assert serve().path == first.path and serve(names=NAMES[::-1]).reused
    shorter = serve(end=dt.date(1996, 4, 1))
    assert shorter.reused and shorter.values.agg(F.max("date")).first()[0] == dt.date(1996, 4, 1)
    assert not serve(end=dt.date(1996, 4, 25)).reused  # a longer range
    assert not serve(settings={"mode": "rank"}).reused and not serve(start=dt.date(1996, 3, 6), settings={"mode": "rank"}).reused
    again = serve()
    changed = registry.UserFactor("user_volume_weighted_move", lambda panel, params: F.col("close") + F.col("volume"), frozenset({"close", "volume"}), 4)
    monkeypatch.setitem(registry.USER, "user_volume_weighted_move", changed)
    assert again.path != first.path and not serve().reused


def test_inputs_count_only_within_the_range(spark, tmp_path, sf_dir):
    at, store = str(tmp_path / "bars"), str(tmp_path / "store")
    bars = views.bars_dy(spark, sf_dir)
    scan.write(bars.filter("date between date'1996-01-01' and date'1996-06-30'"), at)
    assert not reuse.serve(spark, at, store, NAMES[:1], START, END).reused
    add = lambda where: bars.filter(where).withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(at)
    add("date = date'1996-07-10'")
    assert reuse.serve(spark, at, store, NAMES[:1], START, END).reused
    add("date = date'1996-04-10'")
    assert not reuse.serve(spark, at, store, NAMES[:1], START, END).reused


def test_minutes_are_pruned_by_date_and_bucket(spark, tmp_path):
    at = str(tmp_path / "minutes")
    when = lambda d, m: dt.datetime(2024, 1, d, 9, m)
    early = spark.createDataFrame([(i, when(d, m), float(i * m)) for i in range(20) for d in (1, 2) for m in range(3)], "instrument long, ts timestamp, price double")
    late = early.withColumn("ts", F.col("ts") + F.expr("interval 5 days")).withColumn("depth", F.col("price") + 1)
    minutes.write(early, at, 4)
    minutes.write(late, at, 4)
    some = minutes.read(spark, at, ["price", "depth"], dt.date(2024, 1, 2), dt.date(2024, 1, 6), [3, 7], ["depth"], 4)
    node = scan_node(some)
    filters = node.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "bucket#" in filters and "2024-01-02" in filters and "2024-01-06" in filters and "In(instrument" in node
    got = {(r.instrument, r.date.day, r.ts.minute): (r.price, r.depth) for r in some.collect()}
    assert got == {(i, d, m): (float(i * m), float(i * m) + 1 if d == 6 else None) for i in (3, 7) for d in (2, 6) for m in range(3)}
    # a day written again replaces itself, and nothing else
    minutes.write(early.filter("instrument = 3 and ts < '2024-01-02'").withColumn("price", F.lit(-1.0)), at, 4)
    bucket = [i for i in range(20) if spark.range(1).select(minutes.bucket_of(F.lit(i).cast("long"), 4) == minutes.bucket_of(F.lit(3).cast("long"), 4)).first()[0]]
    day = minutes.read(spark, at, ["price"], dt.date(2024, 1, 1), dt.date(2024, 1, 1), buckets=4)
    assert day.filter("instrument = 3").agg(F.max("price")).first()[0] == -1.0 and day.select("instrument").distinct().count() == 20 - len(bucket) + 1
    with pytest.raises(ValueError):
        minutes.read(spark, at, ["spread"], dt.date(2024, 1, 1), dt.date(2024, 1, 1))
