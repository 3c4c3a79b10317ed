"""Joins that keep data point-in-time: intervals, as-of, schedules, coverage and prefix comparison.

Interval joins turn intervals into days (bounded by the calendar) and join on equality, so that no range join compares all
pairs. As-of joins are a union in time order and a running last value, one shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def calendar_bounds(panel: DataFrame) -> DataFrame:
    """One row: first and last date."""
    return panel.agg(F.min("date").alias("first"), F.max("date").alias("last"))


def members_by_date(intervals: DataFrame, bounds: DataFrame) -> DataFrame:
    """date, instrument of every active day: from the later of decision and start, to the end or the calendar's last day.
    `bounds` is one row."""
    start = F.greatest("effective_date", "decision_date", "first")
    end = F.least(F.coalesce("effective_end_date", "last"), F.col("last"))
    days = intervals.crossJoin(F.broadcast(bounds)).withColumn("_from", start).withColumn("_to", end).filter("_from <= _to")
    return days.select("instrument", F.explode(F.sequence("_from", "_to")).alias("date")).distinct()


def of_members(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of members on the very day."""
    return panel.join(members, ["instrument", "date"], "left_semi")


def history_of_members(panel: DataFrame, members: DataFrame) -> DataFrame:
    """All history of whoever is a member on some day."""
    return panel.join(members.select("instrument").distinct(), "instrument", "left_semi")


def complete_days(panel: DataFrame, members: DataFrame, complete: Column) -> DataFrame:
    """Rows of days on which all members have a complete row."""
    joined = members.join(panel.withColumn("_full", complete).select("instrument", "date", "_full"), ["instrument", "date"], "left")
    days = joined.groupBy("date").agg(F.bool_and(F.coalesce("_full", F.lit(False))).alias("_all")).filter("_all").select("date")
    return panel.join(members, ["instrument", "date"], "left_semi").join(days, "date", "left_semi")


def nearest_earlier(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose instrument is in the universe of the latest universe date at or before the row's: each universe date holds
    until the day before the next, which is an interval."""
    dates = universe.select(F.col("date").alias("u_date")).distinct()
    nxt = F.lead("u_date").over(Window.orderBy("u_date"))  # one row per universe date
    held = dates.select("u_date", F.coalesce(F.date_sub(nxt, 1), F.to_date(F.lit("9999-12-31"))).alias("until"))
    days = panel.select("date").distinct()
    latest = days.join(F.broadcast(held), (F.col("date") >= F.col("u_date")) & (F.col("date") <= F.col("until"))).select("date", "u_date")
    keys = latest.join(universe.withColumnRenamed("date", "u_date"), "u_date").select("date", "instrument")
    return panel.join(keys, ["date", "instrument"], "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, value: str, at: str = "day", default: float | None = None) -> DataFrame:
    """left with the latest non-null `value` of right at or before left's time, per key."""
    cols = [c for c in left.columns]
    both = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_v", ignorenulls=True).over(w)
    out = both.withColumn(value, found if default is None else F.coalesce(found, F.lit(default)))
    return out.filter("_side = 1").select(*cols, value)


def align(frames: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Full outer alignment of factors of different cadence on (instrument, date), each carried forward per instrument. A
    union and one grouping take the place of chained outer joins."""
    parts = [f.select("instrument", "date", F.lit(n).alias("factor"), F.col(value).alias("value")) for n, f in frames.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy("instrument", "date").agg(*[F.max(F.when(F.col("factor") == n, F.col("value"))).alias(n) for n in frames])
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("instrument", "date", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in frames])


def weighted_by_date(panel: DataFrame, weights: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Sum of factors by the date's weights (columns w_<factor>); a date whose weights are all missing weighs equally."""
    none = F.lit(True)
    for f in factors:
        none = none & F.col(f"w_{f}").isNull()
    total = F.lit(0.0)
    for f in factors:
        total = total + F.when(none, 1.0 / len(factors)).otherwise(F.coalesce(F.col(f"w_{f}"), F.lit(0.0))) * F.coalesce(F.col(f), F.lit(0.0))
    return panel.join(weights, "date", "left").withColumn("value", total)


def research_panel(members: DataFrame, bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Member days with their bar and daily funding, and flags for what is there."""
    b = bars.select("instrument", "date", "close", "volume", F.lit(True).alias("_bar"))
    f = funding.select("instrument", "date", "rate_sum", "event_count")
    joined = members.join(b, ["instrument", "date"], "left").join(f, ["instrument", "date"], "left")
    return joined.select(
        "instrument", "date", "close", "volume", "rate_sum", F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("_bar", F.lit(False)).alias("has_bar"), F.col("event_count").isNotNull().alias("has_funding"),
    )


def schedule_status(expected: DataFrame, events: DataFrame, drift_seconds: float = 1.0) -> DataFrame:
    """Compare expected times (array per instrument and date; empty: none due) with the day's event times, both in order."""
    got = events.groupBy("instrument", "date").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    j = expected.join(got, ["instrument", "date"], "left").withColumn("times", F.coalesce("times", F.filter("expected_times", lambda x: F.lit(False))))
    want = F.array_sort("expected_times")
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    close = F.forall(F.zip_with(want, "times", lambda a, b: F.abs(micros(a) - micros(b)) <= int(drift_seconds * 1e6)), lambda x: x)
    status = (
        F.when(F.col("expected_times").isNull(), "unknown")
        .when((F.size("expected_times") == 0) & (F.size("times") == 0), "not_applicable")
        .when((F.size("expected_times") == F.size("times")) & F.coalesce(close, F.lit(False)), "complete")
        .when(F.size("times") < F.size("expected_times"), "missing")
        .otherwise("schedule_mismatch")
    )
    return j.select("instrument", "date", status.alias("status"), F.size("times").alias("n_times"))


def interval_ends(decisions: DataFrame, date: str = "effective_date") -> DataFrame:
    """Each decision date's interval end: the day before the next decision, null for the last."""
    dates = decisions.select(date).distinct()
    end = F.date_sub(F.lead(date).over(Window.orderBy(date)), 1)
    return decisions.join(F.broadcast(dates.withColumn("interval_end", end)), date)  # a row per decision date


def fallback_map(rows: DataFrame, chain: Sequence[DataFrame], key: str, target: str) -> DataFrame:
    """The first mapping of the chain that has the key, and its place in the chain (null: an issue)."""
    out = rows
    for i, m in enumerate(chain):
        out = out.join(m.select(key, F.col(target).alias(f"_t{i}")), key, "left")
    found = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias(target), F.lit(i).alias("source"))) for i in range(len(chain))])
    return out.withColumn("_m", found).select(*rows.columns, F.col(f"_m.{target}").alias(target), F.col("_m.source").alias("source"))


def unique_both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in which each side has one partner only."""
    p = pairs.select(a, b).distinct()
    n_a, n_b = F.count("*").over(Window.partitionBy(a)), F.count("*").over(Window.partitionBy(b))
    return p.withColumn("_a", n_a).withColumn("_b", n_b).filter("_a = 1 and _b = 1").drop("_a", "_b")


def monthly_universe(snapshots: DataFrame, n: int) -> DataFrame:
    """The n heaviest instruments of each month's first snapshot (date, instrument, symbol, weight) that have one symbol, share it
    with no other and were seen before that date. The table of first dates has a row per month."""
    rows = snapshots.groupBy("date", "instrument", "symbol").agg(F.sum("weight").alias("weight"))
    first = rows.groupBy(F.date_trunc("month", "date").alias("_m")).agg(F.min("date").alias("date")).select("date")
    rows = rows.join(F.broadcast(first), "date", "left_semi")
    alone = lambda c: F.count("*").over(Window.partitionBy("date", c)) == 1
    rows = rows.withColumn("_alone", alone("instrument") & alone("symbol")).filter("_alone").drop("_alone")
    seen = snapshots.groupBy("instrument").agg(F.min("date").alias("_seen"))
    rows = rows.join(seen, "instrument").filter(F.col("_seen") < F.col("date")).drop("_seen")
    order = Window.partitionBy("date").orderBy(F.desc("weight"), "instrument")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def settle_funding(positions: DataFrame, events: DataFrame, opens: DataFrame) -> DataFrame:
    """Funding cash of positions at events: -quantity * price * rate, at the event's mark if positive, else the day's open, else
    unresolved."""
    j = positions.join(events, ["instrument", "date"]).join(opens.select("instrument", "date", F.col("open").alias("_open")), ["instrument", "date"], "left")
    price = F.when(F.col("mark_price") > 0, F.col("mark_price")).when(F.col("_open") > 0, F.col("_open"))
    source = F.when(F.col("mark_price") > 0, "mark").when(F.col("_open") > 0, "open").otherwise("unresolved")
    return j.select("instrument", "date", "event_id", source.alias("price_source"), (-F.col("quantity") * price * F.col("rate")).alias("cash"))


def compare_prefix(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", atol: float = 1e-9) -> DataFrame:
    """One row: how two tables differ in keys, in missing values and in values."""
    left = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    j = left.join(right, list(keys), "full_outer")
    both = F.col("_in_a") & F.col("_in_b")
    return j.agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("n_one_side"),
        F.count_if(both & (F.col("_a").isNull() != F.col("_b").isNull())).alias("n_null_mismatch"),
        F.count_if(F.abs(F.col("_a") - F.col("_b")) > atol).alias("n_value_mismatch"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"),
    )


def factor_pairs(long: DataFrame, least: int = 3) -> DataFrame:
    """factor_a < factor_b, days, mean daily Spearman and pooled Pearson of every pair of factors in a long table
    (factor, instrument, date, value). The pairs join on the cell, so their number is cells times factor pairs."""
    w = Window.partitionBy("factor", "date")
    rank = F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy("factor", "date", "value")) - 1) / 2
    ranked = long.filter("value is not null").withColumn("rank", rank)
    a, b = (ranked.select("instrument", "date", F.col("factor").alias(f"factor_{s}"), F.col("value").alias(f"v{s}"), F.col("rank").alias(f"r{s}")) for s in "ab")
    pairs = a.join(b, ["instrument", "date"]).filter("factor_a < factor_b")
    pearson = lambda x, y: F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    daily = pairs.groupBy("factor_a", "factor_b", "date").agg(F.count("*").alias("n"), pearson("ra", "rb").alias("spearman")).filter(F.col("n") >= least)
    pooled = pairs.groupBy("factor_a", "factor_b").agg(pearson("va", "vb").alias("pooled_pearson"))
    return daily.groupBy("factor_a", "factor_b").agg(F.count("spearman").alias("n_days"), F.avg("spearman").alias("mean_spearman")).join(pooled, ["factor_a", "factor_b"])


def basket_change(baskets: DataFrame) -> DataFrame:
    """Per date (rebalance number `turn`), how many instruments entered and left."""
    now = baskets.select("turn", "instrument", F.lit(1).alias("now"))
    before = baskets.select((F.col("turn") + 1).alias("turn"), "instrument", F.lit(1).alias("before"))
    j = now.join(before, ["turn", "instrument"], "full_outer")
    return j.groupBy("turn").agg(F.count_if(F.col("before").isNull()).alias("entered"), F.count_if(F.col("now").isNull()).alias("left_out"))
