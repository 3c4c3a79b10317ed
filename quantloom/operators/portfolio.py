"""Labels, weights, limits, costs and return ledgers as table jobs keyed by (date, instrument)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quantloom.functions.scalar import EPS, clip, divide, safe_div
from quantloom.operators import rolling as R


def make_labels(panel: DataFrame, horizon: int = 1, out: str = "label") -> DataFrame:
    """Return from the next day's open to the open `horizon` days later."""
    return panel.withColumn(out, divide(R.lead("open", 1 + horizon), R.lead("open", 1)) - 1)


def ic_weights(ic: DataFrame, window: int) -> DataFrame:
    """Per date and factor: mean / sd of its last `window` ICs strictly before the date (sd near 0: the mean; fewer than two:
    0), scaled so that absolute weights sum to 1 (all zero: equal)."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-window, -1)
    m, s, n = F.avg("ic").over(w), F.stddev_samp("ic").over(w), F.count("ic").over(w)
    raw = F.when(n < 2, 0.0).otherwise(F.when(s > EPS, m / s).otherwise(m))
    ic = ic.withColumn("_raw", raw)
    day = Window.partitionBy("date")
    size = F.sum(F.abs("_raw")).over(day)
    return ic.withColumn("weight", F.when(size > EPS, F.col("_raw") / size).otherwise(1.0 / F.count("*").over(day))).drop("_raw")


def top_n_equal(panel: DataFrame, x: str, n: int, every: int = 1, eligible: str | None = None) -> DataFrame:
    """date, instrument, weight: the n largest of each `every`-th date at equal weight, ties to the smaller instrument."""
    p = panel.filter(F.col(x).isNotNull()) if eligible is None else panel.filter(F.col(x).isNotNull() & F.col(eligible))
    dates = panel.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")) - 1).filter(F.col("_n") % every == 0)
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(x), "instrument"))
    chosen = p.join(F.broadcast(dates.select("date")), "date", "left_semi").withColumn("_p", place).filter(F.col("_p") <= n)  # a row per date
    return chosen.select("date", "instrument", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def limit_targets(targets: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One scale per date, the least of limit / exposure over gross, long, short, single and net, at most 1; which limit binds."""
    e = targets.groupBy("date").agg(
        F.sum(F.abs("weight")).alias("gross"), F.sum(F.greatest("weight", F.lit(0.0))).alias("long"), (-F.sum(F.least("weight", F.lit(0.0)))).alias("short"),
        F.max(F.abs("weight")).alias("single"), F.abs(F.sum("weight")).alias("net"),
    )
    room = {k: F.when(F.col(k) > EPS, F.lit(v) / F.col(k)).otherwise(F.lit(float("inf"))) for k, v in limits.items()}
    scale = F.least(F.lit(1.0), *room.values())
    binding = F.lit("none")
    for k in reversed(list(limits)):
        binding = F.when(room[k] <= scale, F.when(room[k] < 1, k).otherwise(binding)).otherwise(binding)
    return targets.join(e.select("date", scale.alias("scale"), binding.alias("binding")), "date").withColumn("weight", F.col("weight") * F.col("scale"))


def member_targets(panel: DataFrame, x: str, least: int, weights: DataFrame) -> DataFrame:
    """Weights of dates whose factor is usable (enough values, some spread); else zeros with the reason."""
    day = panel.groupBy("date").agg(F.count(x).alias("n"), (F.max(x) - F.min(x)).alias("spread"))
    reason = F.when(F.col("n") < least, "too_few").when(F.coalesce("spread", F.lit(0.0)) <= EPS, "no_spread").otherwise("valid")
    joined = weights.join(day.select("date", reason.alias("reason")), "date")
    return joined.withColumn("weight", F.when(F.col("reason") == "valid", F.col("weight")).otherwise(0.0))


def combine(sleeves: DataFrame, allocation: dict[str, float]) -> DataFrame:
    """Sum of sleeve weights times their allocation."""
    share = F.lit(0.0)
    for k, v in allocation.items():
        share = F.when(F.col("sleeve") == k, v).otherwise(share)
    return sleeves.groupBy("date", "instrument").agg(F.sum(F.col("weight") * share).alias("weight"))


def turnover(weights: DataFrame) -> DataFrame:
    """Per date: sum of absolute weight changes against the date before, and traded names. `turn` numbers the dates."""
    turns = weights.select("date").distinct().withColumn("turn", F.row_number().over(Window.orderBy("date")))
    w = weights.join(F.broadcast(turns), "date")  # a row per date
    now, before = w.select("turn", "instrument", "weight"), w.select((F.col("turn") + 1).alias("turn"), "instrument", F.col("weight").alias("old"))
    j = now.join(before, ["turn", "instrument"], "full_outer").withColumn("move", F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    per = j.groupBy("turn").agg(F.sum(F.abs("move")).alias("turnover"), F.count_if(F.abs("move") > EPS).alias("n_traded"))
    return per.join(turns, "turn").select("date", "turn", "turnover", "n_traded")


def ledger(weights: DataFrame, returns: DataFrame, fee: float) -> DataFrame:
    """Per date: gross return of the weights set the date before, turnover, cost, net return, wealth and drawdown. One row per
    date is all that the running totals see."""
    turns = returns.select("date").distinct().withColumn("turn", F.row_number().over(Window.orderBy("date")))
    held = weights.join(F.broadcast(turns), "date").select((F.col("turn") + 1).alias("turn"), "instrument", "weight")
    r = returns.join(F.broadcast(turns), "date").select("turn", "instrument", "ret")
    gross = held.join(r, ["turn", "instrument"], "left").groupBy("turn").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    out = turns.join(gross, "turn", "left").join(turnover(weights).select("date", "turnover"), "date", "left")
    out = out.select("date", F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    out = out.withColumn("cost", F.col("turnover") * fee).withColumn("net", F.col("gross") - F.col("cost"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("wealth", F.exp(F.sum(F.log1p("net")).over(w)))
    return out.withColumn("drawdown", F.col("wealth") / F.greatest(F.max("wealth").over(w), F.lit(1.0)) - 1)


def orders(targets: DataFrame, prices: DataFrame, fee: float, slippage: float) -> DataFrame:
    """Changes of target quantities: side, notional, fee and slippage of every order."""
    w = Window.partitionBy("instrument").orderBy("date")
    q = targets.join(prices, ["instrument", "date"]).withColumn("quantity", F.try_divide("weight", "close"))
    q = q.withColumn("order_quantity", F.col("quantity") - F.coalesce(F.lag("quantity").over(w), F.lit(0.0))).filter(F.abs("order_quantity") > EPS)
    notional = F.abs(F.col("order_quantity")) * F.col("close")
    return q.select("date", "instrument", F.when(F.col("order_quantity") > 0, "buy").otherwise("sell").alias("side"), "order_quantity", notional.alias("notional"), (notional * fee).alias("fee"), (notional * slippage).alias("slippage"))


def short_list(panel: DataFrame, directions: dict[str, int], n: int) -> DataFrame:
    """The n instruments of each date with the smallest sums of directed ranks."""
    day = Window.partitionBy("date")
    total = F.lit(0.0)
    for x, d in directions.items():
        v = d * F.col(x)
        total = total + F.rank().over(day.orderBy(F.asc_nulls_last(v))) + (F.count("*").over(Window.partitionBy("date", v)) - 1) / 2
    have = F.lit(True)
    for x in directions:
        have = have & F.col(x).isNotNull()
    p = panel.filter(have).withColumn("score", total)
    return p.withColumn("place", F.row_number().over(day.orderBy("score", "instrument"))).filter(F.col("place") <= n)


def exposure(score, low: float, high: float):
    """A score in -1..1 mapped to an exposure between bounds."""
    return clip(low + (high - low) * (F.col(score) + 1) / 2, low, high)


def sleeves_to_returns(sleeves: DataFrame) -> DataFrame:
    """Returns of equal capital in each sleeve, left alone: wealth per sleeve, mean over sleeves, back to returns."""
    w = Window.partitionBy("sleeve").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = sleeves.withColumn("_wealth", F.exp(F.sum(F.log1p("ret")).over(w))).groupBy("date").agg(F.avg("_wealth").alias("wealth"))
    return s.withColumn("ret", F.col("wealth") / F.coalesce(F.lag("wealth").over(Window.orderBy("date")), F.lit(1.0)) - 1)


def calendar_spine(panel: DataFrame, step: str = "interval 1 day") -> DataFrame:
    """Every instrument on every date of the panel's range."""
    days = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(step))).alias("date"))
    return panel.select("instrument").distinct().crossJoin(F.broadcast(days))  # the calendar: one row a day


def crowding(front: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """Crowding distance of a front: per objective the gap between neighbours over the range, infinite at the ends."""
    total = F.lit(0.0)
    for m in objectives:
        w = Window.orderBy(m, key)
        span = F.max(m).over(Window.partitionBy()) - F.min(m).over(Window.partitionBy())
        total = total + F.coalesce(F.try_divide(F.lead(m).over(w) - F.lag(m).over(w), span), F.lit(float("inf")))
    return front.withColumn("crowding", total)


def greedy_decorrelation(order: Sequence[str], pairs: dict[tuple[str, str], float], limit: float) -> list[str]:
    """Names in order, each kept if it correlates below the limit with all kept; the pair table has a row per pair of factors."""
    kept: list[str] = []
    for name in order:
        if all(abs(pairs.get((min(name, k), max(name, k)), 0.0)) < limit for k in kept):
            kept.append(name)
    return kept


def average_linkage(names: Sequence[str], pairs: dict[tuple[str, str], float], limit: float) -> list[list[str]]:
    """Clusters of factors by average linkage on 1 - |correlation|: the closest two are merged while their mean distance is at most
    the limit; ties go to the names first in order. Pairs without a correlation are 1 apart; the table has a row per pair."""
    gap = lambda a, b: 1 - abs(pairs.get((min(a, b), max(a, b)), 0.0) or 0.0)
    groups = [[n] for n in sorted(names)]
    while len(groups) > 1:
        d, i, j = min((sum(gap(a, b) for a in g for b in h) / (len(g) * len(h)), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if d > limit:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups
