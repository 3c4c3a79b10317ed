"""Candidates against the market, their neighbours and each other: ledgers of many variants in one job, behaviour evidence, stability of
parameters, and deduplication by daily rank correlation.

Pairs and orders of candidates are small tables (a row per candidate or pair) of at most MOST candidates; what comes from cells stays
in Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quantloom.operators import rolling as R

MOST = 2000
#: Tasks that cells of pairs of factors are dealt to: a task sorts all its pairs and dates at once.
TASKS = 256


def calendar(returns: DataFrame) -> DataFrame:
    """The dates numbered from 1: a row per date, broadcast below."""
    return returns.select("date").distinct().withColumn("turn", F.row_number().over(Window.orderBy("date")))


def ledgers(weights: DataFrame, returns: DataFrame, fee: float) -> DataFrame:
    """variant, date, gross, turnover and net: weights (variant, date, instrument, weight) earn the next date's returns; a date without weights
    holds nothing, and changes against the date before pay the fee. All variants are one job; a variant has a row for every date."""
    turns = calendar(returns)
    w = weights.join(F.broadcast(turns), "date").select("variant", "turn", "instrument", "weight")
    r = returns.join(F.broadcast(turns), "date").select("turn", "instrument", "ret")
    none = F.lit(0.0)
    sides = F.array(F.struct("turn", "weight", none.alias("old")), F.struct((F.col("turn") + 1).alias("turn"), none.alias("weight"), F.col("weight").alias("old")))
    held = w.select("variant", "instrument", F.explode(sides).alias("s")).groupBy("variant", "s.turn", "instrument").agg(F.sum("s.weight").alias("weight"), F.sum("s.old").alias("old"))
    j = held.join(r, ["turn", "instrument"], "left")
    cells = j.groupBy("variant", "turn").agg(
        F.sum(F.coalesce("old", F.lit(0.0)) * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover")
    )
    every = weights.select("variant").distinct().join(F.broadcast(turns))  # variants by dates: the ledger's rows
    out = every.join(cells, ["variant", "turn"], "left").fillna(0.0, ["gross", "turnover"])
    return out.select("variant", "date", "gross", "turnover", (F.col("gross") - F.col("turnover") * fee).alias("net"))


def results(ledger: DataFrame) -> DataFrame:
    """Per variant the total return and the ratio of mean to spread of its net returns."""
    return ledger.groupBy("variant").agg((F.product(1 + F.col("net")) - 1).alias("total_return"), F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sharpe"))


def stability(told: DataFrame, base: str, least: float = 0.5) -> DataFrame:
    """One row: how the neighbours of `base` (all other variants of `results`) fare. A neighbour passes with a positive total return and
    ratio; what the median neighbour loses against the base, and what the share of passes lacks, add up to the penalty. Neighbours
    may lower a score but never raise it."""
    own = F.col("variant") == base
    other = lambda c: F.percentile(F.when(~own, F.col(c)), F.lit(0.5))
    passed = F.coalesce((F.col("total_return") > 0) & (F.col("sharpe") > 0), F.lit(False))
    row = told.agg(
        F.count_if(~own).alias("variant_count"), F.avg(F.when(~own, passed.cast("int"))).alias("positive_fraction"), other("total_return").alias("median_return"), other("sharpe").alias("median_sharpe"),
        F.max(F.when(own, F.col("total_return"))).alias("_return"), F.max(F.when(own, F.col("sharpe"))).alias("_sharpe"),
    )
    lost = lambda base_, median: F.when(F.col(median).isNotNull(), F.greatest(F.col(base_) - F.col(median), F.lit(0.0))).otherwise(F.greatest(F.abs(base_), F.lit(1.0)))
    none = F.col("variant_count") == 0
    row = row.select(
        "variant_count", "positive_fraction", "median_return", "median_sharpe", F.when(none, 0.0).otherwise(lost("_return", "median_return")).alias("return_degradation"),
        F.when(none, 0.0).otherwise(lost("_sharpe", "median_sharpe")).alias("sharpe_degradation"), F.when(none, 0.0).otherwise(F.greatest(least - F.col("positive_fraction"), F.lit(0.0))).alias("shortfall"),
    )
    return row.withColumn("penalty", F.col("return_degradation") + F.col("sharpe_degradation") + F.col("shortfall"))


def market_proxy(panel: DataFrame) -> DataFrame:
    """date and market: mean open-to-open return over the instruments that were eligible on the day before."""
    moved = panel.select("date", (F.try_divide("open", R.ref("open", 1)) - 1).alias("move"), R.ref(F.col("eligible").cast("int"), 1).alias("member"))
    return moved.filter("member = 1").groupBy("date").agg(F.avg("move").alias("market"))


def behaviour(net: DataFrame, panel: DataFrame) -> DataFrame:
    """One row about a candidate's net returns (date, net, turnover): days that it shares with the market proxy, slope and correlation
    against it (from four days on, where the market moves), mean turnover, first and last date."""
    j = net.join(market_proxy(panel), "date", "left")
    both = F.col("net").isNotNull() & F.col("market").isNotNull()
    a, m = F.when(both, F.col("net")), F.when(both, F.col("market"))
    moves = (F.count(a) >= 4) & (F.var_samp(m) > 1e-16)
    return j.agg(
        F.count(a).alias("n_days"), F.when(moves, F.try_divide(F.covar_samp(a, m), F.var_samp(m))).alias("market_beta"),
        F.when(moves & (F.stddev_samp(a) > 1e-12), F.try_divide(F.covar_samp(a, m), F.stddev_samp(a) * F.stddev_samp(m))).alias("market_correlation"), F.avg("turnover").alias("turnover"),
        F.min("date").alias("period_start"), F.max("date").alias("period_end"),
    )


def daily_similarity(values: DataFrame, least: int = 20) -> DataFrame:
    """Per pair of factors (f before g) of a long table (factor, instrument, date, value): common_days, the dates on which at least so many
    instruments have both, and the mean absolute rank correlation over these."""
    v = values.filter("value is not null").repartition(TASKS, "instrument", "date")
    a, b = (v.select("instrument", "date", F.col("factor").alias(f), F.col("value").alias(x)) for f, x in (("f", "x"), ("g", "y")))
    p = a.join(b, ["instrument", "date"]).filter("f < g").select("f", "g", "date", "x", "y").repartition(TASKS, "f", "g", "date")
    for c in ("x", "y"):
        by = Window.partitionBy("f", "g", "date")
        p = p.withColumn(f"r{c}", F.rank().over(by.orderBy(c)) + (F.count("*").over(Window.partitionBy("f", "g", "date", c)) - 1) / 2)
    corr = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    daily = p.groupBy("f", "g", "date").agg(F.when(F.count("*") >= least, F.abs(corr)).alias("c"))
    return daily.groupBy("f", "g").agg(F.count("c").alias("common_days"), F.round(F.avg("c"), 9).alias("similarity"))


def deduplicate(order: Sequence[str], pairs: DataFrame, least_days: int = 120, limit: float = 0.90, most: int = 20, families: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, bool, list[str]]]:
    """Candidates in order, whether each is accepted, and why not: too few days in common with one accepted before, as similar as the limit to
    it, more than a quarter of the places in one of its families, or no place left. `pairs` is what `daily_similarity` gives."""
    if len(order) > MOST:
        raise ValueError(f"more than {MOST} candidates")
    known = {(p["f"], p["g"]): (p["common_days"], p["similarity"]) for p in pairs.collect()}
    accepted: list[str] = []
    out = []
    per_family = max(1, (most + 3) // 4)
    for c in order:
        reasons = []
        for a in accepted:
            days, similarity = known.get((min(a, c), max(a, c)), (0, None))
            if days < least_days:
                reasons.append(f"overlap with {a}")
            elif similarity is not None and similarity >= limit:
                reasons.append(f"duplicate of {a}")
        for f in (families or {}).get(c, ()):
            if sum(f in (families or {}).get(a, ()) for a in accepted) >= per_family:
                reasons.append(f"family {f}")
        if len(accepted) >= most:
            reasons.append("no place left")
        if not reasons:
            accepted.append(c)
        out.append((c, not reasons, reasons))
    return out


def _summary(by: list[str], ledger: DataFrame, net: str, periods: int) -> DataFrame:
    """total_return, sharpe (yearly) and max_drawdown of net returns in order of date within `by`: a row per date and variant."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    p = ledger.withColumn("_wealth", F.product(1 + F.col(net)).over(w))
    p = p.withColumn("_peak", F.greatest(F.max("_wealth").over(w), F.lit(1.0)))
    sharpe = F.try_divide(F.avg(net), F.stddev_samp(net)) * periods**0.5
    return p.groupBy(*by).agg((F.product(1 + F.col(net)) - 1).alias("total_return"), sharpe.alias("sharpe"), F.max(1 - F.col("_wealth") / F.col("_peak")).alias("max_drawdown"), F.count("*").alias("n"))


def net_stability(ledger: DataFrame, periods: int = 365) -> DataFrame:
    """Per variant of a net ledger: the whole range and its quarters. Quarters contribute in wealth, so contributions add up to the change of
    wealth; concentration is the best quarter's share of the positive ones (null without any), and the best quarter, of equals the latest,
    is left out for the remaining return and ratio."""
    q = F.concat(F.year("date"), F.lit("Q"), F.quarter("date"))
    led = ledger.select("variant", "date", "net", q.alias("quarter"))
    w = Window.partitionBy("variant").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    led = led.withColumn("_after", F.product(1 + F.col("net")).over(w))
    gain = F.max_by("_after", "date") - F.min_by(F.col("_after") / (1 + F.col("net")), "date")
    quarters = _summary(["variant", "quarter"], led, "net", periods).join(led.groupBy("variant", "quarter").agg(gain.alias("contribution")), ["variant", "quarter"])
    best = quarters.groupBy("variant").agg(F.max(F.struct("contribution", "quarter")).alias("b")).select("variant", F.col("b.quarter").alias("best_quarter"))
    left = led.join(best, "variant").filter("quarter <> best_quarter")
    remaining = _summary(["variant"], left, "net", periods).select("variant", F.col("total_return").alias("remaining_return"), F.col("sharpe").alias("remaining_sharpe"))
    top = F.max(F.greatest("contribution", F.lit(0.0)))
    gained = F.sum(F.greatest("contribution", F.lit(0.0)))
    told = quarters.groupBy("variant").agg(
        F.count("*").alias("n_quarters"), F.count_if(F.col("contribution") > 0).alias("positive_quarters"), F.count_if(F.col("total_return") > 0).alias("rising_quarters"), F.min("total_return").alias("worst_quarter_return"),
        F.when(gained > 0, top / gained).alias("concentration"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"), F.stddev_pop("sharpe").alias("sd_sharpe"), F.min("sharpe").alias("worst_sharpe"), F.max("max_drawdown").alias("worst_drawdown"),
    )
    whole = _summary(["variant"], led, "net", periods).select("variant", "total_return", "sharpe", "max_drawdown")
    return whole.join(told, "variant").join(best, "variant").join(remaining, "variant", "left")


def cost_score(stability: DataFrame, nodes: Mapping[str, int], spread: float = 0.5, worst: float = 1.0, drawdown: float = 1.0, complexity: float = 0.001, concentration: float = 0.5, most: float = 0.6, left_out: float = 0.5, least_sharpe: float = 1.0) -> DataFrame:
    """variant, score and reasons: the median quarterly ratio less penalties for its spread, the worst quarter, the deepest quarterly drawdown,
    the formula's nodes, a concentration above `most`, and a negative ratio without the best quarter; and why a variant isn't eligible."""
    count = F.create_map(*[F.lit(x) for kv in nodes.items() for x in kv])[F.col("variant")]
    below = lambda c: F.greatest(-F.col(c), F.lit(0.0))
    score = (
        F.col("median_sharpe") - spread * F.col("sd_sharpe") - worst * below("worst_sharpe") - drawdown * F.col("worst_drawdown") - complexity * count
        - concentration * F.greatest(F.col("concentration") - most, F.lit(0.0)) - left_out * below("remaining_sharpe")
    )
    s = stability.withColumn("score", F.when(F.col("concentration").isNotNull() & F.col("remaining_sharpe").isNotNull(), score))
    tests = {
        "return is not positive": F.col("total_return") <= 0, "sharpe is not above its bar": F.col("sharpe") <= least_sharpe,
        "no majority of rising quarters": F.col("rising_quarters") * 2 <= F.col("n_quarters"), "score is not positive": ~F.coalesce(F.col("score") > 0, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return s.select("variant", "score", F.concat_ws("; ", reasons).alias("reasons"))


def cost_gates(stability: DataFrame, stressed: DataFrame, positive: int = 3, loss: float = 0.10, remaining: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """variant, passed and reasons: enough quarters with a gain, no quarter below the loss, a return and a ratio left without the best quarter, and
    both still positive in `stressed`, the stability of the same ledger under higher costs."""
    hard = stressed.select("variant", F.col("total_return").alias("_hard_return"), F.col("sharpe").alias("_hard_sharpe"))
    s = stability.join(hard, "variant")
    tests = {
        "too few quarters with a gain": F.col("positive_quarters") < positive, "a quarter loses too much": F.col("worst_quarter_return") < -loss,
        "little return without the best quarter": ~F.coalesce(F.col("remaining_return") > remaining[0], F.lit(False)), "low sharpe without the best quarter": ~F.coalesce(F.col("remaining_sharpe") > remaining[1], F.lit(False)),
        "lost under higher costs": ~F.coalesce((F.col("_hard_return") > 0) & (F.col("_hard_sharpe") > 0), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return s.select("variant", (F.size(reasons) == 0).alias("passed"), F.concat_ws("; ", reasons).alias("reasons"))
