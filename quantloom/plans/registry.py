"""A user's own factors beside the catalogue's.

A user factor is a function fn(panel, params) -> Column over the columns of a panel, with the fields it reads, the days of history it
needs, and its direction. It becomes a column of the panel before the formulas' stages, so any number of user factors and
catalogue formulas run as one staged job, and a formula can read a user factor like a field.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.operators import cross_section as X
from quantloom.plans import catalogue, formula

KEY = ["instrument", "date"]


@dataclass(frozen=True)
class UserFactor:
    name: str
    fn: Callable[[DataFrame, Mapping], Column]
    fields: frozenset[str]
    warmup: int
    direction: int = 1
    preprocessing: str = "mad_rank"
    params: Mapping = dataclass_field(default_factory=dict)

    def source(self) -> str:
        """What identifies the factor's code."""
        return inspect.getsource(self.fn)


USER: dict[str, UserFactor] = {}


def factor(fields: Iterable[str], warmup: int, direction: int = 1, preprocessing: str = "mad_rank", **params):
    """Register fn under its name; what can't be meant is refused here, not when a job reaches it."""

    def register(fn: Callable[[DataFrame, Mapping], Column]) -> Callable[[DataFrame, Mapping], Column]:
        name = fn.__name__
        if name in catalogue.FACTORS:
            raise ValueError(f"the catalogue has a factor {name}")
        if not name.isidentifier() or name in KEY or name.startswith("_"):
            raise ValueError(f"{name} can't be the name of a factor")
        if not frozenset(fields):
            raise ValueError(f"{name} declares no fields")
        if isinstance(warmup, bool) or not isinstance(warmup, int) or warmup < 0:
            raise ValueError("warm-up is a number of days")
        if direction not in (1, -1) or preprocessing not in ("none", "mad_rank"):
            raise ValueError("direction is 1 or -1, preprocessing none or mad_rank")
        USER[name] = UserFactor(name, fn, frozenset(fields), warmup, direction, preprocessing, params)
        return fn

    return register


def needs(names: Iterable[str]) -> tuple[frozenset[str], int]:
    """Fields and days of history of some factors."""
    known = [USER.get(n) or catalogue.FACTORS[n] for n in names]
    return frozenset().union(*(k.fields for k in known)), max([0, *(k.warmup for k in known)])


def fingerprint(name: str) -> str:
    """Hash of a factor's definition: its formula, or its function's text and parameters."""
    user = USER.get(name)
    told = user.source() + repr(sorted(user.params.items())) if user else formula.formula_id(catalogue.FACTORS[name].formula)
    return hashlib.sha256(told.encode()).hexdigest()


def evaluate(panel: DataFrame, names: Iterable[str], eligible: str | None = None) -> DataFrame:
    """instrument, date and a column per factor, the user's and the catalogue's in one job. A user factor sees the key, the day and the
    fields it declared, and nothing else."""
    names = list(names)
    user = [USER[n] for n in names if n in USER]
    columns = {}
    for f in user:
        seen = panel.select(*KEY, "day", *sorted(f.fields))
        out = f.fn(seen, f.params)
        if not isinstance(out, Column):
            raise TypeError(f"{f.name} returns no column")
        seen.select(out)  # a field that wasn't declared fails here
        columns[f.name] = out.cast("double")
    panel = panel.select("*", *[c.alias(n) for n, c in columns.items()])
    trees = {n: formula.field(n) if n in USER else catalogue.FACTORS[n].formula for n in names}
    return formula.evaluate(panel, trees, eligible)


def check_output(values: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row per factor: rows, keys that repeat, and values that are missing or not finite. A job of one aggregation."""
    names = list(names)
    n = values.groupBy(*KEY).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in names], *[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"_b_{c}") for c in names])
    total = n.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("_n") > 1).alias("repeated"), *[F.coalesce(F.sum(f"_{k}_{c}"), F.lit(0)).alias(f"_{k}_{c}") for k in "mb" for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"_m_{c}").alias("missing"), F.col(f"_b_{c}").alias("not_finite")) for c in names]))
    return total.select("n_rows", "repeated", each.alias("f")).select("f.factor", "n_rows", "repeated", "f.missing", "f.not_finite")


def prepared(values: DataFrame, names: Iterable[str]) -> DataFrame:
    """Long table (factor, instrument, date, value) in the factors' own preprocessing: values, or ranks scaled on each date."""
    names = list(names)
    known = {n: USER.get(n) or catalogue.FACTORS[n] for n in names}
    wide = values.select(*KEY, *[(X.rank_to_unit(n) if known[n].preprocessing == "mad_rank" else F.col(n)).alias(n) for n in names])
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), (F.col(n) * known[n].direction).alias("value")) for n in names]))
    return wide.select(*KEY, long.alias("f")).select("f.factor", *KEY, "f.value").filter("value is not null")


def coverage(values: DataFrame, names: Iterable[str]) -> DataFrame:
    """Per date the share of instruments with a value, a column per factor."""
    return values.groupBy("date").agg(*[(F.count(n) / F.count("*")).alias(n) for n in names])


__all__ = ["USER", "UserFactor", "check_output", "coverage", "evaluate", "factor", "fingerprint", "needs", "prepared", "Window"]
