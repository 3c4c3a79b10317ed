"""Formula trees over a panel, compiled to staged columns.

A formula is an immutable tree of named operators. Elementwise operators fold into one expression; each rolling or
cross-section operator becomes a column of its own, because windows can't nest. Columns are added level by level, one
`select` a level, and equal sub-trees share one column, so any number of formulas over one panel costs one chain of
stages. Rolling levels keep the panel's partitioning by instrument; each change to a cross-section level is one shuffle.

The same tree gives the SQL that its query is checked against.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions import scalar as S
from quantloom.operators import rolling as R


class _Shared(type):
    """Equal nodes are one object, so that sub-trees used many times are walked once."""

    known: dict[tuple, Node] = {}

    def __call__(cls, op: str, args: tuple = (), params: tuple = ()):
        key = op, args, params
        if key not in cls.known:
            cls.known[key] = super().__call__(op, args, params)
        return cls.known[key]


@dataclass(frozen=True, eq=False)
class Node(metaclass=_Shared):
    op: str
    args: tuple[Node, ...] = ()
    params: tuple = ()

    def __add__(self, y): return call("add", self, y)  # noqa: E704
    def __radd__(self, y): return call("add", y, self)  # noqa: E704
    def __sub__(self, y): return call("subtract", self, y)  # noqa: E704
    def __rsub__(self, y): return call("subtract", y, self)  # noqa: E704
    def __mul__(self, y): return call("multiply", self, y)  # noqa: E704
    def __rmul__(self, y): return call("multiply", y, self)  # noqa: E704
    def __truediv__(self, y): return call("safe_div", self, y)  # noqa: E704
    def __rtruediv__(self, y): return call("safe_div", y, self)  # noqa: E704
    def __neg__(self): return call("negate", self)  # noqa: E704
    def __gt__(self, y): return call("gt", self, y)  # noqa: E704
    def __lt__(self, y): return call("gt", y, self)  # noqa: E704


def const(x: float) -> Node:
    return Node("const", (), (float(x),))


def field(name: str) -> Node:
    return Node("field", (), (name,))


def call(op: str, *args, params: tuple = ()) -> Node:
    return Node(op, tuple(a if isinstance(a, Node) else const(a) for a in args), params)


@dataclass(frozen=True)
class Op:
    kind: str  # e: elementwise, ts: rolling, cs: cross-section
    spark: Callable[..., Column]
    sql: Callable[..., str]
    listed: Callable[..., str] | None = None  # SQL of a window's list that `sql` then works on as `_a`
    commutes: bool = False
    units: Callable[[tuple], str | None] = lambda u: u[0]  # unit of the result; None: mismatch
    least: int = 1  # shortest window
    history: Callable[[tuple], int] = lambda p: (p[0] - 1) if p else 0
    recursive: bool = False  # needs the running count of its argument, as a stage before it


def over(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY day RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, n: int, e: str, least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) OVER {over(n)} >= {least or n} THEN {e} END)"


def _back(x: str, n: int) -> str:
    return f"max({x}) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"


def _win(f: str) -> Callable[..., str]:
    return lambda x, n, least=None: _full(x, n, f"{f}({x}) OVER {over(n)}", least)


def _list(x: str, n: int) -> str:
    return f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {over(n)}"


def _pairs(x: str, y: str) -> tuple[str, str]:
    return f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"


def _corr(x: str, y: str, n: int, least: int | None = None) -> str:
    a, b = _pairs(x, y)
    w = over(n)
    sd = f"(stddev_samp({a}) OVER {w} * stddev_samp({b}) OVER {w})"
    return _full(a, n, f"CASE WHEN {sd} > 1e-12 THEN covar_samp({a}, {b}) OVER {w} / {sd} END", least)


def _cov(x: str, y: str, n: int) -> str:
    a, b = _pairs(x, y)
    return _full(a, n, f"covar_samp({a}, {b}) OVER {over(n)}")


def _beta(y: str, x: str, n: int, least: int | None = None) -> str:
    a, b = _pairs(x, y)
    return _full(a, n, f"CASE WHEN var_samp({a}) OVER {over(n)} > 1e-12 THEN covar_samp({a}, {b}) OVER {over(n)} / var_samp({a}) OVER {over(n)} END", least)


def _cs(x) -> Column:
    """Average rank of x on its date, as a share of those that have a value; values are compared to nine places."""
    v = S.nearest(x, 9)
    below = F.rank().over(Window.partitionBy("date").orderBy(F.asc_nulls_last(v)))
    same = F.count("*").over(Window.partitionBy("date", v))
    return F.when(v.isNotNull(), (below + (same - 1) / 2) / F.count(v).over(Window.partitionBy("date")))


def _cs_sql(x: str) -> str:
    v = f"round({x}, 9)"
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {v}) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END)"


def _date():
    return Window.partitionBy("date")


_D = "(PARTITION BY date)"


def _drawdown(a: Column) -> Column:
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, v: Column) -> Column:
        peak = F.greatest(s["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(s["worst"], F.coalesce(F.when(peak > 0, 1 - v / peak), F.lit(0.0))).alias("worst"))

    return F.aggregate(a, start, step, lambda s: s["worst"])


def _extreme(x, key, n: int, k: int, top: bool) -> Column:
    a = F.collect_list(F.when(key.isNotNull() & x.isNotNull(), F.struct(key.alias("k"), x.alias("v")))).over(R.window(n))
    a = F.slice(F.sort_array(a, asc=not top), 1, k)
    both = F.when(key.isNotNull(), x)
    return R.full(both, n, F.aggregate(a, F.lit(0.0), lambda s, p: s + p["v"]))


def _extreme_sql(top: bool):
    def sql(x: str, key: str, n: int, k: int) -> str:
        return f"(CASE WHEN len(_a) >= {n} THEN list_sum(list_transform(list_sort(_a, '{'DESC' if top else 'ASC'}')[1:{k}], lambda s: s.v)) END)"

    return sql


def _extreme_list(x: str, key: str, n: int, k: int) -> str:
    return f"list({{'k': {key}, 'v': {x}}}) FILTER (WHERE {key} IS NOT NULL AND {x} IS NOT NULL) OVER {over(n)}"


def _past_list(x: str) -> str:
    return f"list({x}::DOUBLE) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_PAST = "(PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _weights(n: int) -> list[float]:
    """Weights of a window's values, oldest first, falling by the share of a span n and adding up to 1."""
    keep = 1 - 2 / (n + 1)
    w = [keep ** (n - i) for i in range(n)]
    return [x / sum(w) for x in w]


def _hold(x, half: float) -> Column:
    """The last value, halved every `half` days since."""
    last = F.last(F.when(x.isNotNull(), F.struct(F.col("day").alias("d"), x.alias("v"))), ignorenulls=True).over(R.past())
    return last["v"] * F.pow(F.lit(0.5), (F.col("day") - last["d"]) / F.lit(float(half)))


same = lambda u: u[0] if len({x for x in u if x != "any"}) <= 1 else None
one = lambda u: "one"

OPS: dict[str, Op] = {
    "add": Op("e", lambda a, b: a + b, lambda a, b: f"({a} + {b})", commutes=True, units=same),
    "subtract": Op("e", lambda a, b: a - b, lambda a, b: f"({a} - {b})", units=same),
    "multiply": Op("e", lambda a, b: a * b, lambda a, b: f"({a} * {b})", commutes=True, units=lambda u: u[0] if u[1] in ("one", "any") else u[1] if u[0] in ("one", "any") else "mixed"),
    "negate": Op("e", lambda a: -a, lambda a: f"(-{a})"),
    "abs": Op("e", F.abs, lambda a: f"abs({a})"),
    "safe_div": Op("e", S.safe_div, lambda a, b: f"(CASE WHEN abs({b}) > 1e-12 THEN ({a})::DOUBLE / {b} END)", units=lambda u: "one" if u[0] == u[1] else u[0] if u[1] in ("one", "any") else "mixed"),
    "log": Op("e", S.log_positive, lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) END)", units=one),
    "log1p": Op("e", lambda a: F.when(a > -1, F.log1p(a)), lambda a: f"(CASE WHEN {a} > -1 THEN ln(1 + {a}) END)", units=one),
    "exp": Op("e", F.exp, lambda a: f"exp({a})", units=one),
    "tanh": Op("e", F.tanh, lambda a: f"tanh({a})", units=one),
    "sign": Op("e", F.signum, lambda a: f"sign({a})::DOUBLE", units=one),
    "signed_sqrt": Op("e", S.signed_sqrt, lambda a: f"(sign({a}) * sqrt(abs({a})))", units=one),
    "safe_log": Op("e", S.safe_log, lambda a: f"(sign({a}) * ln(1 + abs({a})))", units=one),
    "sqrt": Op("e", lambda a: F.when(a >= 0, F.sqrt(a)), lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)", units=one),
    "power": Op("e", lambda a, p: F.pow(a, F.lit(p)), lambda a, p: f"pow({a}, {p})", units=one, history=lambda p: 0),
    "max2": Op("e", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)", commutes=True, units=same),
    "min2": Op("e", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)", commutes=True, units=same),
    "gt": Op("e", lambda a, b: (a > b).cast("double"), lambda a, b: f"({a} > {b})::INT::DOUBLE", units=one),
    "where": Op("e", lambda c, a, b: F.when(c.isNotNull(), F.when(c > 0, a).otherwise(b)), lambda c, a, b: f"(CASE WHEN {c} > 0 THEN {a} WHEN {c} IS NOT NULL THEN {b} END)", units=lambda u: u[1]),
    "fill": Op("e", lambda a, v: F.coalesce(a, F.lit(float(v))), lambda a, v: f"coalesce({a}, {v})", history=lambda p: 0),
    "lag": Op("ts", R.ref, _back, history=lambda p: p[0]),
    "delta": Op("ts", R.diff, lambda x, n: f"({x} - {_back(x, n)})", history=lambda p: p[0]),
    "rolling_mean": Op("ts", R.ts_mean, _win("avg")),
    "rolling_sum": Op("ts", R.ts_sum, _win("sum")),
    "rolling_std": Op("ts", lambda x, n, least=None: R.ts_std(x, n, 1, least), _win("stddev_samp"), least=2),
    "rolling_var": Op("ts", R.ts_var, _win("var_samp"), least=2),
    "rolling_max": Op("ts", R.ts_max, _win("max")),
    "rolling_min": Op("ts", R.ts_min, _win("min")),
    "rolling_median": Op("ts", R.ts_median, lambda x, n, least=None: _full(x, n, f"quantile_cont({x}, 0.5) OVER {over(n)}", least)),
    "rolling_iqr": Op("ts", lambda x, n: R.ts_quantile(x, n, 0.75) - R.ts_quantile(x, n, 0.25), lambda x, n: _full(x, n, f"quantile_cont({x}, 0.75) OVER {over(n)} - quantile_cont({x}, 0.25) OVER {over(n)}")),
    "rolling_mad": Op(
        "ts", lambda x, n: R.full(x, n, _median_dev(R.values(x, n))),
        lambda x, n: f"(CASE WHEN len(_a) >= {n} THEN list_median(list_transform(_a, lambda y: abs(y - list_median(_a)))) END)", _list,
    ),
    "rolling_skew": Op("ts", R.ts_skew, _win("skewness"), units=one, least=3),
    "rolling_kurt": Op("ts", R.ts_kurt, _win("kurtosis"), units=one, least=4),
    "rolling_downside_std": Op(
        "ts", lambda x, n: R.full(x, n, F.stddev_samp(F.when(x < 0, x)).over(R.window(n))),
        lambda x, n: _full(x, n, f"stddev_samp(CASE WHEN {x} < 0 THEN {x} END) OVER {over(n)}"), least=2,
    ),
    "ts_rank": Op(
        "ts", R.ts_rank, lambda x, n: f"(CASE WHEN len(_a) >= {n} AND {x} IS NOT NULL THEN (len(list_filter(_a, lambda y: y < {x})) + (len(list_filter(_a, lambda y: y = {x})) + 1) / 2.0) / len(_a) END)", _list, units=one,
    ),
    "ts_rank_ordinal": Op(
        "ts", lambda x, n: R.full(x, n, F.size(F.filter(R.values(x, n), lambda y: y <= x)) / n),
        lambda x, n: f"(CASE WHEN len(_a) >= {n} AND {x} IS NOT NULL THEN len(list_filter(_a, lambda y: y <= {x})) / {n}.0 END)", _list, units=one,
    ),
    "ts_zscore": Op("ts", lambda x, n: S.safe_div(x - R.ts_mean(x, n), R.ts_std(x, n)), lambda x, n: _full(x, n, f"CASE WHEN stddev_samp({x}) OVER {over(n)} > 1e-12 THEN ({x} - avg({x}) OVER {over(n)}) / stddev_samp({x}) OVER {over(n)} END"), units=one, least=2),
    "ts_argmax": Op("ts", lambda x, n: R.hhvbars(x, n) / n, lambda x, n: _full(x, n, f"(day - max_by(day, ({x}, -day)) FILTER (WHERE {x} IS NOT NULL) OVER {over(n)})") + f" / {n}.0", units=one),
    "ts_argmin": Op("ts", lambda x, n: R.llvbars(x, n) / n, lambda x, n: _full(x, n, f"(day - min_by(day, ({x}, day)) FILTER (WHERE {x} IS NOT NULL) OVER {over(n)})") + f" / {n}.0", units=one),
    "rolling_slope": Op("ts", R.slope, lambda x, n: _full(x, n, f"regr_slope({x}, day) OVER {over(n)}"), least=2),
    "rolling_slope_norm": Op("ts", lambda x, n: S.safe_div(R.slope(x, n), R.ts_mean(x, n)), lambda x, n: _full(x, n, f"CASE WHEN abs(avg({x}) OVER {over(n)}) > 1e-12 THEN regr_slope({x}, day) OVER {over(n)} / avg({x}) OVER {over(n)} END"), units=one, least=2),
    "rolling_r2": Op(
        "ts", lambda x, n: R.full(x, n, F.when(F.stddev_samp(x).over(R.window(n)) > S.EPS, F.pow(R.ts_corr(x, "day", n), F.lit(2.0)))),
        lambda x, n: f"pow({_corr(x, 'day', n)}, 2)", units=one, least=3,
    ),
    "rolling_hit_rate": Op("ts", lambda x, n: R.full(x, n, F.avg((x > 0).cast("double")).over(R.window(n))), lambda x, n: _full(x, n, f"avg(({x} > 0)::INT) OVER {over(n)}"), units=one),
    "rolling_max_drawdown": Op(
        "ts", lambda x, n: R.full(x, n, _drawdown(R.values(x, n))),
        lambda x, n: f"(CASE WHEN len(_a) >= {n} THEN list_max(list_transform(range(1, len(_a) + 1), lambda i: CASE WHEN list_max(_a[1:i]) > 0 THEN 1 - _a[i] / list_max(_a[1:i]) ELSE 0 END)) END)", _list, units=one,
    ),
    "rolling_cv": Op("ts", lambda x, n: S.safe_div(R.ts_std(x, n), F.abs(R.ts_mean(x, n))), lambda x, n: _full(x, n, f"CASE WHEN abs(avg({x}) OVER {over(n)}) > 1e-12 THEN stddev_samp({x}) OVER {over(n)} / abs(avg({x}) OVER {over(n)}) END"), units=one, least=2),
    "decay_linear": Op("ts", R.wma, lambda x, n: f"(CASE WHEN len(_a) >= {n} THEN list_sum(list_transform(range(1, {n} + 1), lambda i: i * _a[i])) / {n * (n + 1) / 2} END)", _list),
    "rolling_corr": Op("ts", R.ts_corr, _corr, units=one, least=3),
    "rolling_cov": Op("ts", R.ts_cov, _cov, units=lambda u: "mixed", least=2),
    "rolling_beta": Op("ts", R.ts_beta, _beta, units=one, least=3),
    "top_sum": Op("ts", lambda x, key, n, k: _extreme(x, key, n, k, True), _extreme_sql(True), _extreme_list),
    "bottom_sum": Op("ts", lambda x, key, n, k: _extreme(x, key, n, k, False), _extreme_sql(False), _extreme_list),
    "ema": Op(
        "ts", R.ema, lambda x, n: f"list_reduce(_a, lambda s, y: s * {1 - 2 / (n + 1)!r} + y * {2 / (n + 1)!r})", lambda x, n: _past_list(x), recursive=True,
        history=lambda p: R.reach(1 - 2 / (p[0] + 1)),
    ),
    "ema_from": Op(  # the same, from a number of values on
        "ts", lambda x, n, least, ordinal: F.when(F.col(ordinal) >= least, R.ema(x, n, ordinal)),
        lambda x, n, least: f"(CASE WHEN len(_a) >= {least} THEN list_reduce(_a, lambda s, y: s * {1 - 2 / (n + 1)!r} + y * {2 / (n + 1)!r}) END)", lambda x, n, least: _past_list(x), recursive=True,
        history=lambda p: R.reach(1 - 2 / (p[0] + 1)),
    ),
    "ewm": Op(
        "ts", R.ewm, lambda x, n: f"list_reduce(_a, lambda s, y: s * {1 - 2 / (n + 1)!r} + y) / ((1 - pow({1 - 2 / (n + 1)!r}, len(_a))) / {2 / (n + 1)!r})", lambda x, n: _past_list(x), recursive=True,
        history=lambda p: R.reach(1 - 2 / (p[0] + 1)),
    ),
    "window_ema": Op(
        "ts", lambda x, n: R.full(x, n, F.aggregate(F.zip_with(R.values(x, n), F.array(*[F.lit(w) for w in _weights(n)]), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)),
        lambda x, n: f"(CASE WHEN len(_a) >= {n} THEN list_sum(list_transform(range(1, {n} + 1), lambda i: ({_weights(n)!r}::DOUBLE[])[i] * _a[i])) END)", _list,
    ),
    "carry": Op("ts", lambda x: R.forward_fill(x), lambda x: f"last_value({x} IGNORE NULLS) OVER {_PAST}", history=lambda p: 0),
    "cumsum": Op("ts", lambda x: F.sum(x).over(R.past()), lambda x: f"sum({x}) OVER {_PAST}", history=lambda p: 0),
    "hold": Op("ts", _hold, lambda x, half: f"(last_value({x} IGNORE NULLS) OVER {_PAST} * pow(0.5, (day - max(CASE WHEN {x} IS NOT NULL THEN day END) OVER {_PAST}) / {half}.0))", history=lambda p: 53 * p[0]),
    "column": Op("cs", lambda x: x + 0.0, lambda x: f"({x})"),  # a stage of its own, so that long expressions aren't repeated
    "rank": Op("cs", _cs, _cs_sql, units=one),
    "cs_quantile": Op("cs", lambda x, q: F.percentile(x, F.lit(q)).over(_date()), lambda x, q: f"(quantile_cont({x}, {q}) OVER {_D})"),
    "cs_zscore": Op("cs", lambda x: F.when((F.stddev_pop(x).over(_date()) > S.EPS) & (F.count(x).over(_date()) > 1), S.safe_div(x - F.avg(x).over(_date()), F.stddev_pop(x).over(_date()))), lambda x: f"(CASE WHEN stddev_pop({x}) OVER {_D} > 1e-12 AND count({x}) OVER {_D} > 1 THEN ({x} - avg({x}) OVER {_D}) / stddev_pop({x}) OVER {_D} END)", units=one),
    "cs_mean": Op("cs", lambda x: F.avg(x).over(_date()), lambda x: f"(avg({x}) OVER {_D})"),
    "cs_scale": Op("cs", lambda x: S.safe_div(2 * (x - F.min(x).over(_date())), F.max(x).over(_date()) - F.min(x).over(_date())) - 1, lambda x: f"(CASE WHEN max({x}) OVER {_D} - min({x}) OVER {_D} > 1e-12 THEN 2 * ({x} - min({x}) OVER {_D}) / (max({x}) OVER {_D} - min({x}) OVER {_D}) END - 1)", units=one),
}


def _named(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f and the lambdas inside it name it."""
    return F.transform(F.array(value), f)[0]


def _median_dev(a: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        return _named(F.sort_array(v), lambda s: F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2))

    return F.when(F.size(a) > 0, _named(middle(a), lambda m: middle(F.transform(a, lambda y: F.abs(y - m)))))


@functools.cache
def rewrite(node: Node) -> Node:
    """Derived operators in terms of the others."""
    args = tuple(rewrite(a) for a in node.args)
    if node.op == "efficiency_ratio":
        x, n = args[0], node.params[0]
        moves = call("rolling_sum", call("abs", call("delta", x, params=(1,))), params=(n,))
        return call("safe_div", call("abs", call("delta", x, params=(n,))), moves)
    if node.op == "rolling_autocorr":
        x, n = args[0], node.params[0]
        return call("rolling_corr", x, call("lag", x, params=(1,)), params=(n - 1,))
    return Node(node.op, args, node.params)


@functools.cache
def canonical(node: Node) -> Node:
    """The tree with the arguments of commutative operators in order: equal formulas get equal trees."""
    args = tuple(canonical(a) for a in node.args)
    if node.op in OPS and OPS[node.op].commutes:
        args = tuple(sorted(args, key=_digest))
    return Node(node.op, args, node.params)


@functools.cache
def _digest(node: Node) -> str:
    return hashlib.sha256("|".join([node.op, *map(_digest, node.args), *map(str, node.params)]).encode()).hexdigest()


@functools.cache
def text(node: Node) -> str:
    if node.op in ("field", "const"):
        return str(node.params[0])
    return f"{node.op}({','.join([*map(text, node.args), *map(str, node.params)])})"


def formula_id(node: Node) -> str:
    return _digest(canonical(rewrite(node)))[:16]


@functools.cache
def history_days(node: Node) -> int:
    """Days before a date that its value needs."""
    node = rewrite(node)
    own = OPS[node.op].history(node.params) if node.op in OPS and OPS[node.op].kind == "ts" else 0
    return own + max([0, *map(history_days, node.args)])


@functools.cache
def required_fields(node: Node) -> frozenset[str]:
    return frozenset({node.params[0]} if node.op == "field" else {f for a in node.args for f in required_fields(a)})


@functools.cache
def node_count(node: Node) -> int:
    return 1 + sum(map(node_count, node.args))


#: Units of the raw fields.
UNITS = {"open": "price", "high": "price", "low": "price", "close": "price", "volume": "base", "quote_volume": "quote", "trade_count": "count", "taker_volume": "base", "taker_quote_volume": "quote"}


@functools.cache
def unit(node: Node) -> str:
    """The formula's unit; raises ValueError where units don't fit or a window is too short."""
    if node.op == "field":
        return UNITS.get(node.params[0], "one")
    if node.op == "const":
        return "any"
    node = rewrite(node)
    op = OPS[node.op]
    got = op.units(tuple(map(unit, node.args)))
    if got is None:
        raise ValueError(f"units do not fit in {text(node)}")
    if op.kind == "ts" and node.params and node.params[0] < op.least:
        raise ValueError(f"window too short in {text(node)}")
    return got


@functools.cache
def sign_domain(node: Node) -> str:
    """positive, nonnegative or any: what the formula's values can be."""
    if node.op == "field":
        return "positive" if node.params[0] in UNITS else "any"
    if node.op == "const":
        return "positive" if node.params[0] > 0 else "any"
    inner = [sign_domain(a) for a in node.args]
    if node.op in ("abs", "rolling_std", "rolling_var", "rolling_mad", "rolling_iqr", "rolling_hit_rate", "rank", "ts_rank", "rolling_max_drawdown", "rolling_cv", "rolling_r2", "efficiency_ratio"):
        return "nonnegative"
    if node.op in ("add", "multiply", "safe_div", "rolling_mean", "rolling_sum", "rolling_max", "rolling_min", "rolling_median", "lag"):
        return "positive" if all(x == "positive" for x in inner) else "nonnegative" if all(x != "any" for x in inner) else "any"
    return "any"


def check(node: Node) -> None:
    """Reject what can't be meant: units that don't fit, windows too short, a hit rate of what is always positive."""
    unit(node)
    if node.op == "rolling_hit_rate" and sign_domain(node.args[0]) == "positive":
        raise ValueError("hit rate of a positive series")
    for a in node.args:
        check(a)


def neighbours(node: Node, share: float = 0.2) -> list[Node]:
    """Formulas with one window made shorter or longer by a share."""
    out = []
    if node.op in OPS and OPS[node.op].kind == "ts":
        n = node.params[0]
        step = max(1, round(n * share))
        out += [Node(node.op, node.args, (m, *node.params[1:])) for m in (n - step, n + step) if m >= max(1, OPS[node.op].least)]
    for i, a in enumerate(node.args):
        out += [Node(node.op, (*node.args[:i], b, *node.args[i + 1 :]), node.params) for b in neighbours(a, share)]
    return out


class _Plan:
    """Windowed sub-trees of some formulas by level; names of their columns."""

    def __init__(self, formulas: dict[str, Node]):
        self.roots = {k: canonical(rewrite(f)) for k, f in formulas.items()}
        self.names: dict[Node, str] = {}
        self.levels: dict[int, list[Node]] = {}
        self.seen: dict[Node, int] = {}
        self.inner: dict[Node, frozenset[Node]] = {}
        for f in self.roots.values():
            self._level(f)

    def _level(self, node: Node) -> int:
        if node in self.seen:
            return self.seen[node]
        level = max([0, *(self._level(a) for a in node.args)])
        if node.op in OPS and OPS[node.op].kind != "e":
            level += 1
            if node not in self.names:
                self.names[node] = f"_w{len(self.names)}"
                self.levels.setdefault(level, []).append(node)
        self.seen[node] = level
        return level

    def steps(self) -> list[list[Node]]:
        """The windowed sub-trees in an order that changes between rolling and cross-section as seldom as it can, each such change being a
        shuffle of all rows: what is ready goes on until only the other kind is left. Lists are computed one after the other."""
        runs = [self._from(kind) for kind in ("ts", "cs")]
        return [nodes for _, nodes in min(runs, key=lambda run: sum(a[0] != b[0] for a, b in zip(run, run[1:])))]

    def _from(self, kind: str) -> list[tuple[str, list[Node]]]:
        out, done = [], set()
        while len(done) < len(self.names):
            ready = [n for n in self.names if n not in done and n.op != "column" and OPS[n.op].kind == kind and self._inner(n) <= done]
            if ready:
                out.append((kind, ready))
                done.update(ready)
            # a column is no window and goes with either kind
            plain = [n for n in self.names if n.op == "column" and n not in done and self._inner(n) <= done]
            if plain:
                out.append((kind, plain))
                done.update(plain)
            if not ready and not plain:
                kind = "cs" if kind == "ts" else "ts"
        return out

    def _inner(self, node: Node) -> frozenset[Node]:
        """The windowed sub-trees that a node's value is computed from, the nearest ones."""
        if node not in self.inner:
            self.inner[node] = frozenset().union(*({a} if a in self.names else self._inner(a) for a in node.args))
        return self.inner[node]

    def column(self, node: Node, top: bool = False) -> Column:
        if node.op == "field":
            return F.col(node.params[0]).cast("double")
        if node.op == "const":
            return F.lit(node.params[0])
        if node in self.names and not top:
            return F.col(self.names[node])
        op, args = OPS[node.op], [self.column(a) for a in node.args]
        return op.spark(*args, *node.params, *([f"_o{self.names[node]}"] if op.recursive else []))

    def sql(self, node: Node, top: bool = False, listed: bool = False) -> str:
        if node.op == "field":
            return node.params[0]
        if node.op == "const":
            return f"{node.params[0]!r}::DOUBLE"
        if node in self.names and not top:
            return self.names[node]
        op, args = OPS[node.op], [self.sql(a) for a in node.args]
        if listed:
            return op.listed(*args, *node.params)
        return op.sql(*args, *node.params).replace("_a", f"_l{self.names[node]}") if op.listed else op.sql(*args, *node.params)


def evaluate(panel: DataFrame, formulas: dict[str, Node], eligible: str | None = None) -> DataFrame:
    """instrument, date and a column per formula. `eligible` names a boolean column; cells where it isn't true get null
    after all windows are computed on full history."""
    plan = _Plan(formulas)
    df = panel
    for nodes in plan.steps():
        counts = [R.running_count(plan.column(n.args[0])).alias(f"_o{plan.names[n]}") for n in nodes if OPS[n.op].recursive]
        df = df.select("*", *counts) if counts else df
        df = df.select("*", *[plan.column(n, True).alias(plan.names[n]) for n in nodes])
    keep = (lambda c: F.when(F.col(eligible), c)) if eligible else (lambda c: c)
    return df.select("instrument", "date", *[keep(S.finite(plan.column(f))).alias(k) for k, f in plan.roots.items()])


def sql(view: str, formulas: dict[str, Node], table: str = "bars", places: int = 6) -> str:
    """The SQL of `evaluate` over a view given as a common table expression."""
    plan = _Plan(formulas)
    ctes, last = [view], table
    for level in sorted(plan.levels):
        nodes = plan.levels[level]
        lists = [n for n in nodes if OPS[n.op].listed]
        if lists:
            ctes.append(f"l{level} AS (SELECT *, {', '.join(f'{plan.sql(n, True, True)} AS _l{plan.names[n]}' for n in lists)} FROM {last})")
            last = f"l{level}"
        ctes.append(f"s{level} AS (SELECT *, {', '.join(f'{plan.sql(n, True)} AS {plan.names[n]}' for n in nodes)} FROM {last})")
        last = f"s{level}"
    values = ", ".join(f"round(({plan.sql(f)})::DOUBLE + 3e-10, {places}) + 0.0 AS {k}" for k, f in plan.roots.items())
    return f"WITH {', '.join(ctes)} SELECT instrument, date, {values} FROM {last}"
