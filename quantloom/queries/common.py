"""Query registry: a query is a callable (spark, sf_dir) -> DataFrame, with the SQL that it is checked against.

Doubles are rounded to six places on both sides, so that the order of summation does not show; a small shift keeps exact
halves on one side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quantloom import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SHIFT = 3e-10


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + SHIFT, places) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def counted(sql: str) -> str:
    """count_if(c) as count(*) FILTER (WHERE c), which is 0 and not null where c is null throughout."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql:
        SQL[name] = counted(sql)


def r(expr: str, name: str = "value") -> str:
    """A rounded double column of a SQL select list."""
    return f"round(({expr})::DOUBLE + 3e-10, 6) + 0.0 AS {name}"


def over(n: int, before: int = 0, by: str = "instrument") -> str:
    end = "CURRENT ROW" if before == 0 else f"{before} PRECEDING"
    return f"(PARTITION BY {by} ORDER BY day RANGE BETWEEN {n - 1 + before} PRECEDING AND {end})"


PAST = "(PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, e: str, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} >= {n if least is None else least} THEN {e} END"


def panel(name: str, column: Callable[[], Column], expr: str, stages: str = "", table: str = "bars", prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """A query giving one value per cell of the daily bars; `prepare` and `stages` add columns that need a stage of their own."""
    add(
        name,
        lambda spark, d: prepare(views.bars_ev(spark, d)).select("instrument", "date", column().cast("double").alias("value")),
        f"WITH {views.BARS_EV}{stages} SELECT instrument, date, {r(expr)} FROM {table}",
    )
