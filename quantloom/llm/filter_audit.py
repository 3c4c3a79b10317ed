"""Audit of filters that act together: what each removes at each step of every order, and its Shapley share.

Documents are counted by their set of failing conditions (32 sets for five filters), part and labels. From these counts a part's 32
coalition removals are tabulated: v(S) is the number of documents that a coalition S of filters removes. A step's count is a
difference of two coalitions, and the Shapley shares solve the kernel-weighted least squares fit of v under the efficiency
constraint exactly, in rationals. Only the counting grows with the corpus; what is left per part has a fixed size.

Identical texts are found by SHA-256 digest: counts are combined by (document, digest), then by digest, so a text that a third
of all rows share is a few partial counts.

Defined results: null text counts as empty, null part as the empty string. A row without a doc_id has no smaller doc_id and
is none, so it never fails E. Rows that repeat a doc_id are documents of their own; equal texts under one id do not fail E by
each other. Several label rows of one document count as 1 where any says 1; null labels and documents without labels count as
0. An empty table has no parts and gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.llm.common import WORD, importable, read

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
BLANK = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits of the conditions that a text alone decides (A: 1, B: 2, C: 4, D: 8)."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails (bits of the failing conditions), good, toxic, n."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    met = slim.join(marks, "doc_id", "left").fillna(0, ["quality", "toxic"])
    kind = ["digest", "part", "own", "quality", "toxic"]
    by_id = met.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    # of each kind all rows, those without an id, and the smallest id with its rows
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    kinds = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least)
    smallest = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a digest has a row per part and labels, not per copy
    first = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    split = kinds.withColumn("smallest", smallest).withColumn("first", first)
    rows = F.explode(F.array(F.struct(F.col("own").alias("fails"), F.col("first").alias("n")), F.struct((F.col("own") + 16).alias("fails"), (F.col("n") - F.col("first")).alias("n"))))
    cells = split.select("part", F.col("quality").alias("good"), "toxic", rows.alias("r"))
    return cells.groupBy("part", "r.fails", "good", "toxic").agg(F.sum("r.n").alias("n")).filter("n > 0")


def coalitions(counts: DataFrame) -> DataFrame:
    """One row per part with its 32 coalition removals: removed, good, toxic (arrays by coalition bits), alone (documents that fail
    exactly these conditions) and n (all documents)."""
    each = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    hit = F.col("fails").bitwiseAND(F.col("s")) != 0
    total = lambda test, w, name: F.sum(F.when(test, w).otherwise(0)).alias(name)
    n = F.col("n")
    by_set = each.groupBy("part", "s").agg(
        total(hit, n, "removed"),
        total(hit, n * F.col("good"), "good"),
        total(hit, n * F.col("toxic"), "toxic"),
        total(F.col("fails") == F.col("s"), n, "alone"),
        F.sum("n").alias("n"),
    )
    table = F.sort_array(F.collect_list(F.struct("s", "removed", "good", "toxic", "alone")))  # 32 entries
    return by_set.groupBy("part").agg(table.alias("table"), F.max("n").alias("n")).select("part", *[F.col(f"table.{c}").alias(c) for c in ("removed", "good", "toxic", "alone")], "n")


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """The solution of a regular linear system, by elimination in rationals."""
    rows, n = [[*r, x] for r, x in zip(a, b)], len(b)
    for k in range(n):
        p = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                f = rows[i][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    return [r[n] for r in rows]


def shapley(removed: list[int]) -> list[Fraction]:
    """Shapley shares of the filters from their coalitions' removals (by coalition bits): the least squares fit of removed[S] by sums
    of shares, each coalition S of size s weighted (m - 1) / (C(m, s) s (m - s)), under shares that sum to removed[all]."""
    m = (len(removed) - 1).bit_length()
    a = [[Fraction(0)] * (m + 1) for _ in range(m + 1)]
    b = [Fraction(0)] * (m + 1)
    for coalition in range(1, (1 << m) - 1):
        members = [i for i in range(m) if coalition >> i & 1]
        s = len(members)
        weight = Fraction(m - 1, comb(m, s) * s * (m - s))
        for i in members:
            b[i] += weight * removed[coalition]
            for j in members:
                a[i][j] += weight
    for i in range(m):  # the constraint and its multiplier
        a[i][m] = a[m][i] = Fraction(1)
    b[m] = Fraction(removed[-1] - removed[0])
    return solve(a, b)[:m]


def audit_part(part: str, removed: list[int], good: list[int], toxic: list[int], alone: list[int], n: int) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, every step."""
    orders = list(permutations(range(len(FILTERS))))
    shares = [x * len(orders) for x in shapley(removed)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            here = removed[after] - removed[before]
            name = "".join(FILTERS[k] for k in order)
            yield (part, name, step, n - removed[after], here, removed[1 << f] - here, alone[1 << f], good[after] - good[before], toxic[after] - toxic[before], int(shares[f]))
            before = after


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step (SCHEMA)."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for r in t.itertuples(index=False):
                lists = [[int(x) for x in v] for v in (r.removed, r.good, r.toxic, r.alone)]
                yield pd.DataFrame(audit_part(r.part, *lists, int(r.n)), columns=columns)

    return coalitions(failure_counts(docs, labels, part)).mapInPandas(run, SCHEMA)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    importable(spark)
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Every order is applied to the failure sets left to right; the sums over all orders are taken from these rows.
OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic,
         len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM w LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
         || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS l, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)
), met AS (
  SELECT part, filter_order, step, l, fails, n, good, toxic, contains(fails, l) AS hit,
         len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone
  FROM sets, steps
), counted AS (
  SELECT part, filter_order, step, l,
         sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
         sum(n) FILTER (fails = l) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counted
"""
