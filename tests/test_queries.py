"""Every query with SQL gives the same rows as DuckDB; every other query runs."""

import math
import os

import duckdb
import pytest

from quantloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()
#: One of each family here; the driver runs them all.
FEW = [n for i, n in enumerate(sorted(QUERIES)) if n.startswith("factor_") and i % 12 == 0] + [n for n in QUERIES if not n.startswith("factor_")]


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def comparable(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)[:10] if hasattr(v, "year") else str(v)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=3e-6)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x) if not isinstance(x, float) else "", round(x, 4) if isinstance(x, float) else 0) for x in r))


@pytest.mark.parametrize("name", FEW)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(comparable(x) for x in r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in SQL:
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = [tuple(comparable(r[i]) for i in at) for r in rel.fetchall()]
    got, want = ordered(got), ordered(want)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if not all(map(close, a, b))]
    assert not wrong, wrong[:3]
