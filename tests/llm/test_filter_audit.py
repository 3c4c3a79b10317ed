"""Filter audit: brute force over the orders, Shapley shares, edge cases."""

from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import given, settings, strategies as st

from quantloom.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, n long, fails string, digest string"


def fails(doc, docs):
    """The failing conditions of a document, from their definitions."""
    text = doc[1] or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    seen = doc[0] is not None and any(o[0] is not None and o[0] < doc[0] and (o[1] or "") == text for o in docs)
    capitals = sum("A" <= c <= "Z" for c in text)
    tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), any(c in "#$%&*|" for c in text), seen]
    return {f for f, t in zip("ABCDE", tests) if t}


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    out = {}
    for part in {d[2] or "" for d in docs}:
        rows = [(fails(d, docs), d[0] in good and d[0] is not None, d[0] in toxic and d[0] is not None) for d in docs if (d[2] or "") == part]
        removed_over_orders = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removed_over_orders[f] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(f in r[0] for r in rows) - len(hit), sum(r[0] == {f} for r in rows), sum(r[1] for r in hit), sum(r[2] for r in hit)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_over_orders[order[step - 1]])
    return out


WORDS = " ".join(f"w{k}" for k in range(120))
DOCS = [
    (1, None, "de"), (2, "", "de"), (3, "short Text", None), (4, WORDS, ""), (5, WORDS, "de"), (6, WORDS, "de"), (6, WORDS, "de"), (None, WORDS, "de"), (None, "", None),
    (7, "same " * 150, "de"), (8, "AB" * 50, "fr"), (9, WORDS + " 100%", "fr"), (10, WORDS.upper(), "fr"), (11, WORDS.upper() + " |", "fr"), (12, "é ü\x1c" + WORDS, "fr"), (13, "x\ty\x0bz\r" * 10_000, "fr"), (14, "a,b #", "de"),
]
LABELS = [(5, 1, 0), (5, 0, 1), (6, 1, None), (7, None, 1), (9, 1, 1), (99, 1, 1), (None, 1, 1), (11, 0, 0)]


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(*x, "x") for x in LABELS], "doc_id long, quality int, toxic int, digest string")


def test_equals_applying_every_order(spark, labels):
    docs = spark.createDataFrame([(*d, 1, "x", "y") for d in DOCS], SCHEMA)
    got = filter_audit.audit(docs, labels).collect()
    expected = brute(DOCS, LABELS)
    assert len(got) == len(expected) == 600 * 3
    for r in got:
        assert list(r)[3:] == expected[r.part, r.filter_order, r.step], r


def test_empty_tables(spark, labels):
    docs = spark.createDataFrame([(*d, 1, "x", "y") for d in DOCS], SCHEMA)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=31, max_size=31))
def test_shares_are_the_mean_marginals(values):
    """For any game, whatever its shape, the constrained fit gives the mean of the marginals over all orders."""
    v = [0, *values]
    expected = [Fraction(0)] * 5
    for order in permutations(range(5)):
        at = 0
        for f in order:
            expected[f] += Fraction(v[at | 1 << f] - v[at], 120)
            at |= 1 << f
    assert filter_audit.shapley(v) == expected
