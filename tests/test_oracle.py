"""Spark vs DuckDB oracle on the smallest scale for a cross-section of registered
queries (the full set runs with ``python tools/compare.py``)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "at_risk_context", "clv_segment", "churn_by_tickets", "describe_numeric", "sentiment_by_churn", "pk_violations",
    "pr_curve", "tuned_threshold_fallback", "ungrounded_amounts", "scoped_search_all", "customer_context",
    "guardrail_chain", "recommend_job", "split_balance", "one_hot", "requests_per_minute",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _key(r):
    return tuple((x is None, str(type(x)), str(x)) for x in r)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=_key)
    want = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    assert got == want
