"""Registered queries against DuckDB on the smallest tables, and the contract's shape."""

import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__
from lakewright.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(records, columns):
    def norm(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted(([str(norm(r[c])) for c in columns] for r in records))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as from read_parquet('{sf}/{f}')")
    c.sql("set timezone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    expected = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows([r.asDict() for r in got.collect()], columns) == rows(expected, columns)


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_corpus_operators():
    for name in ("plans.catalog", "operators.evidence", "sources.records", "streaming.ingest", "storage"):
        source = importlib.import_module(f"lakewright.{name}").__file__
        assert "lakewright.llm" not in open(source).read()


def test_queries_without_sql_are_deterministic(spark, sf):
    """Their results are held against brute force in tests/operators."""
    for name in sorted(set(QUERIES) - set(SQL)):
        a, b = QUERIES[name](spark, sf).collect(), QUERIES[name](spark, sf).collect()
        assert a and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_query_is_vacuous(duck):
    """Each oracle has rows on the smallest tables."""
    assert [n for n in sorted(SQL) if not duck.sql(SQL[n]).limit(1).fetchall()] == []
