"""The table queries against their SQL twins."""

import math

import duckdb
import pytest

from tracemill.plans import log_queries, session_queries, table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**table_queries.QUERIES, **log_queries.QUERIES, **session_queries.QUERIES}
ORACLES = {**table_queries.ORACLES, **log_queries.ORACLES, **session_queries.ORACLES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(got.columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).count()
