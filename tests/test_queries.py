"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidelog.plans import queries, record_queries, store_queries  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_queries_without_sql():
    """Those are held against brute force in test_conflicts and test_records."""
    assert set(queries.QUERIES) - set(queries.SQL) == {"serialization_cycles", "transaction_cycles", "zipf_picks"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pushdown(spark, sf):
    """A key-only read takes no values from Parquet and is a hash aggregate; bounds on the sequence reach the scan."""
    from tidelog.operators.visible import newest
    from tidelog.plans import log

    plan = newest(log.versions(spark, sf), 500, values=False)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split(">")[0]
    assert "user_id" in schema and "props" not in schema and "ts" not in schema
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "PushedFilters: [" in plan
