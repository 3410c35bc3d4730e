"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check import TABLES, normal

from drayline.plans import catalog

SMALL = "/root/testdata/sf0.001"
SLOW_NODES = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, plan, name):
    df = QUERIES[name](spark, SMALL)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert not [bad for bad in SLOW_NODES if bad in plan(df)]
    cursor = duck.execute(ORACLES[name])
    assert got == normal(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    assert contract.entry(spark).count() == 2


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
