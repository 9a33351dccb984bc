"""The driver's contract, and queries that must not depend on the task limit."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trackplace.plans import oracles
from trackplace.plans.queries import QUERIES
from trackplace.session import ROWS_PER_TASK_CONF

SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver data not here")
@pytest.mark.parametrize("name", sorted(oracles.build()))
def test_sql_agrees_with_a_task_limit_of_forty_rows(spark, tables, name):
    spark.conf.set(ROWS_PER_TASK_CONF, "40")
    try:
        frame = QUERIES[name](spark, SMALL)
        columns = sorted(frame.columns)
        rows = sorted(tuple(map(_cell, r)) for r in frame.select(*columns).collect())
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)
    want = tables.sql(oracles.build()[name])
    assert columns == sorted(want.columns)
    quoted = [f'"{c}"' for c in columns]
    assert rows == sorted(tuple(map(_cell, r)) for r in want.select(*quoted).fetchall())
