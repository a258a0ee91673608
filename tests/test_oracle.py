"""Every registered query against its SQL on the supplied tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
JOBS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(JOBS))
def test_query(spark, con, name):
    assert compare(spark, con, JOBS[name], SQL.get(name), SF_DIR) is None


def test_every_query_has_sql_or_a_test_of_its_own():
    assert {name for name in JOBS if name not in SQL} <= set(entry.LLM_QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    forms = [r["form"] for r in rows]
    assert (forms.count("full"), forms.count("compressed")) == (101, 13)
