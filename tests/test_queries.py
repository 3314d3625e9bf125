"""Every registered query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import compare, register
from standin.oracles import ORACLES
from standin.queries import QUERIES

SF_DIR = os.environ.get("MARKETCLIME_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    register(con, SF_DIR)
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    sql = entry_point.oracle_sql().get(name)
    text, _, _ = compare(spark, tables, SF_DIR, name, entry_point.queries()[name], sql)
    assert text.startswith(("ok", "rows-only")), text


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
