"""Every query with SQL gives the same rows in DuckDB, on whole tables."""
import pytest

import catalog
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message
