"""Every registered query against its SQL, and without SQL for its rows and a stable schema."""

from __future__ import annotations

import os

import pytest

from corpusloom.plans import catalog
from tests.compare import SF, connection, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    same(QUERIES[name](spark, SF), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    first = QUERIES[name](spark, SF)
    assert first.columns == QUERIES[name](spark, SF).columns
    first.count()


def test_flagship(spark):
    r = catalog.flagship(spark, SF).collect()
    assert r and all(x["documents"] == x["leaked"] + x["clean"] for x in r)
