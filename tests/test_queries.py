"""Every query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from quarry.plans import catalog
from tests.oracle import connect, rows_of_spark, rows_of_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = rows_of_spark(df)
    if name not in catalog.SQL:
        assert got
        return
    names, want = rows_of_sql(con, catalog.SQL[name])
    assert sorted(df.columns) == names
    assert got == want
