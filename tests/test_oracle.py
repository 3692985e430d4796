"""Every named query with a SQL statement, on the smallest test tables."""

import os

import pytest
from check_oracle import database, difference

from riskloom.plans.oracle import ORACLE
from riskloom.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(ORACLE[name]).df()) is None


def test_entry_ranks_clusters(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
