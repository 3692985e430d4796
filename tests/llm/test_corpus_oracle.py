"""Corpus queries with a SQL statement, on the smallest test tables."""

import os

import pytest
from check_oracle import database, difference

from riskloom.llm.oracle import ORACLE
from riskloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), database(FOLDER).execute(ORACLE[name]).df()) is None


def test_every_operator_and_the_pipeline_are_registered():
    numbers = {n.split("_")[0] for n in QUERIES if n.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in QUERIES
