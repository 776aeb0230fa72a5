"""The subpackage's queries against their SQL, or that they run."""

import os

import pytest

from docspark.llm.registry import QUERIES, SQL
from tests.oracle import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
