"""Every core query against its SQL; those without SQL must run and give rows of a stable schema."""

import importlib
import os

import pytest

from tests.oracle import DATA, check, expected

MODULES = [importlib.import_module(f"docspark.plans.{m}") for m in ("general", "textual", "search", "library", "trees", "chunks", "streams", "pipeline")]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_query_set_of_all_levels(spark):
    """Every chunk whose index is divisible by 50 is asked, summaries too."""
    sql = "SELECT level, count(*) AS n FROM (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE chunk_sequence_index % 50 = 0 GROUP BY 1"
    want = expected(sql).set_index("level")["n"]
    got = QUERIES["retrieval_counters_all_levels"](spark, DATA).toPandas()["n_queries"].sum()
    assert len(want) > 1 and got == want.sum()
