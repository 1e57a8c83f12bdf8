from __future__ import annotations

import pytest
from oracle import connect, same

from tidemark.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert found.columns
    assert found.count() >= 0
