"""Every registered query runs; those with a SQL counterpart give the same rows."""

import pytest
from oracle_check import compare, duck

from craquelure import plans

ORACLES = plans.oracles()
QUERIES = plans.queries()


@pytest.fixture(scope="session")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, folder, con):
    problem, _ = compare(QUERIES[name](spark, folder), con, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, folder):
    df = QUERIES[name](spark, folder)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
