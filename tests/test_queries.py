"""Every query of the core runs; those with SQL agree with it."""

import pytest

from recallframe.plans import catalogue
from tests.oracle import DATA, differences

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    left, right = differences(spark, name, QUERIES[name], SQL[name])
    assert not left and not right, (list(left)[:3], list(right)[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
