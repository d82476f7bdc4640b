"""Every catalog query that has SQL gives its rows."""

import pytest
from compare import DATA, differences

import __spark_entry__
from offerloom.plans import oracles, queries

SQL = oracles.oracle_sql()
#: Ids of the smallest tables repeat with equal order keys; these queries keep one of such rows.
LARGER = {"merge_lifecycle", "expire_lapsed"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    folder = f"{DATA}/{'sf0.01' if name in LARGER else 'sf0.001'}"
    assert differences(spark, folder, queries.queries()[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
