"""The numbered queries against their SQL on the generated tables."""

import pytest
from compare import DATA, differences

from offerloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, f"{DATA}/sf0.001", queries.queries()[name], SQL[name]) == []
