"""The operators' queries against their SQL, where SQL can express one."""

import pytest
from oracle import check

from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert check(spark, queries.queries()[name], queries.oracle_sql()[name]) > 0
