"""Every core query against its SQL; those beyond SQL have tests of their own."""

import pytest
from oracle import TABLES, check

from tideline.plans import catalog

ROWS_ONLY = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert check(spark, catalog.queries()[name], catalog.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, TABLES).count() > 0
