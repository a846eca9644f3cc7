"""Operators with a counterpart in SQL, over whole tables."""

import pytest

from positdb.llm import queries

from ..compare import differences


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001") == ""
