"""Every query of the engine against the same question in SQL."""

import pytest

from positdb.queries import ORACLE, QUERIES

from .compare import differences

SF = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(spark, QUERIES[name], ORACLE[name], SF) == ""
