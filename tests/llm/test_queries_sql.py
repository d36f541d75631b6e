"""Queries of this subpackage against their SQL on the smallest tables."""

import pytest

from groundwork.llm import queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
