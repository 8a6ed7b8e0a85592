"""Queries that SQL can express, against their SQL."""

import pytest
from compare import check, connect

from panelwise.llm.oracles import oracle_sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert check(spark, connect(SMALL), name, SMALL) is None
