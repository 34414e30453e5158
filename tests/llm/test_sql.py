"""Queries that SQL can express, on whole tables."""

import pytest

from tests import oracle
from tidelens.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf), oracle.connection(sf), registry.SQL[name]) == ""
