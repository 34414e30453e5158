"""Every query of the catalogue against its SQL."""

from . import oracle
import pytest

from tidelens import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf, con, name):
    assert oracle.differences(catalogue.QUERIES[name](spark, sf), con, catalogue.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    catalogue.QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
