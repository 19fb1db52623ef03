import pytest

from __spark_entry__ import entry, oracle_sql, queries
from featloom.catalog import ORACLES, QUERIES

from .compare import connect, differences

@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(queries()[name](spark, sf_dir), duck, oracle_sql()[name]) == []


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0
