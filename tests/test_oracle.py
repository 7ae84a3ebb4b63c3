"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, oracle

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf, connection, name):
    assert difference(spark, sf, connection, queries()[name], ORACLES.get(name)) is None


def test_entry(spark):
    assert entry(spark).count() == 20
