"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_oracle import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, SF, name, entry.queries()[name], ORACLES.get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
