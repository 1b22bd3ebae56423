"""Every query runs; those with checking SQL agree with it."""

import pytest
from compare import check, connect
from conftest import SF

import __spark_entry__ as entry
from proofloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = check(spark, con, SF, name)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(ORACLES) > 120
