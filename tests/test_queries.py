"""Every named query against its SQL on the smallest tables."""

import pytest

from tallyhouse.plans.registry import ORACLE_SQL, QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.oracle(SF)


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert compare.differences(spark, db, name, SF) is None


def test_entry(spark):
    assert compare.entry.entry(spark).count() > 0
