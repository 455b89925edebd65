"""Every registered query against its SQL twin; the catalogue is complete and typed."""

import pytest

from conftest import SF
from oracle import database, differences
from __spark_entry__ import entry
from keepwell.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def test_entry_has_rows_and_a_stable_schema(spark):
    first, again = entry(spark), entry(spark)
    assert first.schema == again.schema
    assert first.limit(1).count() == 1
