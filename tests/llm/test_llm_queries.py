"""Corpus queries that SQL can express, against their SQL twins."""

import pytest

from conftest import SF
from oracle import database, differences
from keepwell.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), database(SF), ORACLES[name]) == []
