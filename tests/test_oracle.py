"""Every registered query against its oracle SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from marketpulse.plans import REGISTRY
from tests.checking import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, con, small, name):
    ok, note = compare(spark, con, name, small)
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "parent", "label", "level", "value", "color"]
    assert df.count() > 0
