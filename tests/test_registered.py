"""Every registered query against its SQL twin on the smallest given tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import compare, duck

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(contract.oracle_sql())


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data here")
    return duck(str(DATA))


def test_twins_exist_for_registered_queries_only():
    assert set(NAMES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, con, name):
    ok, note = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], str(DATA))
    assert ok, note


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).columns == ["query_id", "rank", "vector_id", "content", "metadata", "score"]
