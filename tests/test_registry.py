"""Every registered query against its SQL in DuckDB, on the smallest dataset."""

import os

import pytest

import __spark_entry__ as contract
from registry import oracle
from registry.queries import QUERIES
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="dataset not present")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(oracle.statements()) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    outcome = compare(
        spark, duck, FOLDER, name, contract.queries()[name], contract.oracle_sql()[name]
    )
    assert outcome.startswith("equal"), outcome


def test_entry(spark):
    assert contract.entry(spark).count() > 0
