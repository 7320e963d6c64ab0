"""Registered queries against their SQL on the smallest dataset; the others by their rows."""

import os

import pytest

import __spark_entry__ as contract
from tools.compare import compare, connect
from tradewind.llm import oracle
from tradewind.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="dataset not present")


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert set(oracle.SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    outcome = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], oracle.SQL[name])
    assert outcome.startswith("equal"), outcome


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_query_returns_every_row(spark, name):
    key, source = {
        "op4_url_filter": ("page_id", "pages"), "op12_whitening": ("vec_id", "embeddings"),
    }.get(name, ("doc_id", "documents"))
    rows = QUERIES[name](spark, FOLDER)
    if "component" in rows.columns:  # a row per component
        rows = rows.filter("component = 1")
    got = [r[0] for r in rows.select(key).collect()]
    assert sorted(got) == sorted(r[0] for r in table(spark, FOLDER, source).select(key).collect())
