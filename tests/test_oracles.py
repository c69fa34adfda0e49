"""Every registered query against its DuckDB oracle on the smallest scale
(the driver repeats this at sf0.01)."""

import pytest
from oracle_check import compare

import __spark_entry__ as E
from plantops.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    r = compare(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "customer_name" and df.columns[-1] == "days_left"
