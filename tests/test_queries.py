"""Every registered query against its check SQL, on whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from quirelake.plans.catalog import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in CHECKS:
        assert compare(df, con, CHECKS[name]) == []
    else:
        assert df.count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["doc_id", "hits", "pages", "top"]
    assert out.count() > 0
