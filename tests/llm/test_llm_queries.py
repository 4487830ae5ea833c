"""Registered training-data queries: those that SQL can express against their check SQL."""

import pytest
from compare import compare, connect

from quirelake.llm.queries import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, data, con, name):
    assert compare(QUERIES[name](spark, data), con, CHECKS[name]) == []


def test_all_numbers():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_entry_has_it(name):
    import __spark_entry__ as contract

    assert name in contract.queries()
