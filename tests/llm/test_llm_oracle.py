"""The queries of this subpackage on the smallest tables, against SQL where there is any."""

import pytest

from codeloom.llm import queries
from tests.oracle import assert_same, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
