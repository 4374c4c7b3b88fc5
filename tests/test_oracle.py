"""Every query of the core against its SQL on the smallest tables."""

import pytest

from codeloom.plans import registry
from tests.oracle import assert_same, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() >= 0
