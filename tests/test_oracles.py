"""Every registered query against its SQL on the small tables."""

import pytest

from stackplume.testbed import catalog
from tests.harness import compare, connect

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    assert compare(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
