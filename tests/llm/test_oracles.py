"""The text queries that SQL can express, against DuckDB."""

import pytest

from stackplume.llm.queries import ORACLES, QUERIES
from tests.harness import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(ORACLES[name])) is None
