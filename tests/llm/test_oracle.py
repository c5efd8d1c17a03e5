"""Queries that SQL can express against DuckDB on whole tables."""

import pytest

from shoalkit.llm.registry import oracle_sql, queries
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_agrees(spark, name, folder):
    assert difference(spark, connect(folder), folder, queries()[name], oracle_sql()[name]) is None
