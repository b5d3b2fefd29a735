"""Queries that SQL can express, against DuckDB."""

import pytest

from loomline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, sf, name):
    mine = registry.queries()[name](spark, sf)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    assert sorted(map(tuple, mine.select(*cols).collect()), key=str) == sorted(theirs.select(*cols).fetchall(), key=str)
