"""The llm queries against their SQL; those without SQL run."""

import pytest

from folioscope.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
